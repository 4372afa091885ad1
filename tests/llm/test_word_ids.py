"""Ids of texts from words looked up a slice at a time, beside whole texts through the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import encoded

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    whole = Tokenizer.from_file(PATH)
    whole.no_truncation()
    whole.no_padding()
    return lambda text: whole.encode(text, add_special_tokens=False).ids + [1]


def test_capitals_before_joining_marks(vocabulary, library):
    """A capital that joins no mark, while the small letter does: T and H with U+0308 and U+0331."""
    texts = ["T̈al", "H̱", "á W̊", "plain"]
    found = encoded.WordIds(vocabulary).encode([t.encode() for t in texts], 1)
    assert [x.tolist() for x in found] == [library(t) for t in texts]


def test_odd_texts(vocabulary, library):
    rng = random.Random(5)
    signs = [*"aAbBzZ059 .,'!$&#_-@<>=|\"\n\t\x0b\x1f\x85", "É", "é", "Ñ", "ß", "÷", "×", "Þ", "ÿ", "̸", "≠", "Σ", "ª", "²", "İ", "中", "'s", "'LL", "<|endoftext|>", "<|", " "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", "é" * 400]
    own = encoded.WordIds(vocabulary, 50)
    for low in range(0, len(texts), 7):
        part = texts[low : low + 7]
        assert [x.tolist() for x in own.encode([t.encode() for t in part], 1)] == [library(t) for t in part]


def test_marks_do_not_make_new_words(vocabulary):
    """One entry for a word, with or without marks and capitals beside it."""
    own = encoded.WordIds(vocabulary)
    own.encode(["Élan élan. (élan) élan$$$ ÉLAN!! élan###".encode()], 1)
    assert len([w for w in own.new if "lan".encode() in w]) == 1


def test_words_of_letters_go_together(vocabulary):
    """The splitting rule and the normalizer are not run for each word of letters."""
    own = encoded.WordIds(vocabulary)
    words = [f"{a}{b}é" for a in "abcdefghij" for b in "klmnopqrst"]
    own.tokenizer = None
    found = own.encode([" ".join(words).encode()], 1)[0]
    assert np.flatnonzero(own.ends[found]).size == len(words)
