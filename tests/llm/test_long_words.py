"""Very long words under the tokenizers: same ids, work in proportion, nothing long remembered."""

import time

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import bpe, encoded

RANDOM = np.random.default_rng(3)


def letters(alphabet, size):
    return "".join(RANDOM.choice(list(alphabet), size))


class Vocabulary:
    value = bpe.byte_vocabulary()


def coded(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = pa.Table.from_batches(list(bpe._encode(Vocabulary)([batch])))
    return out.column("ids").to_pylist(), out.column("decoded").to_pylist()


@pytest.mark.parametrize("text", [
    letters("abcdefgh", 60_000), "x" + " " * 30_000 + "y", "=" * 20_000 + "!", letters("日本語学校", 9_000), letters("0123456789", 20_000),
    "a short start " + letters("ACGT", 20_000) + " and it's an end" + letters("éa", 3_000) + "'s <|endoftext|>" + letters("ab", 9_000),
    ("w " * 60 + "q" * 700) * 20 + "\n" * 9_000,
])
def test_same_ids_as_the_library(text):
    own = bpe.coder(Vocabulary.value)
    (ids,), (decoded,) = coded([text])
    assert ids == own.tokenizer.encode(text, add_special_tokens=False).ids and decoded == text


def test_work_and_memory():
    coded(["warm up " + letters("abc", 1000)])
    own, taken = bpe.coder(Vocabulary.value), []
    for size in (100_000, 1_000_000):
        text = letters("abcdefghijklmnopqrstuvwxyz", size)
        started = time.process_time()
        coded([text])
        taken.append(time.process_time() - started)
    assert taken[1] < 30 * max(taken[0], 0.02)
    assert max(map(len, [*own.ids.new, *own.ids.old])) <= encoded.LONGEST_KEPT and not own.ids.long
