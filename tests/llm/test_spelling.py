"""Spelling variants against all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import registry, spelling

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n int"


def counted(rows):
    counts = Counter()
    for own_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if own_id is None else own_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def near_words(words):
    """Neighbours by deleted places: two words at one edit share a variant with one place left out, or one is the other's."""
    by = {}
    for w in words:
        for i in range(len(w) + 1):
            by.setdefault((w[:i] + w[i + 1 :]) if i < len(w) else w, set()).add(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    return near


def brute(rows):
    n = counted(rows)
    near = near_words(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_near_words_is_all_pairs():
    words = ["abcde", "abcd", "abcdef", "bcdef", "abxde", "aaaaa", "aaaaaa", "aaaa"]
    near = near_words(words)
    assert all((b in near[a]) == one_edit(a, b) for a in words for b in words)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert found(registry.queries()["op13_spelling_variants"](spark, FOLDER)) == brute(rows)


@pytest.mark.parametrize("letters, sizes", [("ab", (5, 9)), ("aé", (5, 7)), ("abcdefgh", (5, 6)), ("ab", (30, 34))])
def test_dense_words(spark, letters, sizes):
    rng = np.random.default_rng(len(letters))
    words = ["".join(rng.choice(list(letters), size=rng.integers(*sizes, endpoint=True))) for _ in range(150)]
    words += [w[:k] + w[k + 1 :] for w in words[:60] for k in (0, len(w) // 2, len(w) - 1)]
    rows = [(i, " ".join(w for w in words for _ in range(int(rng.integers(1, 4))))) for i in range(3)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)
    assert found(spelling.variants(df)) == brute(rows)


def test_odd_rows(spark):
    long = "x" * 3000
    comb = ["ab" * 40 + "c" * k + "d" * (20 - k) for k in range(20)]
    rows = [
        (1, None), (2, ""), (3, " 12 _ ×÷ "), (None, "nullid nullid nullid nullidx nullidx nullidx"), (4, f"{long} {long} {long} {long}y {long}y {long}y y{long} " * 3),
        (5, "Straße STRASSE straßen ŠTRASSE \U0001f600word word’s É É é éÉéÉé éÉéÉé éÉéÉé"), (5, "Straße STRASSE straßen STRASSE straße"), (5, "Straße STRASSE straßen STRASSE straße"),
        (6, " ".join(comb * 3)), (7, "aaaaa aaaaaa aaaaaaa aaaaaaaa " * 3), (8, "hello;" * 100 + "hallo " * 50 + "hullo " * 20 + "hulls " * 10 + "halls " * 5),
    ]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS).repartition(3)
    assert found(spelling.variants(df)) == brute(rows)
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []


def test_pieces_hold_whole_words(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "one twotwotwo éééééééé;x yy  zzz".encode()
    pieces = list(spelling._pieces(text))
    assert b"".join(pieces) == text and len(pieces) > 2
    assert [w for p in pieces for w in spelling.WORD.findall(p)] == spelling.WORD.findall(text)
