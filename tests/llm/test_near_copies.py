"""Near copies of the pipeline's stage against all pairs."""

import numpy as np
import pytest

from lodestone.llm import near_copies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x & y) and len(x & y) >= 0.8 * len(x | y)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 0, "clash") for i, t in rows], DOCS).repartition(5)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        k, kind = int(rng.integers(len(words))), rng.integers(3)
        words[k : k + 1] = [[f"new{rng.integers(10**6)}"], [], [words[k], f"more{rng.integers(10**6)}"]][kind]
    return " ".join(words)


def test_recall_of_edited_copies(spark):
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for n in range(150):
        words = [f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(40, 300))) % 5000]
        text, copy = " ".join(words), edited(words, rng, max(1, len(words) // 55))
        rows += [(2 * n, text), (2 * n + 1, copy)]
        if near(text, copy):
            pairs.append((2 * n, 2 * n + 1))
    part = {r["doc_id"]: r["component"] for r in near_copies.groups(frame(spark, rows)).collect()}
    caught = sum(part[a] == part[b] for a, b in pairs)
    assert len(pairs) > 100 and caught >= 0.95 * len(pairs)
    assert all(near(rows[a][1], rows[b][1]) for a in range(300) for b in range(a) if part[a] == part[b])


def test_a_large_family_is_one_group(spark):
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(200)]
    family = sorted({edited(base, rng, 1) for _ in range(400)})
    rows = list(enumerate(family)) + [(1000 + i, " ".join(f"c{i}x{j}" for j in range(50))) for i in range(50)] + [(2000 + i, family[0]) for i in range(300)]
    kept = sorted(r["doc_id"] for r in near_copies.one_of_each(frame(spark, rows)).collect())
    assert kept == [0, *range(1000, 1050)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (5, "one two three four five six"), (None, "one two"), (None, "alone é"), (7, "x " * 50_000), (8, "x " * 50_001), (9, "y")]
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:3]) for r in near_copies.one_of_each(frame(spark, rows)).collect())
    assert kept == sorted([("1", ""), ("4", "one"), ("5", "one"), ("None", "alo"), ("7", "x x"), ("9", "y")])
    assert near_copies.one_of_each(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("count", [2, 30, 3000])
def test_a_forest_joins_what_is_near(count):
    rng = np.random.default_rng(count)
    fps = np.concatenate([np.full(count, c) ^ (np.int64(1) << rng.integers(0, 60, count)) for c in (0, -1)])
    links = near_copies._forest(fps)
    assert all((int(fps[a]) ^ int(fps[b])) & (1 << 64) - 1 == 0 or bin((int(fps[a]) ^ int(fps[b])) & (1 << 64) - 1).count("1") <= 5 for a, b in links)
    parent = list(range(2 * count))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[root(a)] = root(b)
    assert len({root(n) for n in range(2 * count)}) == 2


def test_links_over_the_sign_bit():
    fps = np.array([-(1 << 63) + 1, 0, -1, 5], dtype=np.int64)
    assert simhash.differing(fps[:1], fps[1:]).tolist() == [2, 62, 2]
    assert simhash._forest(np.sort(fps[:2])) == [(0, -(1 << 63) + 1)]
