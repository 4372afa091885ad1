"""Edited copies of benchmark items: hot items, common words, short items."""

import numpy as np
import pytest

from lodestone.llm import decontaminate
from tests.llm import brute

RNG = np.random.default_rng(17)
COMMON = [f"c{i}" for i in range(50)]


def prose(size, words=COMMON):
    return [str(w) for w in RNG.choice(words, size)]


def changed(words, every):
    return [f"x{RNG.integers(10**9)}" if i % every == every - 1 else w for i, w in enumerate(words)]


def found(spark, docs, items):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}


@pytest.mark.parametrize("every", [3, 4, 6, 8, 100])
def test_edited_copies_of_hot_items_of_common_words(spark, every):
    items = [(i, prose(40)) for i in range(8)]
    rare = (8, [f"r{i}" for i in range(40)])
    docs = []
    for i, own in [*items, rare]:
        docs += [(100 * i + k, prose(30) + changed(own, every) + prose(30)) for k in range(20)]
        docs += [(100 * i + 50 + k, own) for k in range(20)]  # a third of all words are leaks
    docs += [(5000 + k, prose(300, [f"d{i}" for i in range(3000)])) for k in range(100)]
    got = found(spark, docs, [*items, rare])
    wanted = {(100 * i + k, i) for i in range(9) for k in (*range(20), *range(50, 70))}
    if every == 3:  # two of three words stay: a score of a half, so it is up to chance
        wanted = {p for p in wanted if p[0] % 100 >= 50}
    assert len(wanted & got) >= 0.98 * len(wanted) and not any(d >= 5000 for d, _ in got)


def test_short_items(spark):
    items = [(n, [f"s{n}w{i}" for i in range(n)]) for n in range(1, 9)]
    docs = []
    for n, own in items:
        for k in range(n):
            docs.append((100 * n + k, [*prose(5), *own[:k], "other", *own[k + 1 :], *prose(5)]))
        docs.append((100 * n + 99, [*prose(5), *own, *prose(5)]))
    got = found(spark, docs, items)
    plain = [(d, " ".join(t)) for d, t in docs]
    assert got == brute.leaks(plain, [(i, " ".join(t)) for i, t in items])
    assert {(100 * n + 99, n) for n in range(1, 9)} <= got and {(500 + k, 5) for k in range(5)} <= got and (400, 4) not in got
