"""Sketches of shingle sets rule out pairs of a family that are alike but not near, and no others."""

import numpy as np

from lodestone.llm import near_copies as nc
from lodestone.llm.tables import released


def test_no_near_pair_is_ruled_out():
    rng = np.random.default_rng(4)
    near = 0
    for _ in range(3000):
        size = int(rng.integers(1, 1500))
        a = rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2)
        gone = int(rng.integers(0, max(1, size // 4)))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, size // 4)))).astype(np.uint64)]))
        a = np.unique(a)
        shared = len(np.intersect1d(a, b))
        likely = nc.may_be_near(*(np.array([len(x)]) for x in (a, b)), *(np.frombuffer(nc.sketch(x), dtype=np.uint64)[None] for x in (a, b)))[0]
        if shared >= nc.LEAST * (len(a) + len(b) - shared):
            near += 1
            assert likely
    assert near > 500
    none, empty = np.array([0]), np.frombuffer(nc.sketch(np.zeros(0, dtype=np.uint64)), dtype=np.uint64)[None]
    assert nc.may_be_near(none, none, empty, empty)[0]


def test_a_family_that_is_alike_gives_few_pairs(spark, monkeypatch):
    """Words in another order: equal sets of words, other shingles. Every pair of the family went to the proof before."""
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(60)]
    family = [(i, " ".join(rng.permutation(words))) for i in range(200)]
    twins = [(1000 + i, text.replace("word7 ", "word7 then ")) for i, text in family[:20]]
    docs = spark.createDataFrame(family + twins, "doc_id long, text string")
    staged = {}
    stage = nc.stage
    monkeypatch.setattr(nc, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    monkeypatch.setattr(nc, "SMALL", 4)
    found = {r.doc_id: r.component for r in nc.groups(docs).collect()}
    assert staged["near-rest"].count() < 400
    assert all(found[i] == found[1000 + i] for i in range(20)) and len(set(found.values())) == 200


def test_texts_are_not_put_together_before_they_become_many_rows(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text number ', id) as text")
    prints = nc.fingerprints(docs, "doc_id", "text")
    keyed = nc.distinct_texts(prints)
    assert nc.signatures(keyed).rdd.getNumPartitions() == nc.parallelism(spark)


def test_memory_is_given_back_at_the_end():
    assert list(released(iter)([1, 2])) == [1, 2]
