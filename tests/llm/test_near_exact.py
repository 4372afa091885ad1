"""Links that the forests of a large bucket leave out are proved all the same."""

from itertools import combinations

from pyspark.sql import functions as F

from lodestone.llm import near_copies
from lodestone.session import stage


def test_pairs_in_one_large_bucket(spark):
    """60 texts with one fingerprint, near in pairs: a forest compares each with one other only."""
    texts = []
    for n in range(30):
        words = [f"t{n}w{i}" for i in range(80)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    prints = docs.select("doc_id", F.xxhash64("text").alias("twin"), *[F.lit(7).cast("long").alias(f"fp{k}") for k in range(near_copies.PRINTS)])
    links = near_copies.near_pairs(docs, stage(prints, "prints"), "text")
    number = {r.twin: r.doc_id for r in prints.collect()}
    found = {tuple(sorted((number[r.a], number[r.b]))) for r in links.collect()}
    assert found == {(2 * n, 2 * n + 1) for n in range(30)}


def test_a_large_bucket_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rows = [(k, 100 * k + n, n, n % 5) for k in (1, 2) for n in range(30)]
    frame = spark.createDataFrame(rows, "key long, twin long, fp long, component long")
    found = {tuple(r) for batch in near_copies._apart(frame.toArrow().sort_by("key").to_batches(max_chunksize=7)) for r in zip(*batch.to_pydict().values())}
    far = [(i, j) for i, j in combinations(range(30), 2) if (i ^ j).bit_count() <= 5 and i % 5 != j % 5]
    assert far and found == {(100 * k + i, 100 * k + j) for k in (1, 2) for i, j in far}
