"""The scan of the similarity join on copies, ties and more queries than one slice."""

import numpy as np
import pytest

from lodestone.catalog import retrieval_queries
from lodestone.operators import retrieval


def best(queries, ids, data, k):
    scores = np.round((queries[:, None, :] * data[None]).sum(axis=2), retrieval.SCORE_DIGITS) + 0.0
    return {n: [ids[i] for i in np.lexsort((ids, -row))[:k]] for n, row in enumerate(scores)}


@pytest.mark.parametrize("kind", [int, str])
def test_copies_and_ties(kind):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(60, 8))
    data = np.concatenate([data[rng.integers(0, 60, 700)], np.repeat(data[:1], 900, axis=0), np.zeros((3, 8))])
    data /= np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-30)
    ids = rng.permutation(len(data)) * 3
    ids = ids if kind is int else np.array([f"r{i}" for i in ids], dtype=object)
    queries = np.concatenate([data[:40], np.zeros((1, 8))])
    scan = retrieval.Scan(list(range(41)), queries, 6)
    for low in range(0, len(data), 250):
        scan.add(ids[low : low + 250], data[low : low + 250])
    assert scan.result().groupby("query_id")["id"].apply(list).to_dict() == best(queries, ids, data, 6)


def test_bounds_are_taken_once_a_block():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(5000, 4))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    scan = retrieval.Scan(list(range(5000)), data, 3)
    calls = []
    whole, scan.bounds = scan.bounds, lambda block: calls.append(1) or whole(block)
    scan.add(np.arange(500), data[:500])
    assert len(calls) == 1


def test_ids_beyond_doubles(spark):
    big = (1 << 60) + 1
    rows = spark.range(9).selectExpr(f"id + {big} as id", "array(double(id), 1.0D) as embedding")
    asked = rows.withColumnRenamed("id", "query_id")
    for found in (retrieval.similarity_join(asked, rows, 1, 2), retrieval.similarity_join_few(asked, rows, 1)):
        assert sorted((r.query_id, r.id) for r in found.collect()) == [(big + n, big + n) for n in range(9)]


def test_many_queries_go_by_the_shuffled_join(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    few = sorted(map(tuple, retrieval_queries.QUERIES["similarity_join_few"](spark, folder).collect()))
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 3)
    assert sorted(map(tuple, retrieval_queries.QUERIES["similarity_join_few"](spark, folder).collect())) == few
