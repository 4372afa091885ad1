"""Whitening against plain exact sums and eigenvectors of numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import registry, whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, n long, component string"


def usable(vector):
    return vector and all(c is not None and math.isfinite(c) for c in vector)


def brute(rows):
    """vec_id -> (n, deviation, projections by component, explained)."""
    rows = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if usable(v)]
    n, sums = len(rows), [sum(col) for col in zip(*(x for _, x in rows))]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x in rows])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    out = centred @ vectors / np.sqrt(values)
    return n, [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in rows], out, values


def check(found, rows):
    n, deviations, out, values = brute(rows)
    ids = [i for i, v in rows if usable(v)]
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == len(by) == len(ids) * len(values)
    trace_share = None
    for k in range(len(values)):
        own = np.array([by[i, k + 1]["whitened"] for i in ids])
        sign = 1 if own @ out[:, k] > 0 else -1
        assert np.abs(own - sign * out[:, k]).max() < 1e-8
        trace_share = by[ids[0], k + 1]["explained"]
        assert trace_share == pytest.approx(values[k] / (values[0] / by[ids[0], 1]["explained"]), rel=1e-9)
    for i, d in zip(ids, deviations):
        row = by[i, 1]
        assert (row["n"], row["deviation"]) == (n, d) and row["identity_error"] < 1e-9


def test_whole_table(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(registry.queries()["op11_embedding_whitening"](spark, FOLDER).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(size=4) * (1, 2, 3, 40)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 2.0, 3.0]), (104, [float("inf")] * 4)]
    rows = [(i, v, 7, "clash") for i, v in good + odd + [(105, [1.0, 2.0]), good[0]]]
    found = whitening.whitened_rows(whitening.integers(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    assert {r["vec_id"] for r in found} == {i for i, _ in good} and len(found) == 61 * 4
    n, deviations, out, _ = brute(good + [good[0]])
    assert {r["deviation"] for r in found if r["vec_id"] == 0} == {deviations[0]} and found[0]["n"] == 61
    assert max(r["identity_error"] for r in found) < 1e-9
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened_rows(whitening.integers(empty)).collect() == []


def test_no_variance_and_huge_entries(spark):
    same = spark.createDataFrame([(None, [1.0, 2.0], 0, "")] * 3, SCHEMA)
    found = whitening.whitened_rows(whitening.integers(same)).collect()
    assert [(r["vec_id"], r["whitened"], r["deviation"], r["explained"]) for r in found] == [(None, None, 0, 0.0)] * 6
    flat = spark.createDataFrame([(i, [float(i), 5.0], 0, "") for i in range(9)], SCHEMA)
    found = whitening.whitened_rows(whitening.integers(flat)).collect()
    assert {(r["component"], r["whitened"] is None) for r in found} == {(1, False), (2, True)}
    huge = spark.createDataFrame([(1, [1e300, 1.0], 0, ""), (2, [-1e300, 2.0], 0, ""), (3, [0.0, 3.0], 0, "")], SCHEMA)
    found = whitening.whitened_rows(whitening.integers(huge)).collect()
    assert len(found) == 6 and any(r["deviation"] is None for r in found)


@pytest.mark.parametrize("values", [
    [5.0, 5.0, 5.0, 1.0], [3.0, 3.0 + 1e-9, 3.0 + 2e-9, 1.0, 1.0 + 1e-13, 0.5],
    list(1 + np.arange(40) * 1e-7), list(np.geomspace(1e6, 1e-6, 30)), [2.0], [0.0, 0.0],
])
def test_clustered_eigenvalues(values):
    size = len(values)
    turn, _ = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    turn = turn.astype(np.longdouble)
    turn = turn @ (1.5 * np.eye(size) - 0.5 * (turn.T @ turn))
    matrix = (turn * np.array(values, dtype=np.longdouble)) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.eigenpairs(matrix)
    scale = max(values) or 1.0
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-15 * scale
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-14
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-14 * scale
