"""Whitening of embeddings by float32 eigenvectors refined in higher precision.

Entries become integers first (`SCALE` times the entry, rounded down, plus `SHIFT`), so sums are
exact. Three passes read the vectors, each summed within tasks and then by Spark: counts and sums;
products of the vectors less the rounded mean; and, when the components are known, products of the
whitened vectors, from which `identity_error` is measured. Only matrices of the dimension reach
the driver. There the float32 eigenvectors of the covariance are corrected by Ogita-Aishima
iterations (matrix products in extended precision, squaring the error each round). Eigenvalues
too close for a correction term are a cluster: the matrix, shifted by the cluster's mean and
projected on its vectors, is solved on its own and turns them.

Cases: a vector that is null, empty, or holds a null or non-finite entry is left out; of several
lengths the most frequent one counts (ties: the longer), the others are left out; repeated rows
are counted and returned each; a null id stays null; no vector left gives no rows. A component
without variance (an eigenvalue at most `RANK` of the trace) has null `whitened`, and
`identity_error` is taken over the others. Entries beyond 2**62 after scaling are cut to that; a
deviation beyond a long is null. Products are exact up to 2**53 in a sum, and rounded beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import read
from lodestone.session import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
RANK = 1e-14
#: Refinement rounds; four are the rule, clusters take some more.
ROUNDS = 16
LIMIT = float(1 << 62)
WIDE = np.longdouble


# --- eigenvectors -------------------------------------------------------------------
def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Index groups of falling *values* whose neighbours are at most *apart*."""
    edges = np.flatnonzero(values[:-1] - values[1:] > apart) + 1
    return [part for part in np.split(np.arange(len(values)), edges) if len(part) > 1]


def _correction(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, WIDE]:
    """(correction, eigenvalues, least gap it can tell apart) of one Ogita-Aishima round."""
    defect = np.eye(len(matrix), dtype=WIDE) - vectors.T @ vectors
    product = vectors.T @ (matrix @ vectors)
    # Symmetric to the last bit: else the correction of a close pair would not be a rotation.
    defect, product = (defect + defect.T) / 2, (product + product.T) / 2
    values = np.diag(product) / (1 - np.diag(defect))
    off = product - np.diag(values)
    apart = 2 * (np.sqrt((off * off).sum()) + np.abs(matrix).sum(axis=0).max() * np.sqrt((defect * defect).sum()))
    gaps = values[None, :] - values[:, None]
    told = np.abs(gaps) > apart
    change = np.where(told, (product + values[None, :] * defect) / np.where(told, gaps, 1), defect / 2)
    return change, values, apart


def eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix, to double precision."""
    matrix = np.asarray(matrix, dtype=WIDE)
    largest = np.abs(matrix).max() if matrix.size else 0
    if not largest:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    scaled = matrix / largest
    _, first = np.linalg.eigh(scaled.astype(np.float32))
    vectors = first[:, ::-1].astype(WIDE)
    last = np.inf
    for _ in range(ROUNDS):
        change, values, apart = _correction(scaled, vectors)
        vectors = vectors + vectors @ change
        order = np.argsort(-values, kind="stable")
        vectors, values = vectors[:, order], values[order]
        size = np.abs(change).max()
        settled = size < 1e-17 or size >= last
        last = size if size < 1e-4 else np.inf
        turned = 0.0
        for part in _clusters(values, apart):
            own = vectors[:, part]
            middle = values[part].mean()
            inner = own.T @ (scaled @ own - middle * own)
            spread = np.abs(inner).max()
            if spread <= 1e-18:
                continue
            _, turn = np.linalg.eigh(((inner + inner.T) / (2 * spread)).astype(np.float64))
            turn = turn[:, ::-1]
            turned = max(turned, float(np.abs(turn * (1 - np.eye(len(part)))).max()))
            vectors[:, part] = own @ turn.astype(WIDE)
        if settled and turned < 1e-9:
            break
    for _ in range(2):
        vectors = vectors @ (1.5 * np.eye(len(scaled), dtype=WIDE) - 0.5 * (vectors.T @ vectors))
    values = np.einsum("ij,ij->j", vectors, scaled @ vectors) * largest
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), vectors[:, order].astype(np.float64)


# --- passes -------------------------------------------------------------------------
def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the scaled entries of every usable vector."""
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cut = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))) + F.lit(SHIFT).cast("long"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False))).select("vec_id", cut.alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums by vector length and place; place -1 holds the number of vectors."""
    totals: dict[int, list[int]] = {}
    for batch in batches:
        column = batch.column(0)
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(lengths).tolist():
            block = _matrix(column.filter(pa.array(lengths == size)), size)
            high, low = (block >> 32).sum(axis=0), (block & 0xFFFFFFFF).sum(axis=0)
            new = [len(block), *((h << 32) + l for h, l in zip(high.tolist(), low.tolist()))]
            totals[size] = [a + b for a, b in zip(totals.get(size, [0] * len(new)), new)]
    for size, values in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * len(values), pa.int32()), pa.array(range(-1, size), pa.int32()), pa.array(map(Decimal, values), pa.decimal128(38, 0))],
            ["size", "place", "total"],
        )


def _products(rows_of: Callable[[np.ndarray], np.ndarray], size: int):
    """Row k of the sum of row-by-row outer products of rows_of(x), for each k, of one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                block = rows_of(_matrix(batch.column(0), size))
                total = block.T @ block if total is None else total + block.T @ block
        if total is not None:
            yield _as_rows(range(len(total)), total)

    return run


def _as_rows(places, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(list(values), pa.list_(pa.float64()))], ["place", "row"])


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = row.values.to_numpy(zero_copy_only=False)
            totals[place] = totals[place] + values if place in totals else values.copy()
    if totals:
        yield _as_rows(list(totals), list(totals.values()))


def _gram(vectors: DataFrame, rows_of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    parts = vectors.select("x").mapInArrow(_products(rows_of, size), "place int, row array<double>")
    rows = parts.repartition("place").mapInArrow(_added, "place int, row array<double>").collect()  # one row a dimension
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["place"])])


class Whitening:
    """Mean and components of a fit list, as exact sums and double vectors."""

    def __init__(self, n: int, sums: list[int], gram: np.ndarray, centre: np.ndarray, rest: list[int]):
        self.n, self.size, self.centre, self.rest = n, len(sums), centre, rest
        shift = np.array([WIDE(r) / n for r in rest])
        covariance = gram.astype(WIDE) / n - np.outer(shift, shift)
        values, vectors = eigenpairs((covariance + covariance.T) / 2)
        count = min(COMPONENTS, self.size)
        self.values, self.trace = values[:count], float(np.trace(covariance))
        self.alive = self.values > RANK * self.trace
        self.shift = shift.astype(np.float64)
        self.components = vectors[:, :count]
        self.scaled = self.components / np.sqrt(np.where(self.alive, self.values, 1.0))
        self.explained = [float(v) / self.trace if self.trace > 0 else 0.0 for v in self.values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.shift) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 of each row, in whole numbers."""
        y = x - self.centre
        if not y.size:
            return []
        most = int(np.abs(y).max()) * self.n + max(map(abs, self.rest))
        if most * most * self.size < 1 << 63:
            return ((y * self.n - np.array(self.rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((v * self.n - r) ** 2 for v, r in zip(row, self.rest)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of all rows of *vectors* (x) that have the most frequent length; None without rows."""
    totals = stage(vectors.select("x").mapInArrow(_sums, "size int, place int, total decimal(38,0)").groupBy("size", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total")), "whitening-sums")
    top = totals.where("place = -1").orderBy(F.desc("total"), F.desc("size")).first()
    if top is None:
        return None
    n, size = int(top["total"]), top["size"]
    sums = [int(r["total"]) for r in totals.where(F.col("size") == size).where("place >= 0").orderBy("place").collect()]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(middle, dtype=np.int64)
    rest = [s - n * m for s, m in zip(sums, middle)]
    gram = _gram(_sized(vectors, size), lambda x: (x - centre).astype(np.float64), size)
    return Whitening(n, sums, gram, centre, rest)


def _sized(vectors: DataFrame, size: int) -> DataFrame:
    return vectors.where(F.size("x") == size)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity."""

    def rows_of(x):
        return np.hstack([model.whitened(x)[:, model.alive], np.ones((len(x), 1))])

    sums = _gram(_sized(vectors, model.size), rows_of, model.size) / model.n
    mean = sums[:-1, -1]
    found = sums[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))
    return float(np.abs(found).max()) if found.size else 0.0


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened as an array over components) for every row of the fitted length."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), own.size)
            values = np.where(own.alive, own.whitened(x), np.nan)
            flat = pa.array(values.ravel(), pa.float64(), from_pandas=True)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * values.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "deviation", "whitened"])

    return _sized(vectors, model.size).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(read(spark, sf_dir, "embeddings"))
    return whitened_rows(vectors)


def whitened_rows(vectors: DataFrame) -> DataFrame:
    """One row for each vector and component, with the figures of the fit."""
    model = fit(vectors)
    if model is None:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], empty)
    error = identity_error(vectors, model)
    explained = F.array(*map(F.lit, model.explained))
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLE: dict[str, str] = {}
