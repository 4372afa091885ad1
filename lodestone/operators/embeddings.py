"""Vectors for texts: user callables, hash vectors, lexical vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestone import constants as k
from lodestone.functions import text as t
from lodestone.functions import vectors
from lodestone.functions.binding import let
from lodestone.policies import EmbeddingSpec

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def embed(texts: DataFrame, key: str, text: str, provider: Embedder) -> DataFrame:
    """One vector per row from a user callable that takes and returns a batch.

    A batch with the wrong number of vectors fails its task.
    """
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            made = provider(batch[text].tolist())
            if len(made) != len(batch):
                raise ValueError(f"{len(made)} vectors for {len(batch)} texts")
            yield pd.DataFrame({key: batch[key], "embedding": [list(map(float, v)) for v in made]})

    return texts.select(key, text).mapInPandas(run, f"{key} {key_type}, embedding array<double>")


def embedding_problems(wanted: DataFrame, embedded: DataFrame, key: str, spec: EmbeddingSpec) -> DataFrame:
    """Missing, unknown, repeated or malformed vectors: key, problem."""
    counts = embedded.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(vectors.vector_problem(F.col("embedding"), spec.dimensions)).alias("bad"),
    )
    both = wanted.select(key, F.lit(True).alias("w")).join(counts, key, "full_outer")
    problem = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("w").isNull(), "unknown_input")
        .when(F.col("n") > 1, "repeated")
        .otherwise(F.col("bad"))
    )
    return both.select(key, problem.alias("problem")).filter(F.col("problem").isNotNull())


def hash_vectors(texts: list[str], dimensions: int) -> np.ndarray:
    """Unit vectors read from SHA-256 rounds over text, NUL and a counter."""
    rounds = -(-dimensions // 8)
    digests = b"".join(
        hashlib.sha256(f"{text}\0{n}".encode()).digest() for text in texts for n in range(rounds)
    )
    words = np.frombuffer(digests, dtype=">u4").reshape(len(texts), rounds * 8)[:, :dimensions]
    values = words / float(2**31) - 1.0
    length = np.sqrt((values * values).sum(axis=1, keepdims=True))
    values[length[:, 0] == 0.0, 0] = 1.0
    return values / np.where(length == 0.0, 1.0, length)


def hash_embedding(dimensions: int = 256):
    """Arrow function: deterministic vector of a text. Carries no meaning."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_vectors(texts.tolist(), dimensions)))

    return vector


def lexical_vector(text: Column, dimensions: int = 64) -> Column:
    """Hashed bag of words of unit length, sparse: struct(buckets ascending, values).

    Words of three letters and more that are no function words; the bucket is the first
    32 bits of the word's SHA-256. A null text or one without words gets the first unit
    vector. Sorted buckets are counted by the ends of their runs, so the work is linear
    in the words but for the sort, and no row leaves the JVM.
    """
    found = F.filter(t.words(text), lambda w: (F.length(w) >= 3) & ~w.isin(k.LEXICAL_STOPWORDS))
    hashed = F.transform(
        found,
        lambda w: (F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int"),
    )
    nothing = F.array(F.lit(0))

    def runs(buckets: Column) -> Column:
        last = F.filter(
            F.sequence(F.lit(1), F.size(buckets)),
            lambda i: ~F.get(buckets, i - 1).eqNullSafe(F.get(buckets, i)),
        )
        return let(last, lambda ends: _unit(buckets, ends))

    used = F.coalesce(F.sort_array(hashed), nothing)
    return let(used, lambda b: let(F.when(F.size(b) > 0, b).otherwise(nothing), runs))


def _unit(buckets: Column, ends: Column) -> Column:
    """Buckets and values from the sorted buckets and the (1-based) ends of their runs."""
    counts = F.transform(ends, lambda e, i: (e - F.coalesce(F.get(ends, i - 1), F.lit(0))).cast("double"))

    def scaled(n: Column) -> Column:
        squares = F.sqrt(F.aggregate(n, F.lit(0.0), lambda a, x: a + x * x))
        return F.struct(
            F.transform(ends, lambda e: F.get(buckets, e - 1)).alias("buckets"),
            let(squares, lambda length: F.transform(n, lambda x: x / length)).alias("values"),
        )

    return let(counts, scaled)


def dense(vector: Column, dimensions: int) -> Column:
    """A sparse vector as an array of *dimensions* values."""
    return let(
        F.map_from_arrays(vector["buckets"], vector["values"]),
        lambda m: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda b: F.coalesce(m[b], F.lit(0.0))),
    )


def lexical_embedding(texts: DataFrame, key: str, text: str, dimensions: int = 64, keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns of *keep*, and the lexical vector of *text* as a dense embedding."""
    vector = let(lexical_vector(F.col(text), dimensions), lambda v: dense(v, dimensions))
    return texts.select(key, *keep, vector.alias("embedding"))
