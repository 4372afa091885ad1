"""Reading the given tables, staging, and joins with a size-checked small side."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import prepare, stage

#: A staged side is sent to every executor up to this many bytes, joined by a shuffle beyond.
BROADCAST_BYTES = 48 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shipped(query: Callable) -> Callable:
    """The query, with this package sent to the Python workers first."""

    @wraps(query)
    def run(spark, *args):
        prepare(spark)
        return query(spark, *args)

    return run


def released(run: Callable) -> Callable:
    """The function of batches, after whose end its worker, which waits for other tasks, gives free memory back."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def side(small: DataFrame, name: str, row_bytes, limit: int = BROADCAST_BYTES) -> DataFrame:
    """*small*, staged, with a broadcast hint if its measured size is at most *limit*.

    *row_bytes* is a column with the bytes a row takes. Beyond the limit the same
    join runs as a shuffled one, so the result does not depend on the size.
    """
    staged = stage(small, name)
    size = staged.agg(F.sum(row_bytes).alias("n")).first()["n"] or 0
    return F.broadcast(staged) if size <= limit else staged
