"""Exact medians and percentiles that do not gather a group in one task.

A sketch of each group gives two values close below and above every wanted rank. They cut
the group into a few ranges; counts tell which range holds a rank, and only that range, a
few thousandths of the group, goes on. For very large groups the caller has it cut *again*,
each time into `WAYS` parts of about as many distinct values, of which the one that holds
the rank goes on: a few millionths of the group after one more cut. What is left is ordered
by value. Every further cut adds stages, so small data need none. Sketches decide where the cuts are
and never what is returned: a poor cut makes a range larger, not the result wrong. Cuts
follow the ranks of the values, so outliers do not crowd a range.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Half the width of the range around a wanted share, and the inverse error of the sketch.
AROUND, ACCURACY = 0.0005, 10_000
#: Parts of a range that is cut again.
WAYS = 128


def values_at_ranks(
    rows: DataFrame,
    keys: list[str],
    value: str,
    ranks: Mapping[str, Column],
    shares: list[float],
    again: int = 0,
) -> DataFrame:
    """Per group the values at 1-based ranks; each rank is a column over the count *n*.

    *shares* say about where in the group the ranks lie (0 to 1). Keys must not be null;
    groups without any value are absent. *again* is the number of further cuts.
    """
    by = keys or ["_all"]
    left = ranges(rows, keys, value, ranks, shares, again)
    upto = F.sum("c").over(_running([*by, "name"], "v"))
    found = left.withColumn("upto", upto).filter(
        (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c"))
    )
    out = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks]
    )
    return out if keys else out.drop("_all")


def ranges(
    rows: DataFrame,
    keys: list[str],
    value: str,
    ranks: Mapping[str, Column],
    shares: list[float],
    again: int = 0,
) -> DataFrame:
    """(keys or _all, name, rank, v, c): the distinct values, with counts, around each rank.

    The rank counts from the first of them. They are all that is ordered in one task.
    """
    by = keys or ["_all"]
    source = rows if keys else rows.withColumn("_all", F.lit(1))
    source = source.select(*by, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counts = source.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    cuts = sorted({min(1.0, max(0.0, share + step)) for share in shares for step in (-AROUND, AROUND)})
    bounds = source.groupBy(*by).agg(
        F.percentile_approx("v", cuts, ACCURACY).alias("cuts"), F.count(F.lit(1)).alias("n")
    )
    bucket = F.size(F.filter("cuts", lambda cut: cut <= F.col("v")))
    placed = counts.join(bounds, by).select(*by, "v", "c", "n", bucket.alias("bucket"))
    histogram = (
        placed.groupBy(*by, "bucket", "n")
        .agg(F.sum("c").alias("in_bucket"))
        .withColumn("before", F.sum("in_bucket").over(_running(by, "bucket")) - F.col("in_bucket"))
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]
    )
    located = (
        histogram.select("*", F.explode(wanted).alias("w"))
        .filter(
            (F.col("w.rank") > F.col("before"))
            & (F.col("w.rank") <= F.col("before") + F.col("in_bucket"))
        )
        .select(*by, "bucket", "before", "w.name", "w.rank")
    )
    left = placed.join(located, [*by, "bucket"])
    left = left.select(*by, "name", (F.col("rank") - F.col("before")).alias("rank"), "v", "c")
    for _ in range(again):
        left = _closer(left, [*by, "name"])
    return left


def _running(by: list[str], order: str) -> WindowSpec:
    """From the first row of a group to this one."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _closer(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each range the part that holds its rank, the rank counted from there."""
    # Dealt by value, once for the three uses below; a range is a small share of its group.
    rows = rows.repartition(*by, "v")
    cuts = [step / WAYS for step in range(1, WAYS)]
    bounds = rows.groupBy(*by).agg(F.percentile_approx("v", cuts, ACCURACY).alias("cuts"))
    bucket = F.size(F.filter("cuts", lambda cut: cut <= F.col("v")))
    placed = rows.join(bounds, by).select(*by, "rank", "v", "c", bucket.alias("bucket"))
    located = (
        placed.groupBy(*by, "rank", "bucket")
        .agg(F.sum("c").alias("in_bucket"))
        .withColumn("before", F.sum("in_bucket").over(_running(by, "bucket")) - F.col("in_bucket"))
        .filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("in_bucket")))
        .select(*by, "bucket", "before")
    )
    return placed.join(located, [*by, "bucket"]).select(*by, (F.col("rank") - F.col("before")).alias("rank"), "v", "c")


def nearest_rank(share: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n")))


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median", again: int = 0) -> DataFrame:
    """Per group the interpolated median."""
    ranks = {
        "_low": F.floor((F.col("n") + 1) / 2),
        "_high": F.floor(F.col("n") / 2) + 1,
    }
    middle = values_at_ranks(rows, keys, value, ranks, [0.5], again)
    return middle.withColumn(name, (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")


def percentiles(
    rows: DataFrame, keys: list[str], value: str, shares: Mapping[str, float], again: int = 0
) -> DataFrame:
    """Per group nearest-rank percentiles: always a value that occurs."""
    ranks = {name: nearest_rank(share) for name, share in shares.items()}
    return values_at_ranks(rows, keys, value, ranks, list(shares.values()), again)
