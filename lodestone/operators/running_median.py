"""Exact running count, sum and median of ordered runs, a run being cut into spans.

A span's rows come after all rows of earlier spans. While *m* rows of a span are added to
*N* earlier values, the median stays within m / 2 ranks of the earlier middle. So a span
needs, of all that came before, only how many values there are and those around the middle,
as many as the span has rows. Where they are is found from counts: values are cut into
buckets by a sketch of the run, counts by span and bucket are added up along the spans, and
only the buckets that hold the wanted ranks are joined with the span, as values with counts.
The sketch decides how many values are joined, never what is returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1_000_000
#: Buckets of a run's values, and the inverse error of the sketch.
BUCKETS, ACCURACY = 128, 10_000


class Halves:
    """A multiset as its smaller and its larger half, of which only the inner ends are held.

    The smaller half has the middle value when the count is odd. *near* are ascending
    (value, count) around the middle; *below* is how many values are smaller than those.
    """

    def __init__(self, size: int = 0, below: int = 0, near: list[tuple[float, int]] = ()):
        self.low_size, self.high_size = size - size // 2, size // 2
        self.low: list[float] = []
        self.high: list[float] = []
        #: Not yet on the heaps: the innermost value is the last.
        self.low_rest: list[list] = []
        self.high_rest: list[list] = []
        rank = below
        for value, count in near:
            left = max(0, min(count, self.low_size - rank))
            if left:
                self.low_rest.append([value, left])
            if count > left:
                self.high_rest.append([value, count - left])
            rank += count
        self.high_rest.reverse()

    @staticmethod
    def _take(rest: list[list]) -> float:
        value, count = rest[-1]
        if count == 1:
            rest.pop()
        else:
            rest[-1][1] = count - 1
        return value

    def largest_low(self) -> float:
        if self.low and (not self.low_rest or -self.low[0] >= self.low_rest[-1][0]):
            return -self.low[0]
        return self.low_rest[-1][0]

    def smallest_high(self) -> float:
        if self.high and (not self.high_rest or self.high[0] <= self.high_rest[-1][0]):
            return self.high[0]
        return self.high_rest[-1][0]

    def add(self, value: float) -> None:
        if self.low_size and value < self.largest_low():
            heapq.heappush(self.low, -value)
            self.low_size += 1
        else:
            heapq.heappush(self.high, value)
            self.high_size += 1
        if self.low_size > self.high_size + 1:
            moved = self.largest_low()
            if self.low and -self.low[0] == moved:
                heapq.heappop(self.low)
            else:
                self._take(self.low_rest)
            heapq.heappush(self.high, moved)
            self.low_size, self.high_size = self.low_size - 1, self.high_size + 1
        elif self.high_size > self.low_size:
            moved = self.smallest_high()
            if self.high and self.high[0] == moved:
                heapq.heappop(self.high)
            else:
                self._take(self.high_rest)
            heapq.heappush(self.low, -moved)
            self.low_size, self.high_size = self.low_size + 1, self.high_size - 1

    def median(self) -> float:
        low = self.largest_low()
        return low if self.low_size > self.high_size else (low + self.smallest_high()) / 2


def _around_the_middle(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(run_id, _span, v, c, _below): the values a span needs of those before it, with their counts."""
    later = spans.filter("_n_before > 0")
    long_runs = later.select("run_id").distinct()
    own = rows.join(long_runs, "run_id", "left_semi")
    shares = [(i + 1) / BUCKETS for i in range(BUCKETS - 1)]
    cuts = own.groupBy("run_id").agg(F.percentile_approx("cost", shares, ACCURACY).alias("cuts"))
    counts = own.groupBy("run_id", "_span", F.col("cost").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    bucket = F.size(F.filter("cuts", lambda cut: cut <= F.col("v")))
    values = counts.join(cuts, "run_id").select("run_id", "_span", "v", "c", bucket.alias("bucket"))
    along = Window.partitionBy("run_id", "bucket").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("run_id", "_span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = values.groupBy("run_id", "_span", "bucket").agg(F.sum("c").alias("c"))
    every = spans.join(long_runs, "run_id", "left_semi").withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1)))
    )
    grid = (
        every.join(in_bucket, ["run_id", "_span", "bucket"], "left")
        .withColumn("held", F.coalesce(F.sum("c").over(along), F.lit(0)))
        .withColumn("under", F.coalesce(F.sum("held").over(up), F.lit(0)))
    )
    reach = F.col("_n") / 2 + 2
    middle = F.col("_n_before") / 2
    wanted = grid.filter(
        (F.col("_n_before") > 0) & (F.col("held") > 0)
        & (F.col("under") <= middle + reach) & (F.col("under") + F.col("held") >= middle - reach)
    )
    first = Window.partitionBy("run_id", "_span")
    wanted = wanted.select("run_id", "_span", "bucket", F.min("under").over(first).alias("_below"))
    earlier = values.withColumnRenamed("_span", "_from")
    return (
        wanted.join(earlier, ["run_id", "bucket"])
        .filter(F.col("_from") < F.col("_span"))
        .groupBy("run_id", "_span", "v", "_below")
        .agg(F.sum("c").alias("c"))
    )


def _in_spans(rows: DataFrame, span: int) -> DataFrame:
    """rows(run_id, _cell, ...) with _span instead of _cell: cells of a run, in order, are put together
    to *span* rows and more, so runs of few rows in many cells have few spans."""
    before = Window.partitionBy("run_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("run_id", "_cell").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("run_id").alias("_run"), F.col("_cell").alias("_of"),
        F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / span).cast("long").alias("_span"),
    )
    here = F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_cell") == F.col("_of"))
    return rows.join(cells, here).drop("_run", "_of", "_cell")


def running(costs: DataFrame, span: int = SPAN) -> DataFrame:
    """costs(run_id, position, cost) with seen, spent and own_median after every row, by position.

    A span holds at least *span* rows of a run (but the last), at most *span* more if no position
    repeats, and goes to one task; rows without a position come first, rows without a run are one span.
    """
    run_type = costs.schema["run_id"].dataType.simpleString()
    position_type = costs.schema["position"].dataType.simpleString()
    rows = _in_spans(
        costs.select(
            "run_id", "position", F.col("cost").cast("double").alias("cost"),
            F.when(F.col("run_id").isNotNull() & F.col("position").isNotNull(), F.floor(F.col("position") / span).cast("long"))
            .otherwise(F.lit(-(1 << 62)))
            .alias("_cell"),
        ),
        span,
    )
    before = Window.partitionBy("run_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        rows.groupBy("run_id", "_span")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("cost").alias("_sum"))
        .withColumn("_n_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_spent_before", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    )
    none = F.lit(None)
    head = spans.select(
        "run_id", "_span", F.lit(0).alias("tag"), none.cast(position_type).alias("position"),
        F.col("_spent_before").alias("value"), F.col("_n_before").alias("count"),
    )
    near = _around_the_middle(rows, spans)
    below = near.groupBy("run_id", "_span").agg(F.first("_below").alias("count")).select(
        "run_id", "_span", F.lit(1).alias("tag"), none.cast(position_type).alias("position"), F.lit(0.0).alias("value"), "count"
    )
    middle = near.select(
        "run_id", "_span", F.lit(2).alias("tag"), none.cast(position_type).alias("position"), F.col("v").alias("value"), F.col("c").alias("count")
    )
    own = rows.select("run_id", "_span", F.lit(3).alias("tag"), "position", F.col("cost").alias("value"), F.lit(1).cast("long").alias("count"))
    # The middle comes by value, the rows of the span by position.
    ordered = (
        head.union(below).union(middle).union(own)
        .withColumn("_key", F.when(F.col("tag") == 2, F.col("value")))
        .repartition("run_id", "_span")
        .sortWithinPartitions("run_id", "_span", "tag", "_key", "position")
        .drop("_key")
    )
    return ordered.mapInPandas(_scan, f"run_id {run_type}, position {position_type}, cost double, seen bigint, spent double, own_median double")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each span's head, count below, middle and rows, in this order, to rows with their figures."""
    size = below = 0
    spent = 0.0
    near: list[tuple[float, int]] = []
    halves: Halves | None = None
    for batch in batches:
        kept, seen, total, median = [], [], [], []
        for at, (tag, value, count) in enumerate(zip(batch["tag"].tolist(), batch["value"].tolist(), batch["count"].tolist())):
            if tag == 0:
                size, below, spent, near, halves = count, 0, value, [], None
            elif tag == 1:
                below = count
            elif tag == 2:
                near.append((value, count))
            else:
                if halves is None:
                    halves, near = Halves(size, below, near), []
                halves.add(value)
                spent += value
                kept.append(at)
                seen.append(halves.low_size + halves.high_size)
                total.append(spent)
                median.append(halves.median())
        rows = batch.iloc[kept]
        yield pd.DataFrame(
            {"run_id": rows["run_id"], "position": rows["position"], "cost": rows["value"], "seen": seen, "spent": total, "own_median": median}
        )
