"""Ranks of large groups: exact, with few values in one window."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import order_statistics as o

SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _rows(spark, n):
    spread = F.pmod(F.col("id") * 7919 + 13, F.lit(n)).cast("double")
    return spark.range(0, n, 1, 8).select(F.lit("one").alias("g"), (spread * spread).alias("v"))


def test_few_values_of_a_large_group_are_ordered(spark):
    n = 400_003
    ranks = {name: o.nearest_rank(share) for name, share in SHARES.items()}
    args = (_rows(spark, n), ["g"], "v", ranks, list(SHARES.values()))
    held = [
        {r["name"]: r["n"] for r in o.ranges(*args, again=again).groupBy("name").agg(F.count("*").alias("n")).collect()}
        for again in (0, 1, 2)
    ]
    assert all(set(h) == set(SHARES) for h in held)
    assert max(held[0].values()) <= n // 400
    assert max(held[1].values()) <= max(8, max(held[0].values()) // 64)
    assert max(held[2].values()) <= max(held[1].values())
    got = o.percentiles(_rows(spark, n), ["g"], "v", SHARES, again=1).first()
    assert {name: got[name] for name in SHARES} == {name: float((math.ceil(s * n) - 1) ** 2) for name, s in SHARES.items()}


def test_groups_of_many_shapes_against_numpy(spark):
    r = np.random.default_rng(5)
    groups = {
        "single": [3.5],
        "pair": [1.0, 2.0],
        "ties": [7.0] * 900 + [1.0] * 90 + [9.0] * 10,
        "outlier": [*r.normal(size=2000).tolist(), 1e300, -1e300],
        "rounded": np.round(r.exponential(10, 5000), 1).tolist(),
        "one value": [2.0] * 3000,
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("ties", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    assert o.percentiles(df, ["g"], "v", SHARES).exceptAll(o.percentiles(df, ["g"], "v", SHARES, again=1)).isEmpty()
    got = {row["g"]: row for row in o.percentiles(df, ["g"], "v", SHARES, again=1).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        ordered = sorted(values)
        assert {name: got[g][name] for name in SHARES} == {name: ordered[math.ceil(s * len(ordered)) - 1] for name, s in SHARES.items()}
    middle = {row["g"]: row["median"] for row in o.medians(df, ["g"], "v", again=2).collect()}
    assert middle == {g: float(np.median(values)) for g, values in groups.items()}
    whole = o.medians(df, [], "v").first()["median"]
    assert whole == float(np.median([v for _, v in rows if v is not None]))


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert o.percentiles(df, ["g"], "v", SHARES).collect() == []
    assert o.medians(df, [], "v").collect() == []
