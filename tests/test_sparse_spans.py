"""Runs whose rows lie far apart have few spans."""

import statistics

from pyspark.sql import functions as F

from lodestone.operators import running_median


def test_sparse_runs_have_few_spans(spark):
    rows = spark.range(20_000).selectExpr("id % 50 as run_id", "id as position", "double(pmod(xxhash64(id), 1009)) as cost")
    celled = rows.withColumn("_cell", F.floor(F.col("position") / 100).cast("long"))
    spans = running_median._in_spans(celled, 100).groupBy("run_id", "_span").agg(F.count(F.lit(1)).alias("n"))
    found = spans.agg(F.count(F.lit(1)).alias("spans"), F.max("n").alias("most")).first()
    assert found.spans <= 50 * (400 // 100 + 1) and found.most <= 200
    got = running_median.running(rows, 100).filter("run_id = 7").orderBy("position").collect()
    costs = [r.cost for r in got]
    assert [r.own_median for r in got] == [statistics.median(costs[: n + 1]) for n in range(400)]


def test_rows_without_a_position_or_run(spark):
    data = [("a", None, 9.0), ("a", 5, 1.0), ("a", 900, 2.0), (None, 3, 4.0), (None, None, 6.0)]
    rows = spark.createDataFrame(data, "run_id string, position int, cost double")
    for span in (1, 10, 1000):
        got = sorted((str(r.run_id), r.seen, r.own_median) for r in running_median.running(rows, span).collect())
        assert [g for g in got if g[0] == "a"] == [("a", 1, 9.0), ("a", 2, 5.0), ("a", 3, 2.0)]
        assert [g[1] for g in got if g[0] == "None"] == [1, 2]
