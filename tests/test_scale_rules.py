"""Plans and results under skew."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.catalog import derived, retrieval_queries
from lodestone.operators import chunking, context, cost, indexing, order_statistics, retrieval, running_median
from lodestone.sources import index_table
from lodestone.policies import EmbeddingSpec

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_limits_ranks_before_the_shuffle(spark):
    matches = spark.range(1000).selectExpr("id % 3 as query_id", "id", "rand(1) as score")
    plan = plan_of(retrieval.top_k(matches, 7))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_dedup_limits_ranks_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("concat('f', id % 2) as embedding_fingerprint", "cast(id as string) as id")
    assert plan_of(indexing.dedup_by_fingerprint(rows)).count("WindowGroupLimit") == 2


def test_chunking_shuffles_once(spark):
    docs = derived.markdown(spark, FOLDER).select("document_id", "content")
    assert plan_of(chunking.chunk_corpus(docs)).count("Exchange hashpartitioning") == 1


def test_search_filter_reaches_the_scan(spark, folder):
    spec = EmbeddingSpec("tables", "given", 64)
    rows = spark.range(20).selectExpr(
        "concat('c', id) as id",
        "named_struct('visibility', if(id % 2 = 0, 'public', 'internal'), 'document_id', 'd') as metadata",
        "transform(sequence(1, 64), x -> cast(x as double)) as embedding",
    )
    index_table.write_index(rows, folder, spec)
    stored = index_table.read_index(spark, folder)
    plan = plan_of(retrieval.public_only(stored).select("id"))
    assert "PushedFilters: [IsNotNull(metadata.visibility), EqualTo(metadata.visibility,public)]" in plan
    assert "embedding" not in plan.split("ReadSchema")[1]


def test_no_cartesian_products_in_retrieval(spark):
    for name in ("similarity_join", "score_retrieval", "sweep", "retrieval_failures"):
        plan = plan_of(retrieval_queries.QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0] * 50, [0.0] * 40 + [1e9], list(range(101))])
def test_order_statistics_small(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert order_statistics.medians(rows, [], "x").first().median == statistics.median(values)
    got = order_statistics.percentiles(rows, [], "x", {"p": 0.75}).first().p
    ordered = sorted(values)
    assert got == ordered[max(1, -(-3 * len(values) // 4)) - 1]


def test_order_statistics_with_a_hot_group(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 9)}", round(rng.lognormvariate(0, 3), 2)) for _ in range(5000)]
    rows = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r.median for r in order_statistics.medians(rows, ["g"], "x").collect()}
    for group in got:
        assert got[group] == pytest.approx(statistics.median([x for g, x in data if g == group]))


def test_an_outlier_does_not_crowd_a_range(spark):
    rows = spark.range(200_000).selectExpr("if(id = 0, 1e12, cast(id as double)) as x")
    middle = order_statistics.medians(rows, [], "x")
    assert middle.first().median == 100_000.5
    counts = rows.selectExpr("x as v")
    cuts = counts.agg(F.percentile_approx("v", [0.5 - order_statistics.AROUND, 0.5 + order_statistics.AROUND], order_statistics.ACCURACY)).first()[0]
    assert counts.filter((F.col("v") >= cuts[0]) & (F.col("v") < cuts[1])).count() <= 200_000 * 4 * order_statistics.AROUND


def test_calls_without_a_type_are_not_the_total(spark):
    columns = "call_type string, http_attempts int, attempt int, result string, input_tokens int, output_tokens int, elapsed_seconds double"
    rows = [("generation", 1, 1, "parsed", 5, 5, 1.0), (None, 1, 1, "parsed", 5, 5, 9.0), (None, 1, 1, "parsed", 5, 5, 9.0)]
    got = sorted((r.calls, r.median_elapsed) for r in cost.call_summary(spark.createDataFrame(rows, columns)).collect())
    assert got == [(1, 1.0), (2, 9.0), (3, 9.0)]


def test_the_running_median_of_the_guard():
    from lodestone.streaming.run_guard import Middle

    rng = random.Random(3)
    for spread in (2, 5, 1000):
        values = [float(rng.randint(-spread, spread)) for _ in range(200)]
        middle = Middle({})
        for n, value in enumerate(values, 1):
            middle.add(value)
            assert middle.median() == statistics.median(values[:n])
            assert Middle(dict(middle.counts)).median() == middle.median()


@pytest.mark.parametrize("kind", ["distinct", "ties", "rising", "one value"])
def test_running_medians_over_spans(spark, kind):
    rng = random.Random(9)
    draw = {
        "distinct": lambda n: rng.lognormvariate(0, 2), "ties": lambda n: float(rng.choice([1, 1, 1, 2, 3, 50])),
        "rising": lambda n: float(n), "one value": lambda n: 4.0,
    }[kind]
    data = [("long", n * 3, draw(n)) for n in range(1500)] + [("short", n, draw(n)) for n in range(7)] + [(None, 5, 2.0)]
    rows = spark.createDataFrame(data, "run_id string, position int, cost double").repartition(5)
    for span in (40, 1000, 10_000):
        got = {}
        for r in running_median.running(rows, span).collect():
            got.setdefault(r.run_id, []).append((r.position, r.seen, r.spent, r.own_median))
        for run in ("long", "short"):
            costs = [c for name, _, c in data if name == run]
            own = sorted(got[run])
            assert [(seen, median) for _, seen, _, median in own] == [(n, statistics.median(costs[:n])) for n in range(1, len(costs) + 1)]
            assert own[-1][2] == pytest.approx(sum(costs))
        assert got[None] == [(5, 1, 2.0, 2.0)]


def test_a_span_gets_little_of_a_long_run(spark):
    rows = spark.range(60_000).selectExpr("'r' as run_id", "id as position", "double(pmod(xxhash64(id), 1000000007)) as cost")
    spanned = rows.withColumn("_span", F.floor(F.col("position") / 1000).cast("long"))
    spans = spanned.groupBy("run_id", "_span").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n_before", F.col("_span") * 1000)
    near = running_median._around_the_middle(spanned, spans).groupBy("_span").agg(F.sum("c").alias("c"))
    assert near.agg(F.max("c")).first()[0] < 60_000 / 8


def test_streaks_do_not_depend_on_the_span(spark):
    rng = random.Random(2)
    data = [(1, n, rng.choice(["timeout", "timeout", None])) for n in range(400)] + [(2, n, "timeout") for n in range(50)]
    rows = spark.createDataFrame(data, "run_id int, position int, error_category string")
    whole = sorted(tuple(r) for r in cost.failure_streak(rows).select("run_id", "position", "streak").collect())
    for span in (1, 7, 64):
        cut = cost.failure_streak(rows, span=span).select("run_id", "position", "streak").collect()
        assert sorted(tuple(r) for r in cut) == whole
    assert whole[-1] == (2, 49, 50)


def test_blocks_that_cannot_help_are_skipped():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    data = np.concatenate([c + 0.05 * rng.normal(size=(200, 16)) for c in centres])
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    ids = np.array([f"r{n}" for n in range(len(data))], dtype=object)
    queries = data[rng.choice(len(data), 300, replace=False)]
    scan = retrieval.Scan(list(range(300)), queries, 5)
    for low in range(0, len(data), 100):
        scan.add(ids[low : low + 100], data[low : low + 100])
    assert scan.compared + scan.skipped == 300 * len(data) and scan.skipped > 0.5 * 300 * len(data)
    got = scan.result().groupby("query_id")["id"].apply(list).to_dict()
    scores = np.round(queries @ data.T, retrieval.SCORE_DIGITS)
    for n in range(300):
        assert got[n] == ids[np.lexsort((ids, -scores[n]))[:5]].tolist()


def test_nothing_runs_while_the_join_is_planned(spark):
    index = spark.range(50).selectExpr("id", "array(double(id), 1.0D) as embedding")
    # A query that fails when it runs.
    queries = spark.range(5).selectExpr("id as query_id", "array(double(raise_error('ran')), 1.0D) as embedding")
    found = retrieval.similarity_join(queries, index, 3, 2)
    with pytest.raises(Exception, match="ran"):
        found.collect()
    with pytest.raises(ValueError, match="more than 2 queries"):
        retrieval.similarity_join_few(index.withColumnRenamed("id", "query_id"), index, 3, most=2)
    empty = index.limit(0)
    assert retrieval.similarity_join(empty.withColumnRenamed("id", "query_id"), index, 3, 2).collect() == []
    assert retrieval.similarity_join(index.withColumnRenamed("id", "query_id"), empty, 3, 2).collect() == []


def test_blocks_of_queries_agree_with_ties(spark):
    data = [(n, [float(n % 5), 1.0, 0.0]) for n in range(300)] + [(999, [0.0, 0.0, 0.0])]
    index = spark.createDataFrame(data, "id long, embedding array<double>")
    queries = index.withColumnRenamed("id", "query_id")
    one = retrieval.similarity_join(queries, index, 4, 3).collect()
    two = retrieval.similarity_join(queries, index, 4, 3, query_blocks=3).collect()
    few = retrieval.similarity_join_few(queries, index, 4).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) == sorted(map(tuple, few))
    ties = sorted((r["rank"], r.id) for r in one if r.query_id == 0)
    assert [i for _, i in ties] == [0, 5, 10, 15]
    assert [r.score for r in one if r.query_id == 999] == [0.0] * 4


def test_a_very_long_conversation_is_refused(spark):
    turns = spark.range(2000).selectExpr(
        "if(id < 1990, 1, 2) as conv_id", "id as turn", "'user' as role", "'hello' as text"
    ).filter("conv_id = 1 or id < 1994")
    got = {r.conv_id: (r.error, r.kept) for r in context.bound_conversation(turns).collect()}
    assert got == {1: ("too_many_turns", None), 2: (None, 4)}


def test_invalid_vectors_refuse_the_write(spark, folder):
    spec = EmbeddingSpec("tables", "given", 2)
    good = spark.createDataFrame([("a", {"visibility": "public"}, [1.0, 0.0])], "id string, metadata struct<visibility:string>, embedding array<double>")
    bad = spark.createDataFrame([("b", {"visibility": "public"}, [1.0, float("inf")])], good.schema)
    assert index_table.write_index(good, folder, spec) == 1
    with pytest.raises(ValueError, match="non_finite_value"):
        index_table.write_index(good.union(bad), folder, spec)
    assert index_table.current_version(spark, folder) == 1
    assert [r.id for r in index_table.read_index(spark, folder).collect()] == ["a"]


def test_payload_round_trip(spark):
    from lodestone.catalog import index_queries as q

    index = q.actual(spark, FOLDER)
    columns = ["id", "embedding_fingerprint", "metadata", "embedding"]
    again = index_table.index_from_payload(index_table.index_payload(index), q.PAIR)
    fields = ["document_id", "title", "heading_path", "source_path", "visibility", "topics"]
    def rows(df):
        return sorted(map(repr, df.select("id", "embedding", *[F.col(f"metadata.{f}") for f in fields]).collect()))
    assert rows(again) == rows(index) and set(columns) <= set(again.columns)
