"""Every registered search asks for each vector, against all public ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.catalog import file_queries, retrieval_queries
from lodestone.operators import retrieval

QUERIES = retrieval_queries.QUERIES | file_queries.QUERIES
ORACLE = retrieval_queries.ORACLE | file_queries.ORACLE
COUNT = 80


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("all_vectors")
    rows = spark.range(COUNT).select(
        F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"),
        F.transform(F.sequence(F.lit(1), F.lit(64)), lambda n: F.sin(F.col("id") * n).cast("float")).alias("embedding"),
    )
    rows.write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize(
    "name",
    ["similarity_join", "similarity_join_grid", "similarity_join_few", "resolve_chunks", "retrieval_outcome",
     "cap_per_document", "score_retrieval", "retrieval_export", "write_export"],
)
def test_all_are_asked(spark, folder, name):
    """With every twentieth vector as a query these were four."""
    assert {r.query_id for r in QUERIES[name](spark, folder).collect()} == set(range(COUNT))


@pytest.mark.parametrize("name", ["threshold_filter", "relevance", "retrieval_failures", "sources_lost"])
def test_others_than_each_twentieth_are_in(spark, folder, name):
    assert any(r.query_id % 20 for r in QUERIES[name](spark, folder).collect())


def test_all_are_counted(spark, folder):
    def total(name, column):
        return {r[column] for r in QUERIES[name](spark, folder).collect()}

    per_category = COUNT // len(retrieval_queries.CATEGORIES)
    answerable = per_category * len(retrieval_queries.k.ANSWERABLE_CATEGORIES)
    for name in ("hit_at_k", "retrieval_report"):
        assert total(name, "total") == {answerable}, name
    assert total("sweep", "answerable") == {answerable}
    assert total("threshold_rejections", "total") == {per_category}
    assert total("source_coverage", "expected") == {COUNT}


def test_no_sql_has_the_step():
    assert not [name for name, sql in ORACLE.items() if "q.id %" in sql or "vec_id % 20 " in sql]


def test_tasks_do_not_grow_with_the_blocks(spark):
    """Blocks of queries take the place of parts of the records: few copies of both."""
    index = spark.range(50).selectExpr("id", "array(double(id), 1.0D) as embedding")
    for blocks in (1, 3, 8, 100):
        found = retrieval.similarity_join(index.withColumnRenamed("id", "query_id"), index, 2, 2, blocks)
        assert found.count() == 100
        dealt = [line for line in found._jdf.queryExecution().toString().splitlines() if "RepartitionByExpression" in line]
        tasks = int(dealt[0].rsplit(",", 1)[1].strip(" )"))
        assert tasks <= max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_scores_closer_than_floats(spark):
    """Pairs are looked through in float32: what differs only beyond it is still ordered by its score."""
    turns = np.arange(3000) * 1e-8
    data = np.zeros((3000, 64))
    data[:, 0], data[:, 1] = np.cos(1 + turns), np.sin(1 + turns)
    asked = np.zeros((1, 64))
    asked[0, 0] = 1.0
    scan = retrieval.Scan([0], asked, 7)
    order = np.random.default_rng(4).permutation(3000)
    for low in range(0, 3000, 500):
        scan.add(order[low : low + 500], data[order[low : low + 500]])
    assert scan.result()["id"].tolist() == list(range(7))
