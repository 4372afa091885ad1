"""Replies made of documents without a text, and of texts that begin with a line end."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.catalog import answer_queries as q
from tests.compare import difference, spark_rows, sql_rows


def folder_of(spark, path, text):
    """One document of every shape of reply."""
    rows = spark.range(len(q.SHAPES)).select(
        F.col("id").alias("doc_id"), F.lit(text).cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")
    )
    rows.coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["parse_replies", "canonical_marks", "evidence_table", "truncated_replies", "resolve_citations"])
def test_no_text(spark, tmp_path, name):
    """The field of a missing text was left out, which broke the reply around it."""
    folder, con = folder_of(spark, tmp_path, None)
    assert difference(spark_rows(q.QUERIES[name](spark, folder)), sql_rows(con, q.ORACLE[name])) is None


@pytest.mark.parametrize("text", ["", "\nWords.", "\tWords."])
def test_an_answer_is_stripped_as_the_results_to_match_are(spark, tmp_path, text):
    folder, _ = folder_of(spark, tmp_path, text)
    answers = {r.answer for r in q.parsed(spark, folder).filter("rule IS NULL").collect()}
    assert answers == {"", (text + q.NAMED + " [S1], [S2; S9] 【s3】").strip()}
