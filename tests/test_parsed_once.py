"""Decisions parse each reply once; white space at the ends of texts goes without a pattern."""

from pyspark.sql import functions as F

from lodestone.catalog import answer_queries
from lodestone.functions import text as t


def test_replies_are_parsed_once(spark):
    made = answer_queries.decisions(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "$.verdict" in plan and "$.answer" not in plan


def test_stripping_is_that_of_python(spark):
    ends = [chr(n) for n in range(0x11000) if not 0xD800 <= n < 0xE000]
    rows = spark.createDataFrame([(f"{c}{c}a{c}b{c}",) for c in ends] + [("",), (" \n",), (None,)], "text string")
    for row in rows.select("text", t.strip(F.col("text")).alias("s"), t.rstrip(F.col("text")).alias("r")).collect():
        assert row.s == (None if row.text is None else row.text.strip())
        assert row.r == (None if row.text is None else row.text.rstrip())
