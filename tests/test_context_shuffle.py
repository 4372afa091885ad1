"""Passages are dealt by query once, for the decisions and for the summary."""

from lodestone.operators import context


def test_texts_are_dealt_by_query_only(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(40).selectExpr(
            "id div 4 as query_id", "id % 4 as position", "concat('d', id % 3) as id", "'t' as title",
            "cast(array() as array<string>) as heading_path", "repeat('x ', 30) as content",
        )
        budgets = spark.range(10).selectExpr("id as query_id", "id * 20 as available_tokens")
        done = context.context_summary(context.pack_context(rows, budgets))
        plan = done._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert dealt and not any(", position" in line for line in dealt)
        assert {r.query_id: (r.sources, r.duplicates_removed, r.skipped_for_budget) for r in done.collect()}[0] == (0, 0, 4)
        assert done.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
