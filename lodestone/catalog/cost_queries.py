"""Provider-call and budget queries: every event is one call, every user one run.

sign-ups are grounding checks, the rest generations; errors are provider errors and
report no tokens; questions of a run are its days.
"""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.catalog import derived as d
from lodestone.operators import cost
from lodestone.policies import BudgetPolicy, ContextPolicy, CostProfile
from lodestone.sources import runs

QUERIES, ORACLE = {}, {}
PROFILE = CostProfile("model-a", 31818.0, 68182.0)
POLICY = ContextPolicy()
BUDGET = BudgetPolicy()


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def calls(spark, folder):
    events = d.table(spark, folder, "events")
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    failed = F.col("event_type") == "error"
    return events.select(
        "event_id",
        F.col("user_id").alias("run_id"),
        F.dayofmonth("ts").alias("query_id"),
        F.when(F.col("event_type") == "signup", "grounding_check").otherwise("generation").alias("call_type"),
        F.when(F.col("event_id") % 7 == 0, 2).otherwise(1).alias("attempt"),
        F.when(F.col("user_id") % 10 == 0, "model-b").otherwise("model-a").alias("model"),
        F.when(failed, "provider_error").when(tokens % 10 == 0, "unusable_reply").otherwise("parsed").alias("result"),
        F.col("value").alias("elapsed_seconds"),
        F.when(~failed, tokens * 30).alias("input_tokens"),
        F.when(~failed, tokens * 4).alias("output_tokens"),
        F.when(F.col("event_id") % 7 == 0, 1500).otherwise(800).cast("bigint").alias("max_output_tokens"),
        F.when(failed, None).when(tokens > 90, "length").otherwise("stop").alias("finish_reason"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 4 + 1).cast("int").alias("http_attempts"),
        F.to_date("ts").alias("date_utc"),
    )


SQL_CALLS = """calls AS (
  SELECT event_id, user_id AS run_id, day(ts) AS query_id, CASE WHEN event_type = 'signup' THEN 'grounding_check' ELSE 'generation' END AS call_type,
    CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS attempt, CASE WHEN user_id % 10 = 0 THEN 'model-b' ELSE 'model-a' END AS model,
    CASE WHEN event_type = 'error' THEN 'provider_error' WHEN t % 10 = 0 THEN 'unusable_reply' ELSE 'parsed' END AS result,
    value AS elapsed_seconds, CASE WHEN event_type <> 'error' THEN t * 30 END AS input_tokens,
    CASE WHEN event_type <> 'error' THEN t * 4 END AS output_tokens, CASE WHEN event_id % 7 = 0 THEN 1500 ELSE 800 END AS max_output_tokens,
    CASE WHEN event_type = 'error' THEN NULL WHEN t > 90 THEN 'length' ELSE 'stop' END AS finish_reason,
    CASE WHEN event_id % 3 <> 0 THEN event_id % 4 + 1 END AS http_attempts, ts::DATE AS date_utc
  FROM (SELECT *, (props->>'$.k')::BIGINT AS t FROM events))"""


def sql(body: str, *extra: str) -> str:
    return "WITH " + ",\n".join((SQL_CALLS, *extra)) + "\n" + body


@query(
    "call_summary",
    sql(
        """SELECT call_type, count(*) AS calls, sum(http_attempts)::BIGINT AS http_attempts, count(http_attempts) AS http_attempts_reported,
          count(*) FILTER (call_type = 'generation' AND attempt > 1) AS regenerations, count(*) FILTER (result = 'parsed') AS parsed,
          count(*) FILTER (result = 'unusable_reply') AS unusable_reply, count(*) FILTER (result = 'provider_error') AS provider_error,
          count(input_tokens) AS usage_reported, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
          round(max(elapsed_seconds), 3) AS max_elapsed, round(median(elapsed_seconds), 3) AS median_elapsed
        FROM calls GROUP BY GROUPING SETS ((), (call_type))"""
    ).replace("count(*) FILTER (call_type = 'generation' AND attempt > 1)", "count(*) FILTER (is_gen AND attempt > 1)").replace(
        "FROM calls GROUP BY", "FROM (SELECT *, call_type = 'generation' AS is_gen FROM calls) GROUP BY"
    ),
)
def call_summary(spark, folder):
    return cost.call_summary(calls(spark, folder))


@query(
    "finish_reason_histogram",
    sql("SELECT coalesce(finish_reason, 'none') AS finish_reason, count(*) AS calls FROM calls GROUP BY 1"),
)
def finish_reason_histogram(spark, folder):
    return cost.finish_reason_histogram(calls(spark, folder))


@query(
    "recovery_evidence",
    sql(
        """SELECT count(*) FILTER (attempt > 1 AND call_type = 'generation') AS generation_recoveries,
          count(*) FILTER (attempt > 1 AND call_type = 'grounding_check') AS grounding_recoveries, max(max_output_tokens) FILTER (attempt > 1)::BIGINT AS largest_cap,
          count(*) FILTER (attempt > 1 AND max_output_tokens = 1500 AND result = 'parsed') > 0 AS live_validated,
          count(*) FILTER (attempt > 1) > 0 AS recovery_triggered FROM calls"""
    ),
)
def recovery_evidence(spark, folder):
    return cost.recovery_evidence(calls(spark, folder), POLICY.recovery_output_tokens)


@query(
    "nearest_rank_percentile",
    sql("SELECT call_type, quantile_disc(elapsed_seconds, 0.9) AS percentile FROM calls GROUP BY call_type"),
)
def nearest_rank_percentile(spark, folder):
    return cost.nearest_rank_percentile(calls(spark, folder), ["call_type"], "elapsed_seconds", 0.9, again=1)


SQL_ROBUST = """robust AS (
  SELECT call_type, greatest(any_value(i75), avg(least(input_tokens, i90))) AS input_tokens, greatest(any_value(o75), avg(least(output_tokens, o90))) AS output_tokens
  FROM calls JOIN (SELECT call_type, quantile_disc(input_tokens, 0.75) AS i75, quantile_disc(input_tokens, 0.9) AS i90,
      quantile_disc(output_tokens, 0.75) AS o75, quantile_disc(output_tokens, 0.9) AS o90 FROM calls GROUP BY call_type) USING (call_type)
  WHERE input_tokens IS NOT NULL GROUP BY call_type)"""


@query("robust_cost", sql("SELECT call_type, input_tokens FROM robust", SQL_ROBUST))
def robust_cost(spark, folder):
    measured = calls(spark, folder).filter(cost.usage_reported())
    return cost.robust_cost(measured, ["call_type"], "input_tokens")


SQL_COVERAGE = """coverage AS (
  SELECT *, CASE WHEN least(generation_samples, grounding_samples) >= 30 AND coverage >= 0.95 THEN 'high'
    WHEN least(generation_samples, grounding_samples) >= 5 AND coverage >= 0.8 THEN 'medium' ELSE 'low' END AS confidence FROM (
    SELECT count(*) AS calls, count(input_tokens) / count(*) AS coverage, count(input_tokens) FILTER (call_type = 'generation') AS generation_samples,
      count(input_tokens) FILTER (call_type = 'grounding_check') AS grounding_samples FROM calls))"""


@query("usage_coverage", sql("SELECT * FROM coverage", SQL_COVERAGE))
def usage_coverage(spark, folder):
    return cost.usage_coverage(calls(spark, folder))


def _forecast(margin: str, low: str) -> str:
    price = "({i} * 31818.0::DOUBLE + {o} * 68182.0::DOUBLE) / 1000000"
    bound = price.format(i="5200", o="800")
    recovery = price.format(i="5200", o="1500")
    generation = f"CASE WHEN {low} THEN {bound} + 0.2 * {recovery} ELSE {margin} * gens * {price.format(i='gi', o='go')} END"
    checks = f"CASE WHEN {low} THEN {bound} ELSE {margin} * checks * {price.format(i='ci', o='co')} END"
    return (
        f"SELECT 24 AS questions, confidence, round(24 * ({generation}), 6) AS generation_cost, round(24 * ({checks}), 6) AS grounding_cost, "
        f"round(24 * (({generation}) + ({checks})), 6) AS cost, round(24 * CASE WHEN {low} THEN 1.2 ELSE gens END, 6) AS generation_calls FROM facts"
    )


SQL_FACTS = """facts AS (
  SELECT confidence, gens, checks, gi, go, ci, co FROM coverage,
    (SELECT count(*) FILTER (call_type = 'generation') / count(DISTINCT (run_id, query_id)) AS gens,
       1.0 + count(*) FILTER (call_type = 'grounding_check' AND attempt > 1) / count(*) FILTER (call_type = 'grounding_check' AND attempt = 1) AS checks FROM calls),
    (SELECT max(input_tokens) FILTER (call_type = 'generation') AS gi, max(output_tokens) FILTER (call_type = 'generation') AS go,
       max(input_tokens) FILTER (call_type = 'grounding_check') AS ci, max(output_tokens) FILTER (call_type = 'grounding_check') AS co FROM robust))"""


def _forecast_columns(forecast):
    names = ("generation_cost", "grounding_cost", "cost", "generation_calls")
    return forecast.select("questions", "confidence", *[F.round(n, 6).alias(n) for n in names])


@query(
    "forecast_run",
    sql(_forecast("1.25", "confidence = 'low'"), SQL_ROBUST, SQL_COVERAGE, SQL_FACTS),
)
def forecast_run(spark, folder):
    """F26 from all calls: coverage is near its lower limit, so either branch may apply."""
    return _forecast_columns(cost.forecast_run(calls(spark, folder), 24, PROFILE, POLICY))


@query(
    "forecast_run_measured",
    sql(_forecast("1.1", "confidence = 'low'"), "reported AS (SELECT * FROM calls WHERE input_tokens IS NOT NULL)", SQL_ROBUST,
        SQL_COVERAGE.replace("FROM calls", "FROM reported"), SQL_FACTS.replace("FROM calls", "FROM reported")),
)
def forecast_run_measured(spark, folder):
    """The same over calls that report usage: high confidence."""
    measured = calls(spark, folder).filter(cost.usage_reported())
    return _forecast_columns(cost.forecast_run(measured, 24, PROFILE, POLICY))


SQL_PRICED = """priced AS (
  SELECT *, CASE WHEN input_tokens IS NULL THEN (5200 * 31818.0::DOUBLE + max_output_tokens * 68182.0::DOUBLE) / 1000000
    ELSE (input_tokens * 31818.0::DOUBLE + output_tokens * 68182.0::DOUBLE) / 1000000 END AS cost FROM calls WHERE model = 'model-a')"""


@query("call_cost", sql("SELECT event_id, round(cost, 6) AS cost FROM priced", SQL_PRICED))
def call_cost(spark, folder):
    priced = cost.call_cost(calls(spark, folder), PROFILE, POLICY)
    return priced.select("event_id", F.round("cost", 6).alias("cost"))


@query(
    "spent",
    sql("SELECT run_id, round(sum(cost), 5) AS cost, count(*) FILTER (input_tokens IS NULL) AS unreported_calls FROM priced GROUP BY run_id", SQL_PRICED),
)
def spent(spark, folder):
    return cost.spent(calls(spark, folder), PROFILE, ["run_id"], POLICY).withColumn("cost", F.round("cost", 5))


def ledger(spark, folder):
    """One ledger line per run and day."""
    priced = cost.call_cost(calls(spark, folder), PROFILE, POLICY)
    return priced.groupBy("run_id", "date_utc").agg(F.sum("cost").alias("estimated_cost"))


@query("daily_consumption", sql("SELECT date_utc, round(sum(cost), 4) AS cost FROM priced GROUP BY date_utc", SQL_PRICED))
def daily_consumption(spark, folder):
    return cost.daily_consumption(ledger(spark, folder)).withColumn("cost", F.round("cost", 4))


@query(
    "budget_zone",
    sql(
        """SELECT run_id, date_utc, CASE WHEN s <= 0.4 THEN 'target' WHEN s <= 0.5 THEN 'good' WHEN s <= 0.7 THEN 'caution' ELSE 'excessive' END AS band,
          CASE WHEN known + f > 6000 OR s > 0.7 THEN 'red' WHEN f > 5000 THEN 'yellow' ELSE 'green' END AS zone
        FROM (SELECT run_id, date_utc, c * 10 AS f, c * 10 / 10000.0 AS s, run_id % 7 * 1000 AS known FROM (
          SELECT run_id, date_utc, sum(cost) AS c FROM priced GROUP BY ALL))""",
        SQL_PRICED,
    ),
)
def budget_zone(spark, folder):
    """F29 for ten times each run's daily cost beside what is already known."""
    forecast = F.col("estimated_cost") * 10
    rows = ledger(spark, folder)
    return rows.select(
        "run_id", "date_utc", cost.cost_band(forecast, BUDGET.daily_budget).alias("band"),
        cost.budget_zone(forecast, F.col("run_id") % 7 * 1000, BUDGET).alias("zone"),
    )


def records(spark, folder):
    """Guard records: one per call, in event order."""
    events = d.table(spark, folder, "events")
    category = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "view", "unparseable_output")
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("position"), category.alias("error_category"),
        F.col("value").alias("cost"),
    )


SQL_STREAK = """SELECT run_id, position, streak, streak >= 2 AS stops FROM (
  SELECT run_id, position, CASE WHEN t THEN sum(t::INT) OVER (PARTITION BY run_id, island ORDER BY position) ELSE 0 END AS streak FROM (
    SELECT *, sum((NOT t)::INT) OVER (PARTITION BY run_id ORDER BY position) AS island FROM (
      SELECT user_id AS run_id, event_id AS position, event_type = 'error' AS t FROM events)))"""


@query("failure_streak", SQL_STREAK)
def failure_streak(spark, folder):
    return cost.failure_streak(records(spark, folder)).select("run_id", "position", "streak", "stops")


@query("failure_streak_spans", SQL_STREAK)
def failure_streak_spans(spark, folder):
    """The same with runs cut into short spans: what crosses an edge is carried over."""
    return cost.failure_streak(records(spark, folder), span=500).select("run_id", "position", "streak", "stops")


SQL_PROJECTED = """SELECT run_id, position, seen, round(projected, 6) AS projected, CASE WHEN projected / 10000 <= 0.4 THEN 'target' WHEN projected / 10000 <= 0.5 THEN 'good'
    WHEN projected / 10000 <= 0.7 THEN 'caution' ELSE 'excessive' END AS band, spent > 6000 OR (seen >= 3 AND projected > 6000) AS over_budget FROM (
  SELECT *, spent + greatest(400 - seen, 0) * (seen / (seen + 5) * own + (1 - seen / (seen + 5)) * 20.0) AS projected FROM (
    SELECT user_id AS run_id, event_id AS position, row_number() OVER w AS seen, sum(value) OVER w AS spent, median(value) OVER w AS own
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)))"""


@query("projected_cost", SQL_PROJECTED)
def projected_cost(spark, folder):
    done = cost.projected_cost(records(spark, folder), 400, 20.0, BUDGET)
    return done.select("run_id", "position", "seen", F.round("projected", 6).alias("projected"), "band", "over_budget")


@query("projected_cost_spans", SQL_PROJECTED)
def projected_cost_spans(spark, folder):
    """The same with runs cut into short spans, each with what it needs of those before."""
    done = cost.projected_cost(records(spark, folder), 400, 20.0, BUDGET, span=700)
    return done.select("run_id", "position", "seen", F.round("projected", 6).alias("projected"), "band", "over_budget")


# --- ledger lines -----------------------------------------------------------------------
def ledger_lines(spark, folder):
    """Every event as one ledger line; some lines are damaged, blank or incomplete."""
    events = d.table(spark, folder, "events")
    entry = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd").alias("date_utc"),
            F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
            F.when(F.col("event_type") == "signup", "acceptance").otherwise("smoke").alias("tier"),
            F.when(F.col("event_type") == "error", "aborted").otherwise("complete").alias("status"),
            F.col("value").alias("estimated_cost"),
            F.concat(F.lit("logical-"), F.col("user_id").cast("string")).alias("logical_run_id"),
            (F.col("event_id") % 3 + 1).alias("segment"),
        )
    )
    line = (
        F.when(F.col("event_id") % 97 == 1, F.substring(entry, F.lit(1), F.length(entry) - 7))
        .when(F.col("event_id") % 97 == 2, "  ")
        .when(F.col("event_id") % 97 == 3, '{"note": "no entry"}')
        .otherwise(entry)
    )
    return events.select(F.col("event_id").alias("line_no"), line.alias("line"))


def read_lines(spark, folder):
    return runs.parse_ledger(ledger_lines(spark, folder))


@query(
    "read_ledger",
    "SELECT event_id AS line_no, event_id % 97 IN (1, 3) AS damaged, CASE WHEN event_id % 97 NOT IN (1, 3) THEN 'run-' || event_id END AS run_id "
    "FROM events WHERE event_id % 97 <> 2",
)
def read_ledger(spark, folder):
    """A7 over lines; what a damaged line still holds is not used."""
    rows = read_lines(spark, folder)
    return rows.select("line_no", "damaged", F.when(~F.col("damaged"), F.col("run_id")).alias("run_id"))


@query(
    "ledger_health",
    "SELECT count(*) FILTER (event_id % 97 NOT IN (1, 2, 3)) AS entries, count(*) FILTER (event_id % 97 IN (1, 3)) AS unreadable_lines FROM events",
)
def ledger_health(spark, folder):
    return runs.ledger_health(read_lines(spark, folder))


@query(
    "forecast_age",
    sql(
        "SELECT run_id, date_diff('day', max(date_utc), DATE '2024-02-12') > 14 AS stale FROM calls GROUP BY run_id"
    ),
)
def forecast_age(spark, folder):
    """Whether the newest call of a run is too old for a confident forecast."""
    newest = calls(spark, folder).groupBy("run_id").agg(F.max("date_utc").alias("newest"))
    age = F.date_diff(F.lit(datetime.date(2024, 2, 12)), "newest")
    return newest.select("run_id", (age > k.PROFILE_MAX_AGE_DAYS).alias("stale"))
