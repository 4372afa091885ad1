"""Provider calls: summaries, forecasts, prices, budgets and run guards.

Calls: run_id, query_id, call_type (generation / grounding_check), attempt, model,
result (parsed / unusable_reply / provider_error), elapsed_seconds, input_tokens,
output_tokens, max_output_tokens, finish_reason, http_attempts. Null tokens mean
"not reported" and stay null through every sum.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.operators import order_statistics, running_median
from lodestone.policies import BudgetPolicy, ContextPolicy, CostProfile

def usage_reported() -> Column:
    return F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()


def call_summary(calls: DataFrame) -> DataFrame:
    """Totals and per call type in one pass (grouping sets); the total has a null type."""
    reported = usage_reported()
    aggregates = [
        F.count(F.lit(1)).alias("calls"),
        F.sum("http_attempts").alias("http_attempts"),
        F.count("http_attempts").alias("http_attempts_reported"),
        F.count_if((F.col("call_type") == "generation") & (F.col("attempt") > 1)).alias("regenerations"),
        F.count_if(F.col("result") == "parsed").alias("parsed"),
        F.count_if(F.col("result") == "unusable_reply").alias("unusable_reply"),
        F.count_if(F.col("result") == "provider_error").alias("provider_error"),
        F.count_if(reported).alias("usage_reported"),
        F.sum(F.when(reported, F.col("input_tokens"))).alias("input_tokens"),
        F.sum(F.when(reported, F.col("output_tokens"))).alias("output_tokens"),
        F.round(F.max("elapsed_seconds"), 3).alias("max_elapsed"),
    ]
    # Calls without a type are a group of their own beside the total.
    kind = F.coalesce(F.concat(F.lit("="), "call_type"), F.lit("none"))
    totals = calls.rollup("call_type").agg(
        *aggregates, F.when(F.grouping("call_type") == 1, "all").otherwise(kind).alias("_kind")
    )
    per_type = order_statistics.medians(calls.withColumn("_kind", kind), ["_kind"], "elapsed_seconds")
    overall = order_statistics.medians(calls, [], "elapsed_seconds").withColumn("_kind", F.lit("all"))
    middle = per_type.unionByName(overall).withColumn("median_elapsed", F.round("median", 3)).drop("median")
    return totals.join(middle, "_kind", "left").drop("_kind")


def finish_reason_histogram(calls: DataFrame) -> DataFrame:
    reason = F.coalesce("finish_reason", F.lit("none")).alias("finish_reason")
    return calls.groupBy(reason).agg(F.count(F.lit(1)).alias("calls"))


def recovery_evidence(calls: DataFrame, recovery_cap: int) -> DataFrame:
    recovery = F.col("attempt") > 1
    worked = recovery & (F.col("max_output_tokens") == recovery_cap) & (F.col("result") == "parsed")
    return calls.agg(
        F.count_if(recovery & (F.col("call_type") == "generation")).alias("generation_recoveries"),
        F.count_if(recovery & (F.col("call_type") == "grounding_check")).alias("grounding_recoveries"),
        F.max(F.when(recovery, F.col("max_output_tokens"))).alias("largest_cap"),
        (F.count_if(worked) > 0).alias("live_validated"),
    ).withColumn(
        "recovery_triggered", F.col("generation_recoveries") + F.col("grounding_recoveries") > 0
    )


def nearest_rank_percentile(
    values: DataFrame, keys: list[str], value: str, share: float, again: int = 0
) -> DataFrame:
    """An occurring value, never interpolated, per group; *again* cuts more for very large groups."""
    return order_statistics.percentiles(values, keys, value, {"percentile": share}, again)


def robust_cost(values: DataFrame, keys: list[str], column: str, again: int = 0) -> DataFrame:
    """max(p75, mean capped at p90) per group, as column *column*; *again* as for percentiles."""
    edges = order_statistics.percentiles(values, keys, column, {"_p75": 0.75, "_p90": 0.9}, again)
    joined = values.select(*keys, column).join(edges, keys)
    capped_mean = F.avg(F.least(F.col(column).cast("double"), F.col("_p90")))
    return joined.groupBy(*keys).agg(F.greatest(F.max("_p75"), capped_mean).alias(column))


def usage_coverage(calls: DataFrame) -> DataFrame:
    """Share of calls that report tokens, and the forecast confidence it allows."""
    reported = usage_reported()
    counts = calls.agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg(reported.cast("int")).alias("coverage"),
        F.count_if(reported & (F.col("call_type") == "generation")).alias("generation_samples"),
        F.count_if(reported & (F.col("call_type") == "grounding_check")).alias("grounding_samples"),
    )
    return counts.withColumn("confidence", confidence())


def confidence() -> Column:
    """Over the columns of usage_coverage."""
    samples = F.least("generation_samples", "grounding_samples")

    def reaches(n: int, share: float) -> Column:
        return (samples >= n) & (F.col("coverage") >= share)

    return (
        F.when(reaches(k.HIGH_SAMPLES, k.HIGH_COVERAGE), "high")
        .when(reaches(k.MEDIUM_SAMPLES, k.MEDIUM_COVERAGE), "medium")
        .otherwise("low")
    )


def forecast_run(
    calls: DataFrame,
    questions: int,
    profile: CostProfile,
    policy: ContextPolicy = ContextPolicy(),
    notes: int = 0,
    newest: date | None = None,
    today: date | None = None,
) -> DataFrame:
    """One row: what *questions* questions will cost, from the call history.

    Robust tokens per call times observed calls per question, with a margin by
    confidence; with too little measured usage the structural upper bound.
    """
    age = (today - newest).days if today and newest else None
    dated = age is not None and age > k.PROFILE_MAX_AGE_DAYS
    base = usage_coverage(calls)
    level = (
        F.when((F.col("confidence") == "high") & F.lit(bool(notes) or dated), "medium")
        .otherwise(F.col("confidence"))
    )
    rates = calls.groupBy("run_id", "query_id").agg(
        F.count_if(F.col("call_type") == "generation").alias("generations"),
        F.count_if((F.col("call_type") == "grounding_check") & (F.col("attempt") == 1)).alias("first_checks"),
        F.count_if((F.col("call_type") == "grounding_check") & (F.col("attempt") > 1)).alias("more_checks"),
    ).agg(
        (F.sum("generations") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("generations"),
        F.coalesce(
            F.sum("more_checks") / F.nullif(F.sum("first_checks"), F.lit(0)) + 1.0, F.lit(1.0)
        ).alias("checks"),
    )
    measured = calls.filter(usage_reported())
    tokens = robust_cost(measured, ["call_type"], "input_tokens").join(
        robust_cost(measured, ["call_type"], "output_tokens"), "call_type"
    )
    per_type = tokens.agg(
        *[
            F.coalesce(F.max(F.when(F.col("call_type") == kind, F.col(c))), F.lit(0.0)).alias(f"{kind}_{c}")
            for kind in ("generation", "grounding_check")
            for c in ("input_tokens", "output_tokens")
        ]
    )
    # Three single-row aggregates put side by side.
    row = base.join(rates, F.lit(True)).join(per_type, F.lit(True)).withColumn("confidence", level)
    low = F.col("confidence") == "low"
    margin = 1 + F.when(F.col("confidence") == "high", k.HIGH_MARGIN).otherwise(k.MEDIUM_MARGIN)
    again = k.FALLBACK_REGENERATION_RATE
    per_call = profile.call_bound(policy)
    per_recovery = profile.call_bound(policy, policy.recovery_output_tokens)

    def price(kind: str) -> Column:
        return (
            F.col(f"{kind}_input_tokens") * profile.input_per_million
            + F.col(f"{kind}_output_tokens") * profile.output_per_million
        ) / 1_000_000

    generation = F.when(low, per_call + again * per_recovery).otherwise(
        margin * F.col("generations") * price("generation")
    )
    grounding = F.when(low, per_call).otherwise(margin * F.col("checks") * price("grounding_check"))

    def volume(column: str) -> Column:
        both = F.col("generations") * F.col(f"generation_{column}") + F.col("checks") * F.col(
            f"grounding_check_{column}"
        )
        return F.when(~low, questions * margin * both)

    n = F.lit(questions)
    return row.select(
        n.alias("questions"),
        "confidence",
        "coverage",
        (n * F.when(low, 1 + again).otherwise(F.col("generations"))).alias("generation_calls"),
        (n * F.when(low, 1.0).otherwise(F.col("checks"))).alias("grounding_calls"),
        (n * F.when(low, again).otherwise(F.greatest(F.col("generations") - 1, F.lit(0.0)))).alias("regeneration_calls"),
        volume("input_tokens").alias("input_tokens"),
        volume("output_tokens").alias("output_tokens"),
        (n * generation).alias("generation_cost"),
        (n * grounding).alias("grounding_cost"),
        (n * (generation + grounding)).alias("cost"),
        (generation + grounding).alias("cost_per_question"),
        F.lit(age).cast("int").alias("profile_age_days"),
    )


def call_cost(calls: DataFrame, profile: CostProfile, policy: ContextPolicy = ContextPolicy()) -> DataFrame:
    """Calls of the priced model with *cost*: reported tokens, else the structural bound."""
    reported = (
        F.col("input_tokens") * profile.input_per_million
        + F.col("output_tokens") * profile.output_per_million
    ) / 1_000_000
    prompt = policy.max_prompt_tokens - policy.output_reserve_tokens
    out = F.coalesce("max_output_tokens", F.lit(policy.output_reserve_tokens))
    bound = (prompt * profile.input_per_million + out * profile.output_per_million) / 1_000_000
    return (
        calls.filter(F.col("model") == profile.model)
        .withColumn("reported", usage_reported())
        .withColumn("cost", F.when(F.col("reported"), reported).otherwise(bound))
    )


def spent(calls: DataFrame, profile: CostProfile, keys: list[str], policy: ContextPolicy = ContextPolicy()) -> DataFrame:
    priced = call_cost(calls, profile, policy)
    return priced.groupBy(*keys).agg(
        F.sum("cost").alias("cost"), F.count_if(~F.col("reported")).alias("unreported_calls")
    )


def daily_consumption(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("date_utc").agg(F.sum("estimated_cost").alias("cost"))


def cost_band(cost: Column, daily_budget: float) -> Column:
    share = cost / F.lit(daily_budget)
    band = F.when(share <= k.COST_BANDS[0][0], k.COST_BANDS[0][1])
    for limit, name in k.COST_BANDS[1:]:
        band = band.when(share <= limit, name)
    return band.otherwise("excessive")


def budget_zone(
    forecast: Column, known: Column, policy: BudgetPolicy = BudgetPolicy(), reserve_overridden: bool = False
) -> Column:
    return (
        F.when(known + forecast > policy.ceiling(reserve_overridden), "red")
        .when(cost_band(forecast, policy.daily_budget) == "excessive", "red")
        .when(forecast > policy.target_share * policy.daily_budget, "yellow")
        .otherwise("green")
    )


# --- run guards ---------------------------------------------------------------
STREAK_SPAN = 1_000_000


def failure_streak(records: DataFrame, span: int = STREAK_SPAN) -> DataFrame:
    """Consecutive transient failures up to each record: gaps and islands per run.

    records(run_id, position, error_category). *stops* marks a streak of two. A run is
    cut into spans of positions that are counted apart; what reaches over the edge of a
    span is carried in afterwards, so one long run is not one task.
    """
    transient = F.coalesce(F.col("error_category").isin(list(k.TRANSIENT_CATEGORIES)), F.lit(False))
    in_span = (
        Window.partitionBy("run_id", "_span")
        .orderBy("position")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    island = Window.partitionBy("run_id", "_span", "_island").orderBy("position").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = (
        records.withColumn("_t", transient)
        .withColumn("_span", F.floor(F.col("position") / span))
        .withColumn("_island", F.sum((~F.col("_t")).cast("int")).over(in_span))
        .withColumn("_local", F.sum(F.col("_t").cast("int")).over(island))
    )
    ends = local.groupBy("run_id", "_span").agg(
        F.max_by("_local", "position").alias("_tail"), F.max("_island").alias("_resets")
    )
    spans = (
        Window.partitionBy("run_id")
        .orderBy("_span")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    linked = (
        Window.partitionBy("run_id", "_chain")
        .orderBy("_span")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carry = (
        ends.withColumn("_chain", F.sum((F.col("_resets") > 0).cast("int")).over(spans))
        .withColumn("_through", F.sum("_tail").over(linked))
        .withColumn("_in", F.lag("_through", 1, 0).over(Window.partitionBy("run_id").orderBy("_span")))
        .select("run_id", "_span", "_in")
    )
    streak = F.col("_local") + F.when(F.col("_island") == 0, F.col("_in")).otherwise(0)
    return (
        local.join(carry, ["run_id", "_span"])
        .withColumn("streak", F.when(F.col("_t"), streak).otherwise(0))
        .withColumn("stops", F.col("streak") >= k.SYSTEMIC_STREAK)
        .drop("_t", "_island", "_local", "_span", "_in")
    )


def projected_cost(
    costs: DataFrame,
    total_questions: int,
    forecast_per_question: float,
    policy: BudgetPolicy = BudgetPolicy(),
    known: float = 0.0,
    reserve_overridden: bool = False,
    span: int = running_median.SPAN,
) -> DataFrame:
    """After every question: what the whole run will have cost, and whether to stop.

    costs(run_id, position, cost). The rate blends the median of the run's own
    questions with the forecast, own weight n / (n + 5). A run is cut into spans of
    *span* positions that go to different tasks; see `running_median`.
    """
    running = running_median.running(costs, span)
    weight = F.col("seen") / (F.col("seen") + k.GUARD_PRIOR_WEIGHT)
    rate = weight * F.col("own_median") + (1 - weight) * forecast_per_question
    remaining = F.greatest(F.lit(total_questions) - F.col("seen"), F.lit(0))
    ceiling = policy.ceiling(reserve_overridden)
    over = (F.lit(known) + F.col("spent") > ceiling) | (
        (F.col("seen") >= k.GUARD_MIN_QUESTIONS) & (F.lit(known) + F.col("projected") > ceiling)
    )
    return (
        running.withColumn("projected", F.col("spent") + remaining * rate)
        .withColumn("band", cost_band(F.col("projected"), policy.daily_budget))
        .withColumn("over_budget", over)
    )
