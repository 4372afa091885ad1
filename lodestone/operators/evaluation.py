"""Retrieval quality, answer records, gates and metrics.

Questions: query_id, category. Expected sources: query_id, document, section.
Hits: query_id, position, document_id, heading_path, visibility.
Records: one row per question with outcome (null after an error), answer,
citations, verified_citations, cites_expected_source, unknown_labels, failures,
retrieval_observed, error_category, duration_seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.functions import marks
from lodestone.functions import text as t
from lodestone.operators import order_statistics


def expects_answer(category: Column) -> Column:
    return category.isin(list(k.ANSWERABLE_CATEGORIES))


def must_refuse(category: Column) -> Column:
    return category.isin(list(k.MUST_REFUSE_CATEGORIES))


# --- retrieval ----------------------------------------------------------------
def relevance(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with *relevant*: an expected source names the document and, if given, its section.

    The expected side is grouped per (query, document) first, so every hit meets one row.
    """
    wanted = expected.groupBy("query_id", F.col("document").alias("document_id")).agg(
        F.bool_or(F.col("section").isNull()).alias("_whole"),
        F.collect_set("section").alias("_sections"),
    )
    joined = hits.join(wanted, ["query_id", "document_id"], "left")
    matched = F.coalesce(
        F.col("_whole") | F.arrays_overlap("heading_path", "_sections"), F.lit(False)
    )
    return joined.withColumn("relevant", matched).drop("_whole", "_sections")


def score_retrieval(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """Per question: retrieved, first_relevant_rank, leaked_internal. Empty ones stay."""
    per_query = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.min(F.when(F.col("relevant"), F.col("position"))).alias("first_relevant_rank"),
        F.bool_or(F.col("visibility") != "public").alias("leaked_internal"),
    )
    return (
        questions.join(per_query, "query_id", "left")
        .withColumn("retrieved", F.coalesce("retrieved", F.lit(0)))
        .withColumn("leaked_internal", F.coalesce("leaked_internal", F.lit(False)))
    )


def hit_at_k(scores: DataFrame, cutoffs: Sequence[int] = k.HIT_CUTOFFS) -> DataFrame:
    """One row per cut-off: correct and total over the answerable questions."""
    answerable = scores.filter(expects_answer(F.col("category")))
    counts = answerable.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("first_relevant_rank") <= n).alias(f"c{n}") for n in cutoffs],
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("cutoff"), F.col(f"c{n}").alias("correct")) for n in cutoffs]
    )
    return counts.select(F.explode(rows).alias("r"), "total").select("r.cutoff", "r.correct", "total")


def mean_reciprocal_rank(scores: DataFrame) -> DataFrame:
    answerable = scores.filter(expects_answer(F.col("category")))
    reciprocal = F.coalesce(1.0 / F.col("first_relevant_rank"), F.lit(0.0))
    return answerable.agg(F.coalesce(F.avg(reciprocal), F.lit(0.0)).alias("mrr"))


def threshold_rejections(scores: DataFrame) -> DataFrame:
    """Per must-refuse category: questions for which nothing survived the threshold."""
    return (
        scores.filter(must_refuse(F.col("category")))
        .groupBy("category")
        .agg(
            F.count_if(F.col("retrieved") == 0).alias("rejected"), F.count(F.lit(1)).alias("total")
        )
    )


def is_retrieval_failure(cutoff: int = max(k.HIT_CUTOFFS)) -> Column:
    """Over the columns of score_retrieval."""
    missed = F.col("first_relevant_rank").isNull() | (F.col("first_relevant_rank") > cutoff)
    return F.when(expects_answer(F.col("category")), missed).otherwise(F.col("leaked_internal"))


def retrieval_failures(scores: DataFrame, judged: DataFrame) -> DataFrame:
    """Failing questions with one reason line."""
    top = judged.filter(F.col("position") <= 3).groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.struct(
                            "position",
                            F.concat(
                                "document_id",
                                F.lit("/"),
                                F.coalesce(t.innermost(F.col("heading_path")), F.lit("—")),
                            ).alias("name"),
                        )
                    )
                ),
                lambda h: h["name"],
            ),
            ", ",
        ).alias("found")
    )
    rank = F.col("first_relevant_rank")
    reason = (
        F.when(
            expects_answer(F.col("category")),
            F.when(F.col("retrieved") == 0, "retrieved nothing")
            .when(rank.isNull(), F.concat(F.lit("no expected source retrieved; got "), "found"))
            .otherwise(F.concat(F.lit("expected source only at rank "), rank.cast("string"))),
        )
        .otherwise("retrieved an internal passage")
    )
    failing = scores.filter(is_retrieval_failure())
    return failing.join(top, "query_id", "left").select("query_id", "category", reason.alias("reason"))


def internal_leaks(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_if("leaked_internal").alias("internal_leaks"))


# --- records ------------------------------------------------------------------
def verified_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per question: citations that a context passage backs, and whether one was expected.

    answers(query_id, citations); sources(query_id, document_id, title, source,
    section, relevant) are the passages of the context.
    """
    key = ("document_id", "title", "source", "section")
    backing = sources.groupBy("query_id", *key).agg(F.bool_or("relevant").alias("relevant"))
    cited = answers.select("query_id", F.explode("citations").alias("c")).select("query_id", "c.*")
    same = [F.col(f"c.{name}").eqNullSafe(F.col(f"b.{name}")) for name in ("query_id", *key)]
    backed = cited.alias("c").join(backing.alias("b"), same, "inner").groupBy("c.query_id").agg(
        F.count(F.lit(1)).alias("verified_citations"),
        F.bool_or("b.relevant").alias("cites_expected_source"),
    )
    return answers.select("query_id").join(backed, "query_id", "left").select(
        "query_id",
        F.coalesce("verified_citations", F.lit(0)).alias("verified_citations"),
        F.coalesce("cites_expected_source", F.lit(False)).alias("cites_expected_source"),
    )


def _present(*named: tuple[str, Column]) -> Column:
    """Names whose condition holds, in the given order."""
    flags = [F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in named]
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def score_answers(answers: DataFrame, scores: DataFrame, verified: DataFrame) -> DataFrame:
    """Answered questions -> records with their failure kinds.

    answers(query_id, outcome, answer, citations, unknown_labels, ...).
    """
    judged = scores.select(
        "query_id", "category", "first_relevant_rank", "leaked_internal", "retrieved"
    )
    rows = answers.join(judged, "query_id").join(verified, "query_id", "left")
    answered = F.col("outcome") == "answered"
    count = F.size("citations")
    category = F.col("category")
    failures = _present(
        ("retrieval_miss", expects_answer(category) & is_retrieval_failure()),
        ("not_answered", expects_answer(category) & ~answered),
        ("answered_unknown", must_refuse(category) & answered),
        ("empty_answer", t.strip(F.col("answer")) == ""),
        ("answered_without_citation", answered & (count == 0)),
        ("citation_on_refusal", ~answered & (count > 0)),
        ("unverified_citation", F.col("verified_citations") != count),
        ("invented_source_label", F.size("unknown_labels") > 0),
        ("dangling_citation_mark", marks.has_dangling_mark(F.col("answer"), count)),
        ("internal_label_leak", marks.has_label_leak(F.col("answer"))),
        ("internal_passage_retrieved", F.col("leaked_internal")),
    )
    return rows.withColumn("failures", failures).withColumn("retrieval_observed", F.lit(True))


def score_errors(errors: DataFrame, scores: DataFrame) -> DataFrame:
    """Questions the pipeline failed on -> records. errors(query_id, error_category, retrieval_observed, ...)."""
    judged = scores.select(
        "query_id", "category", "first_relevant_rank", "leaked_internal", "retrieved"
    )
    rows = errors.join(judged, "query_id")
    observed = F.col("retrieval_observed")
    failures = _present(
        ("pipeline_error", F.lit(True)),
        (
            "retrieval_miss",
            observed & expects_answer(F.col("category")) & is_retrieval_failure(),
        ),
        ("internal_passage_retrieved", observed & F.col("leaked_internal")),
    )
    citation = "array<struct<document_id:string,title:string,source:string,section:string>>"
    return (
        rows.withColumn("failures", failures)
        .withColumn("outcome", F.lit(None).cast("string"))
        .withColumn("answer", F.lit(""))
        .withColumn("citations", F.array().cast(citation))
        .withColumn("unknown_labels", F.array().cast("array<string>"))
        .withColumn("verified_citations", F.lit(0).cast("long"))
        .withColumn("cites_expected_source", F.lit(False))
    )


# --- gates and failure reports ------------------------------------------------
def _fixed_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def gates(records: DataFrame) -> DataFrame:
    """One row per gate: passed, and how many questions broke it."""
    broken = records.agg(
        *[
            F.count_if(F.arrays_overlap("failures", F.array(*[F.lit(f) for f in kinds]))).alias(name)
            for name, kinds in k.GATES.items()
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(name).alias("gate"), F.col(name).alias("broken_by")) for name in k.GATES]
    )
    return broken.select(F.explode(rows).alias("g")).select(
        "g.gate", (F.col("g.broken_by") == 0).alias("passed"), "g.broken_by"
    )


def failure_counts(records: DataFrame) -> DataFrame:
    """failure, questions - the bounded form of the failure index."""
    return (
        records.select(F.explode("failures").alias("failure"))
        .groupBy("failure")
        .agg(F.count(F.lit(1)).alias("questions"))
    )


def failure_index(records: DataFrame) -> DataFrame:
    """failure, query_id: the failure index as rows, so that a common failure stays distributed."""
    return records.select(F.explode("failures").alias("failure"), "query_id")


def failure_classes(records: DataFrame) -> DataFrame:
    """Occurrences and questions per class (safety / availability / quality)."""
    classed = records.select(
        F.explode(
            F.transform("failures", lambda f: F.try_element_at(_fixed_map(k.FAILURE_CLASSES), f))
        ).alias("class"),
        "query_id",
    )
    per_question = classed.groupBy("class", "query_id").agg(F.count(F.lit(1)).alias("n"))
    return per_question.groupBy("class").agg(
        F.sum("n").alias("failures"), F.count(F.lit(1)).alias("questions")
    )


# --- metrics ------------------------------------------------------------------
def availability_metrics(records: DataFrame) -> DataFrame:
    """Per error category (null = completed): questions."""
    errored = F.col("outcome").isNull()
    category = F.when(errored, F.coalesce("error_category", F.lit("not_a_generation_failure")))
    return records.groupBy(category.alias("error_category")).agg(
        F.count(F.lit(1)).alias("questions")
    )


def answer_metrics(records: DataFrame) -> DataFrame:
    answerable = expects_answer(F.col("category"))
    answered = F.coalesce(F.col("outcome") == "answered", F.lit(False))
    return records.agg(
        F.count_if(answered).alias("answered"),
        F.count_if(F.col("outcome") == "no_knowledge").alias("no_knowledge"),
        F.count_if(F.col("outcome") == "not_grounded").alias("not_grounded"),
        F.count_if(F.col("outcome").isNull()).alias("error"),
        F.count_if(answerable).alias("answerable"),
        F.count_if(answerable & answered).alias("answerable_answered"),
        F.count_if(answerable & answered & F.col("cites_expected_source")).alias("citing_expected"),
    )


def citation_metrics(records: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return records.agg(
        F.coalesce(F.sum(F.size("citations")), zero).alias("published"),
        F.coalesce(F.sum("verified_citations"), zero).alias("valid"),
        F.coalesce(F.sum(F.size("unknown_labels")), zero).alias("invented_labels"),
        F.count_if(expects_answer(F.col("category")) & (F.size("citations") == 0)).alias(
            "answerable_without_citation"
        ),
    )


def is_controlled_refusal() -> Column:
    return F.coalesce(
        F.col("outcome").isin("no_knowledge", "not_grounded")
        & t.is_refusal_text(F.col("answer"))
        & (F.size("citations") == 0),
        F.lit(False),
    )


def refusal_metrics(records: DataFrame) -> DataFrame:
    refuse = must_refuse(F.col("category"))
    return records.agg(
        F.count_if(refuse & is_controlled_refusal()).alias("controlled_refusals"),
        F.count_if(refuse).alias("expected_refusals"),
        F.count_if(refuse & ~is_controlled_refusal()).alias("not_refused"),
    )


def robustness_metrics(records: DataFrame) -> DataFrame:
    def having(kind: str) -> Column:
        return F.count_if(F.array_contains("failures", kind))

    return records.agg(
        F.count_if(F.col("outcome").isNull()).alias("pipeline_errors"),
        having("empty_answer").alias("empty_answers"),
        having("internal_label_leak").alias("internal_label_leaks"),
        having("internal_passage_retrieved").alias("internal_passages_retrieved"),
    )


def latency_metrics(records: DataFrame) -> DataFrame:
    """Median and longest duration of the questions that did not fail."""
    completed = records.filter(F.col("outcome").isNotNull()).select("duration_seconds")
    middle = order_statistics.medians(completed, [], "duration_seconds")
    longest = completed.agg(F.round(F.max("duration_seconds"), 3).alias("max_seconds"))
    # Both sides are at most one row.
    return longest.join(middle, F.lit(True), "left").select(
        F.round("median", 3).alias("median_seconds"), "max_seconds"
    )


def grounding_report(records: DataFrame) -> DataFrame:
    """Outcomes, correct behaviour by expectation, and the slowest question."""
    category = F.col("category")
    answered = F.coalesce(F.col("outcome") == "answered", F.lit(False))
    cited = F.size("citations") > 0
    right = (expects_answer(category) & answered & cited) | (
        must_refuse(category) & ~answered & ~cited
    )
    return records.filter(F.col("outcome").isNotNull()).agg(
        F.count_if(answered).alias("answered"),
        F.count_if(F.col("outcome") == "no_knowledge").alias("no_knowledge"),
        F.count_if(F.col("outcome") == "not_grounded").alias("not_grounded"),
        F.count_if(expects_answer(category) & right).alias("answerable_correct"),
        F.count_if(expects_answer(category)).alias("answerable"),
        F.count_if(must_refuse(category) & right).alias("refusals_correct"),
        F.count_if(must_refuse(category)).alias("must_refuse"),
        F.max_by("query_id", F.struct(F.col("duration_seconds"), F.col("query_id"))).alias("slowest"),
    )


def checker_score(cases: DataFrame, verdicts: DataFrame, profile=None) -> DataFrame:
    """Verdicts against gold labels; anything but `supported` is a rejection.

    cases(case_id, expected, scored); verdicts(case_id, outcome, input_tokens,
    output_tokens, latency_seconds), at most one per case. False accepts are listed
    by false_accepts().
    """
    scored = cases.filter("scored")
    rows = scored.join(verdicts, "case_id", "left")
    ran = F.col("outcome").isNotNull()
    accepted = ran & (F.col("outcome") == "supported")
    good = F.col("expected") == "supported"
    replied = F.col("outcome").isin("supported", "not_supported", "unusable")
    usable = F.col("outcome").isin("supported", "not_supported")
    measured = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    rate = F.count_if(usable) / F.nullif(F.count_if(replied), F.lit(0))
    columns = [
        F.count(F.lit(1)).alias("scored_cases"),
        F.count_if(ran).alias("ran"),
        F.count_if(accepted & good).alias("correctly_accepted"),
        F.count_if(ran & ~accepted & ~good).alias("correctly_rejected"),
        F.count_if(accepted & ~good).alias("falsely_accepted"),
        F.count_if(ran & ~accepted & good).alias("falsely_rejected"),
        F.round(rate, 3).alias("verdict_rate"),
        F.count_if(F.col("outcome").isin("unusable", "error", "rate_limited")).alias("unusable_or_error"),
        F.avg(F.when(measured, F.col("input_tokens"))).alias("mean_input_tokens"),
        F.avg(F.when(measured, F.col("output_tokens"))).alias("mean_output_tokens"),
        F.avg("latency_seconds").alias("mean_latency_seconds"),
    ]
    if profile is not None:
        cost = (
            F.col("input_tokens") * profile.input_per_million
            + F.col("output_tokens") * profile.output_per_million
        ) / 1_000_000
        columns.append(F.round(F.coalesce(F.sum(F.when(measured, cost)), F.lit(0.0)), 1).alias("estimated_cost"))
    return rows.agg(*columns).withColumn(
        "safe", (F.col("falsely_accepted") == 0) & (F.col("ran") == F.col("scored_cases"))
    )


def false_accepts(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    wrong = cases.filter(F.col("scored") & (F.col("expected") != "supported"))
    return wrong.join(verdicts.filter(F.col("outcome") == "supported"), "case_id", "left_semi").select("case_id")


# --- question sets ------------------------------------------------------------
def select_suite(questions: DataFrame, suite: DataFrame) -> DataFrame:
    """The questions a suite names (query_id), in the set's own order column."""
    return questions.join(suite.select("query_id"), "query_id", "left_semi")


def suite_problems(questions: DataFrame, suite: DataFrame) -> DataFrame:
    """Ids a suite names twice or that the question set does not have."""
    named = suite.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    unknown = named.join(questions.select("query_id"), "query_id", "left_anti")
    return (
        named.filter(F.col("n") > 1)
        .select("query_id", F.lit("duplicate").alias("problem"))
        .unionByName(unknown.select("query_id", F.lit("unknown").alias("problem")))
    )


def experiment_plan(questions: DataFrame, variants: Sequence[str], repetitions: int) -> DataFrame:
    """question x repetition x variant, variants reversed in every even repetition."""
    if repetitions <= 0 or not variants or len(set(variants)) != len(variants):
        raise ValueError("repetitions must be positive and variants distinct")
    forward = F.array(*[F.lit(v) for v in variants])
    rounds = questions.select(
        "query_id", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition")
    )
    order = F.when(F.col("repetition") % 2 == 1, forward).otherwise(F.reverse(forward))
    return rounds.select("query_id", "repetition", F.posexplode(order).alias("position", "variant"))


def variant_summary(calls: DataFrame) -> DataFrame:
    """Per experiment variant: failures and the spread of reply sizes and visible ratios.

    calls(variant, query_id, result, reply_characters, reply_visible_characters).
    """
    failed = F.col("result") != "parsed"
    replied = F.col("reply_characters").isNotNull() & F.col("reply_visible_characters").isNotNull()
    size = F.when(replied, F.col("reply_characters"))
    ratio = F.when(
        replied & (F.col("reply_characters") > 0),
        F.col("reply_visible_characters") / F.col("reply_characters"),
    )
    rows = calls.select("variant", failed.alias("failed"), size.alias("size"), ratio.alias("ratio"))
    totals = rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("failed").alias("failures"),
        F.round(F.count_if("failed") / F.count(F.lit(1)), 3).alias("failure_rate"),
        F.min("size").alias("min_characters"),
        F.max("size").alias("max_characters"),
        F.round(F.min("ratio"), 3).alias("min_visible"),
        F.round(F.max("ratio"), 3).alias("max_visible"),
    )
    sizes = order_statistics.medians(rows, ["variant"], "size", "_size")
    ratios = order_statistics.medians(rows, ["variant"], "ratio", "_ratio")
    return (
        totals.join(sizes, "variant", "left")
        .join(ratios, "variant", "left")
        .withColumn("median_characters", F.bround("_size"))
        .withColumn("median_visible", F.round("_ratio", 3))
        .drop("_size", "_ratio")
    )


def variant_failures(calls: DataFrame) -> DataFrame:
    return calls.groupBy("variant", "query_id").agg(
        F.count_if(F.col("result") != "parsed").alias("failures")
    )
