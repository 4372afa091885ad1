"""From replies to published answers: citations, numbering, the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.functions import marks, replies
from lodestone.functions import text as t
from lodestone.functions.binding import let


def parse_replies(table: DataFrame) -> DataFrame:
    """reply -> rule, answer, labels, support, category (for replies with a rule)."""
    parsed = table.withColumn("_r", replies.parse_reply(F.col("reply")))
    broken = F.col("_r.rule").isNotNull()
    finish = F.col("finish_reason") if "finish_reason" in table.columns else F.lit(None).cast("string")
    category = replies.unusable_category(finish, replies.is_cut_off(F.col("reply")))
    return parsed.withColumn("category", F.when(broken, category)).select("*", "_r.*").drop("_r")


def parse_verdicts(table: DataFrame) -> DataFrame:
    return table.withColumn("_v", replies.parse_verdict(F.col("reply"))).select("*", "_v.*").drop("_v")


def claimed_labels(parsed: DataFrame) -> DataFrame:
    """query_id, claim_pos, label, is_repeat: one row per claimed label."""
    claims = parsed.select("query_id", F.posexplode("labels").alias("claim_pos", "label"))
    same = Window.partitionBy("query_id", "label").orderBy("claim_pos")
    return claims.withColumn("is_repeat", F.row_number().over(same) > 1)


def resolve_citations(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Claimed labels against the context: query_id, claim_pos, label, status + source columns.

    sources(query_id, label, document_id, title, source, section, ...). Status is
    cited, unknown or duplicate; an unknown label counts each time it is claimed.
    """
    joined = claimed_labels(parsed).join(
        sources.withColumn("_known", F.lit(True)), ["query_id", "label"], "left"
    )
    status = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("is_repeat"), "duplicate")
        .otherwise("cited")
    )
    return joined.withColumn("status", status).drop("_known", "is_repeat")


def collapse_citations(resolved: DataFrame) -> DataFrame:
    """One citation per (document, section), the first claimed one: *citation_no* from 1."""
    cited = resolved.filter(F.col("status") == "cited")
    place = Window.partitionBy("query_id", "document_id", "section").orderBy("claim_pos")
    order = Window.partitionBy("query_id").orderBy("claim_pos")
    return (
        cited.withColumn("_n", F.row_number().over(place))
        .filter(F.col("_n") == 1)
        .withColumn("citation_no", F.row_number().over(order))
        .drop("_n")
    )


CITATION = "struct<document_id:string,title:string,source:string,section:string>"
CITED = "struct<label:string,document_id:string,section:string>"


def citation_outcome(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per query: citations in claim order, cited labels, unknown labels, repeats.

    One list per query, bounded by the labels of one reply.
    """
    claims = F.sort_array(
        F.collect_list(
            F.struct("claim_pos", "label", "status", "document_id", "title", "source", "section")
        )
    )
    grouped = resolved.groupBy("query_id").agg(claims.alias("claims"))

    def having(status: str) -> Column:
        return F.filter("claims", lambda c: c["status"] == status)

    def place(c: Column) -> Column:
        return F.struct(c["document_id"].alias("document_id"), c["section"].alias("section"))

    listed = grouped.withColumn("_cited", having("cited"))
    places = F.transform("_cited", place)
    firsts = F.filter(
        "_cited", lambda c, n: F.array_position(places, place(c)).cast("int") == n + 1
    )
    citations = F.transform(
        firsts, lambda c: F.struct(*[c[f].alias(f) for f in ("document_id", "title", "source", "section")])
    )
    cited = F.transform(
        "_cited", lambda c: F.struct(*[c[f].alias(f) for f in ("label", "document_id", "section")])
    )
    found = listed.select(
        "query_id",
        citations.alias("citations"),
        cited.alias("cited"),
        F.transform(having("unknown"), lambda c: c["label"]).alias("unknown_labels"),
        F.size(having("duplicate")).alias("duplicate_labels"),
    )
    return parsed.select("query_id").join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("citations", F.array().cast(f"array<{CITATION}>")).alias("citations"),
        F.coalesce("cited", F.array().cast(f"array<{CITED}>")).alias("cited"),
        F.coalesce("unknown_labels", F.array().cast("array<string>")).alias("unknown_labels"),
        F.coalesce("duplicate_labels", F.lit(0)).alias("duplicate_labels"),
    )


def number_citations(answers: DataFrame) -> DataFrame:
    """Number citations by first appearance in the text; unmarked ones follow in claim order.

    answers(answer, citations, cited) -> presented, ordered_citations, removed_marks.
    Labels in prose go first, so a mark in a sentence that goes with them has no number.
    """

    def index_of(label: Column) -> Column:
        """1-based place of a label's citation in *citations*; null for unverified labels."""
        source = F.try_element_at(F.filter("cited", lambda c: c["label"] == label), F.lit(1))
        places = F.transform(
            "citations",
            lambda c: (c["document_id"] == source["document_id"])
            & c["section"].eqNullSafe(source["section"]),
        )
        return F.when(source.isNotNull(), F.nullif(F.array_position(places, True), F.lit(0)))

    known = answers.withColumn(
        "_text", let(marks.canonical_marks(F.col("answer")), marks.drop_references)
    ).withColumn(
        "_labels", marks.mark_labels(F.col("_text"))
    )
    placed = known.withColumn(
        "_marks",
        F.transform("_labels", lambda l: F.struct(l.alias("label"), index_of(l).alias("at"))),
    ).withColumn("_verified", F.filter("_marks", lambda m: m["at"].isNotNull()))
    rest = F.sequence(F.lit(1), F.size("citations")).cast("array<bigint>")
    order = F.array_distinct(
        F.concat(
            F.transform("_verified", lambda m: m["at"].cast("long")),
            F.when(F.size("citations") > 0, rest).otherwise(F.array().cast("array<bigint>")),
        )
    )
    placed = placed.withColumn("_order", order)
    numbers = F.map_from_entries(
        F.transform(
            F.array_distinct("_verified"),
            lambda m: F.struct(
                m["label"].alias("label"), F.array_position("_order", m["at"].cast("long")).alias("n")
            ),
        )
    )
    return placed.select(
        *answers.columns,
        marks.drop_names(marks.renumber_marks(F.col("_text"), numbers)).alias("presented"),
        F.transform(
            "_order", lambda i: F.element_at("citations", i.cast("int"))
        ).alias("ordered_citations"),
        (F.size("_labels") - F.size("_verified")).alias("removed_marks"),
    )


def answer_decision(
    questions: DataFrame, retrieved: DataFrame, parsed: DataFrame, outcome: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """What is published per question.

    questions(query_id, question); retrieved(query_id, retrieved count);
    parsed(query_id, rule, answer, support); outcome from citation_outcome;
    verdicts(query_id, verdict). Columns: outcome, answer, citations, error, unknown_labels.
    """
    joined = (
        questions.join(retrieved.select("query_id", "retrieved"), "query_id", "left")
        .join(parsed.select("query_id", "rule", F.col("answer").alias("draft"), "support"), "query_id", "left")
        .join(outcome, "query_id", "left")
        .join(verdicts.select("query_id", "verdict", F.col("rule").alias("verdict_rule")), "query_id", "left")
    )
    nothing = F.coalesce("retrieved", F.lit(0)) == 0
    publishable = (
        F.coalesce(F.col("support") == "stated", F.lit(False))
        & (F.coalesce("draft", F.lit("")) != "")
        & (F.size("citations") > 0)
    )
    no_check = F.col("verdict").isNull() | (F.col("verdict") == "unusable")
    error = (
        F.when(nothing, None)
        .when(F.col("draft").isNull(), F.coalesce("rule", F.lit("no_reply")))
        .when(publishable & no_check, F.coalesce("verdict_rule", F.lit("no_verdict")))
    )
    result = (
        F.when(nothing, "no_knowledge")
        .when(error.isNotNull(), None)
        .when(publishable & (F.col("verdict") == "supported"), "answered")
        .otherwise("not_grounded")
    )
    decided = joined.withColumn("error", error).withColumn("outcome", result)
    empty = f"array<{CITATION}>"
    answered = F.col("outcome") == "answered"
    base = decided.withColumn(
        "cited", F.coalesce("cited", F.array().cast(f"array<{CITED}>"))
    ).withColumn("citations", F.coalesce("citations", F.array().cast(empty)))
    # Only published drafts are numbered and only the questions of refusals are read: both are whole texts.
    base = base.withColumn("answer", F.when(answered, F.col("draft")).otherwise(""))
    refused = F.when(~answered, F.col("question"))
    presented = number_citations(base)
    return presented.select(
        "query_id",
        "outcome",
        "error",
        F.when(answered, F.col("presented"))
        .when(F.col("outcome").isNull(), "")
        .otherwise(t.refusal_text(t.detect_language(refused)))
        .alias("answer"),
        F.when(answered, F.col("ordered_citations")).otherwise(F.array().cast(empty)).alias("citations"),
        F.coalesce("unknown_labels", F.array().cast("array<string>")).alias("unknown_labels"),
        "support",
        "verdict",
    )


# --- failures -----------------------------------------------------------------
def failure_policy(failures: DataFrame) -> DataFrame:
    """failures(category[, finish_reason]) + owner, transport_retry, recovery, larger_output."""
    # Seven literals: a fixed lookup, written as one map expression.
    rows = [
        c
        for name, (owner, retry, recovery) in k.FAILURE_POLICY.items()
        for c in (
            F.lit(name),
            F.struct(
                F.lit(owner).alias("owner"),
                F.lit(retry).alias("transport_retry"),
                F.lit(recovery).alias("recovery"),
            ),
        )
    ]
    policy = F.try_element_at(F.create_map(*rows), F.col("category"))
    finish = F.col("finish_reason") if "finish_reason" in failures.columns else F.lit(None).cast("string")
    larger = F.coalesce(finish == k.TRUNCATED_FINISH, F.lit(False)) | F.coalesce(
        F.col("category") == "output_truncated", F.lit(False)
    )
    return (
        failures.withColumn("_p", policy)
        .select("*", "_p.*", larger.alias("larger_output"))
        .drop("_p")
    )


def provider_failure_category(kind: Column, retryable: Column) -> Column:
    """Category of a failed generation call from what the provider reported."""
    return (
        F.when(kind == "timeout", "timeout")
        .when(kind == "malformed_response", "malformed_response")
        .when(retryable | (kind == "rate_limited"), "retryable_provider_error")
        .when(kind == "http_status", "provider_status")
        .otherwise("unclassified")
    )


def store_failure_transient(kind: Column, status: Column, retryable: Column) -> Column:
    """Whether a failed vector search may be tried again."""
    by_status = F.coalesce(status.isin(list(k.TRANSIENT_STATUS)) | (status >= 500), F.lit(False))
    return retryable | kind.isin(list(k.TRANSIENT_KINDS)) | by_status
