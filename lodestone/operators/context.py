"""Packing retrieved passages into a token budget, conversations, prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.functions import text as t
from lodestone.policies import ContextPolicy


def passage_body(title: Column, heading_path: Column, content: Column) -> Column:
    section = F.when(
        F.size(heading_path) > 0,
        F.concat(F.lit("Section: "), F.array_join(heading_path, " > ")),
    )
    return F.concat_ws(
        "\n", F.concat(F.lit("Document: "), title), section, F.lit("Content:"), content
    )


def source_block(number: Column, body: Column) -> Column:
    return F.concat(F.lit("[SOURCE S"), number.cast("string"), F.lit("]\n"), body)


def pack_context(retrieved: DataFrame, budgets: DataFrame) -> DataFrame:
    """Decide, in rank order, which passages of a query enter its context.

    retrieved(query_id, position, id, title, heading_path, content, ...) with at most
    top_k rows per query; budgets(query_id, available_tokens). Adds *decision*
    (included / duplicate / over_budget), *label* and *text* to every passage.

    A passage that does not fit is skipped and does not mark its text as seen; later
    ones are still tried. The fold carries lengths and digests, not the texts.
    """
    body = passage_body(F.col("title"), F.col("heading_path"), F.col("content"))
    rendered = retrieved.withColumn("body", body)
    facts = F.struct(
        F.col("position"),
        F.length("body").alias("chars"),
        F.sha2("body", 256).alias("digest"),
        F.col("id").cast("string").alias("id"),
    )
    lists = rendered.groupBy("query_id").agg(F.sort_array(F.collect_list(facts)).alias("passages"))
    budgeted = lists.join(budgets.select("query_id", "available_tokens"), "query_id")
    start = F.struct(
        F.lit(0).alias("chars"),
        F.lit(0).alias("n"),
        F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<struct<position:int,decision:string,number:int>>").alias("out"),
    )

    def step(acc: Column, p: Column) -> Column:
        known = F.array_contains(acc["seen"], p["digest"]) | F.array_contains(acc["seen"], p["id"])
        number = acc["n"] + 1
        header = F.length(F.concat(F.lit("[SOURCE S"), number.cast("string"), F.lit("]\n")))
        gap = F.when(acc["n"] > 0, 2).otherwise(0)
        total = acc["chars"] + gap + header + p["chars"]
        fits = t.tokens_of_length(total) <= F.col("available_tokens")
        decision = F.when(known, "duplicate").when(fits, "included").otherwise("over_budget")
        taken = ~known & fits
        return F.struct(
            F.when(taken, total).otherwise(acc["chars"]).alias("chars"),
            F.when(taken, number).otherwise(acc["n"]).alias("n"),
            F.when(taken, F.concat(acc["seen"], F.array(p["digest"], p["id"])))
            .otherwise(acc["seen"])
            .alias("seen"),
            F.array_append(
                acc["out"],
                F.struct(
                    p["position"].cast("int").alias("position"),
                    decision.alias("decision"),
                    F.when(taken, number).alias("number"),
                ),
            ).alias("out"),
        )

    # Joined by query alone: what follows by query needs no second shuffle of the texts.
    decided = budgeted.select("query_id", F.aggregate("passages", start, step, lambda acc: acc["out"]).alias("_out"))
    own = F.get(F.filter("_out", lambda x: x["position"] == F.col("position")), 0)
    joined = rendered.join(decided, "query_id").withColumn("_own", own).filter(F.col("_own").isNotNull()).select(
        *[c for c in rendered.columns], "_own.decision", "_own.number"
    )
    included = F.col("decision") == "included"
    return joined.select(
        *[c for c in retrieved.columns],
        "decision",
        F.when(included, F.concat(F.lit("S"), F.col("number").cast("string"))).alias("label"),
        F.when(included, source_block(F.col("number"), F.col("body"))).alias("text"),
    )


def context_summary(packed: DataFrame) -> DataFrame:
    """Per query the context text and its counts; *failed* when nothing fitted.

    A query has at most top_k passages, so the collected list is short.
    """
    parts = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("position", "text"))))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")
    counts = packed.groupBy("query_id").agg(
        text.alias("context"),
        F.count_if(F.col("decision") == "included").alias("sources"),
        F.count_if(F.col("decision") == "duplicate").alias("duplicates_removed"),
        F.count_if(F.col("decision") == "over_budget").alias("skipped_for_budget"),
    )
    return counts.withColumn("estimated_tokens", t.estimate_tokens(F.col("context"))).withColumn(
        "failed", (F.col("sources") == 0) & (F.col("skipped_for_budget") > 0)
    )


# --- conversations ------------------------------------------------------------
def bound_conversation(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row per conversation: error, kept, dropped, turns.

    Only the first seven turns by position are looked at: a seventh already makes the
    conversation too long. That rank is applied per task before the shuffle, so a
    conversation of any length sends seven rows per task.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    first = turns.withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= k.MAX_CONVERSATION_TURNS + 1
    )
    clean = first.withColumn("clean", t.normalize_query(F.col("text")))
    from_newest = (
        Window.partitionBy("conv_id")
        .orderBy(F.desc("turn"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    problem = (
        F.when(~F.col("role").isin("user", "assistant"), "role_not_allowed")
        .when(F.length("text") > k.MAX_TURN_LENGTH, "turn_too_long")
        .when(~t.has_visible(F.col("clean")), "turn_empty")
    )
    judged = (
        clean.withColumn("problem", problem)
        .withColumn("spent", F.sum(F.length("clean")).over(from_newest))
        .withColumn("keep", F.col("spent") <= k.MAX_CONVERSATION_CHARACTERS)
    )
    kept_turns = F.sort_array(
        F.collect_list(F.when(F.col("keep"), F.struct("turn", "role", F.col("clean").alias("text"))))
    )
    grouped = judged.groupBy("conv_id").agg(
        F.max("_n").alias("n"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("turn"))).alias("first_problem"),
        F.count_if("keep").alias("kept"),
        kept_turns.alias("turns"),
    )
    error = F.when(F.col("n") > k.MAX_CONVERSATION_TURNS, "too_many_turns").otherwise(
        F.col("first_problem")
    )
    ok = error.isNull()
    return grouped.select(
        "conv_id",
        error.alias("error"),
        F.when(ok, F.col("kept")).alias("kept"),
        F.when(ok, F.col("n") - F.col("kept")).alias("dropped"),
        F.when(ok, F.col("turns")).alias("turns"),
    )


# --- prompts ------------------------------------------------------------------
def conversation_text(turns: Column) -> Column:
    lines = F.transform(turns, lambda turn: F.concat(turn["role"], F.lit(": "), turn["text"]))
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def user_message(question: Column, context: Column, conversation: Column) -> Column:
    """KNOWLEDGE, then CONVERSATION when there is one, then QUESTION."""
    knowledge = F.coalesce(F.nullif(context, F.lit("")), F.lit("(no passages were retrieved)"))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("KNOWLEDGE\n"), knowledge),
        F.concat(F.lit("CONVERSATION\n"), conversation),
        F.concat(F.lit("QUESTION\n"), question),
    )


def context_budgets(
    questions: DataFrame,
    instructions: str,
    conversation_instructions: str = "",
    policy: ContextPolicy = ContextPolicy(),
) -> DataFrame:
    """questions(query_id, question[, turns]) with overhead_tokens and available_tokens.

    The instruction texts belong to the caller.
    """
    earlier = conversation_text(F.col("turns")) if "turns" in questions.columns else F.lit(None).cast("string")
    system = F.when(earlier.isNull(), instructions).otherwise(
        f"{instructions}\n\n{conversation_instructions}"
    )
    scaffold = user_message(F.col("question"), F.lit(None).cast("string"), earlier)
    overhead = t.estimate_tokens(system) + t.estimate_tokens(scaffold)
    ceiling = policy.max_prompt_tokens - policy.output_reserve_tokens
    return questions.withColumn("overhead_tokens", overhead).withColumn(
        "available_tokens", F.lit(ceiling) - F.col("overhead_tokens")
    )


def prompt_table(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """questions(query_id, question[, turns]) + contexts(query_id, context) -> prompt."""
    joined = questions.join(contexts.select("query_id", "context"), "query_id", "left")
    earlier = conversation_text(F.col("turns")) if "turns" in questions.columns else F.lit(None).cast("string")
    return joined.withColumn("prompt", user_message(F.col("question"), F.col("context"), earlier))


def evidence_table(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """Text for the grounding check: cited passages in claim order, question, answer.

    answers(query_id, question, answer); cited(query_id, claim_pos, text).
    """
    parts = F.sort_array(F.collect_list(F.struct("claim_pos", "text")))
    evidence = cited.groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("evidence")
    )
    text = F.concat(
        F.lit("EVIDENCE\n"), F.coalesce("evidence", F.lit("")),
        F.lit("\n\nQUESTION\n"), "question",
        F.lit("\n\nANSWER\n"), "answer",
    )
    return answers.join(evidence, "query_id", "left").withColumn("evidence_text", text)
