"""Answer a whole table of questions: retrieve, pack, generate, cite, check, decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.functions import text as t
from lodestone.operators import answers, context, generation, retrieval
from lodestone.policies import ContextPolicy, RetrievalPolicy
from lodestone.session import stage


@dataclass(frozen=True)
class Answered:
    """The tables one batch produces."""

    rejected: DataFrame
    results: DataFrame
    sources: DataFrame
    decisions: DataFrame
    calls: DataFrame


def normalize_questions(questions: DataFrame) -> DataFrame:
    """questions(query_id, text) -> question, original_length, language and a nullable error."""
    text = t.normalize_query(F.col("text"))
    cleaned = questions.withColumn("question", text).withColumn("original_length", F.length("text"))
    error = F.when(F.col("original_length") > k.MAX_QUERY_LENGTH, "too_long").when(
        ~t.has_visible(F.col("question")), "empty"
    )
    return cleaned.withColumn("error", error).withColumn(
        "language", F.when(F.col("error").isNull(), t.detect_language(F.col("question")))
    )


def pack(
    questions: DataFrame, results: DataFrame, instructions: str, policy: ContextPolicy
) -> DataFrame:
    """Retrieved passages with what became of them in the context of their question."""
    budgets = context.context_budgets(questions, instructions, policy=policy)
    return context.pack_context(results.filter(F.col("status") == "retrieved"), budgets)


def answer_questions(
    questions: DataFrame,
    query_vectors: DataFrame,
    index: DataFrame,
    chunks: DataFrame,
    dimensions: int,
    instructions: str,
    check_instructions: str,
    provider: generation.Provider,
    model: str,
    retrieval_policy: RetrievalPolicy = RetrievalPolicy(),
    context_policy: ContextPolicy = ContextPolicy(),
) -> Answered:
    """questions(query_id, text), query_vectors(query_id, embedding) -> published answers.

    Questions that retrieve nothing are never sent to the provider, and only answers
    that could be published are checked.
    """
    normal = normalize_questions(questions)
    asked = normal.filter(F.col("error").isNull()).select("query_id", "question")
    # Each stage feeds several later ones, so it is written once to the shared folder.
    results = stage(
        retrieval.retrieve(
            query_vectors.join(asked.select("query_id"), "query_id", "left_semi"),
            index, chunks, dimensions, retrieval_policy,
        ),
        "results",
    )
    packed = stage(pack(asked, results, instructions, context_policy), "packed")
    contexts = context.context_summary(packed)
    usable = contexts.filter(F.col("sources") > 0)
    prompts = context.prompt_table(asked.join(usable.select("query_id"), "query_id", "left_semi"), usable)
    prompts = prompts.withColumn("prompt", F.concat(F.lit(instructions + "\n\n"), "prompt"))
    replied, calls = generation.generate(prompts, provider, model, policy=context_policy)
    parsed = stage(
        answers.parse_replies(
            replied.filter(F.col("reply").isNotNull()).select("query_id", "reply", "finish_reason")
        ),
        "parsed",
    )
    sources = packed.filter(F.col("label").isNotNull()).select(
        "query_id", "label", "id", "document_id", "title", "source",
        t.innermost(F.col("heading_path")).alias("section"), "heading_path", "text",
    )
    resolved = stage(answers.resolve_citations(parsed, sources), "resolved")
    outcome = stage(answers.citation_outcome(parsed, resolved), "outcome")
    publishable = (
        parsed.join(outcome, "query_id")
        .filter((F.col("support") == "stated") & (F.col("answer") != "") & (F.size("citations") > 0))
        .join(asked, "query_id")
        .select("query_id", "question", "answer")
    )
    evidence = context.evidence_table(publishable, resolved.filter(F.col("status") == "cited"))
    checks = evidence.select(
        "query_id", F.concat(F.lit(check_instructions + "\n\n"), "evidence_text").alias("prompt")
    )
    checked, check_calls = generation.generate(
        checks, provider, model, "grounding_check", context_policy
    )
    verdicts = answers.parse_verdicts(
        checked.filter(F.col("reply").isNotNull()).select("query_id", "reply")
    )
    retrieved = results.groupBy("query_id").agg(
        F.count_if(F.col("status") == "retrieved").alias("retrieved")
    )
    decisions = answers.answer_decision(asked, retrieved, parsed, outcome, verdicts)
    return Answered(
        rejected=normal.filter(F.col("error").isNotNull()).select("query_id", "error"),
        results=results,
        sources=sources,
        decisions=decisions,
        calls=calls.unionByName(check_calls),
    )
