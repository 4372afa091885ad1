"""Evaluate retrieval over a question set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluation, retrieval
from lodestone.policies import RetrievalPolicy
from lodestone.session import stage


@dataclass(frozen=True)
class RetrievalReport:
    judged: DataFrame
    scores: DataFrame
    hit_rates: DataFrame
    mrr: DataFrame
    rejections: DataFrame
    failures: DataFrame
    leaks: DataFrame


def evaluate_retrieval(
    questions: DataFrame,
    expected: DataFrame,
    query_vectors: DataFrame,
    index: DataFrame,
    chunks: DataFrame,
    dimensions: int,
    policy: RetrievalPolicy = RetrievalPolicy(),
) -> RetrievalReport:
    """questions(query_id, category), expected(query_id, document, section) -> report tables."""
    results = retrieval.retrieve(query_vectors, index, chunks, dimensions, policy)
    hits = results.filter(F.col("status") == "retrieved")
    # All report tables read these two; the search must not run once per table.
    judged = stage(evaluation.relevance(expected, hits), "judged")
    scores = stage(evaluation.score_retrieval(questions, judged), "scores")
    return RetrievalReport(
        judged=judged,
        scores=scores,
        hit_rates=evaluation.hit_at_k(scores),
        mrr=evaluation.mean_reciprocal_rank(scores),
        rejections=evaluation.threshold_rejections(scores),
        failures=evaluation.retrieval_failures(scores, judged),
        leaks=evaluation.internal_leaks(scores),
    )
