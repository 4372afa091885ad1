"""Bring the stored index in step with a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import embeddings, identity, indexing
from lodestone.policies import EmbeddingSpec
from lodestone.session import stage
from lodestone.sources import index_table


def sync_index(
    chunks: DataFrame,
    root: str,
    spec: EmbeddingSpec,
    provider: embeddings.Embedder,
    rebuild: bool = False,
) -> DataFrame:
    """Plan, embed what changed, write and commit the next version; returns counts by action.

    A second run over the same corpus plans nothing and writes nothing; a small change
    writes the buckets of the documents it touches. When another writer commits in between,
    this one is refused (`index_table.ConcurrentWrite`). The plan and
    the new vectors are staged: both feed several branches, and the provider must not be
    asked twice.
    """
    spark = chunks.sparkSession
    found = index_table.current_version(spark, root)
    desired = indexing.desired_state(chunks, spec)
    if found is None:
        index = empty_index(desired, spec)
    else:
        index = index_table.read_index(spark, root, found)
        if not rebuild:
            identity.require_space(index, spec)
    plan = stage(indexing.plan_index(desired, index, rebuild=rebuild), "plan")
    counts = indexing.plan_counts(plan)
    changes = plan.filter(F.col("action") != "unchanged").limit(1).count()
    if changes == 0 and found is not None:
        return counts
    needed = indexing.embeddings_required(plan)
    made = stage(
        embeddings.embed(needed, "embedding_fingerprint", "embedding_text", provider), "vectors"
    )
    problems = embeddings.embedding_problems(needed, made, "embedding_fingerprint", spec)
    bad = problems.limit(1).collect()
    if bad:
        raise ValueError(f"embedding {bad[0].embedding_fingerprint}: {bad[0].problem}")
    if found is None or rebuild:
        index_table.write_index(indexing.synchronized(plan, index, made, spec), root, spec, base=found)
        return counts
    puts = stage(indexing.changed_records(plan, index, made, spec), "puts")
    deletes = stage(indexing.deleted_records(plan, index), "deletes")
    index_table.update_index(puts, deletes, root, spec, found)
    return counts


def empty_index(desired: DataFrame, spec: EmbeddingSpec) -> DataFrame:
    """An index without rows in the layout of *desired*."""
    return desired.filter(F.lit(False)).select(
        "id",
        identity.space_literal(spec).alias("spec"),
        *indexing.WANTED,
        F.lit(None).cast("array<double>").alias("embedding"),
    )
