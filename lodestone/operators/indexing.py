"""Keeping a vector index table in step with a corpus, as set operations on ids.

Index rows: id, spec, embedding_fingerprint, chunk_fingerprint,
document_fingerprint, metadata, embedding. A "state" is the same row without the
vector; column pruning then never reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import digests, vectors
from lodestone.functions import text as t
from lodestone.operators import identity
from lodestone.policies import EmbeddingSpec

STATE = (
    "id",
    "spec",
    "embedding_fingerprint",
    "chunk_fingerprint",
    "document_fingerprint",
    "metadata",
)
WANTED = ("embedding_fingerprint", "chunk_fingerprint", "document_fingerprint", "metadata")
METADATA = (
    "document_id",
    "title",
    "heading_path",
    "source_path",
    "document_type",
    "language",
    "visibility",
    "trust_level",
    "topics",
    "technologies",
)


def desired_state(chunks: DataFrame, spec: EmbeddingSpec) -> DataFrame:
    """Chunks -> the records an index should hold, with the text to embed."""
    text = t.embedding_text(F.col("title"), F.col("heading_path"), F.col("content"))
    metadata = F.struct(F.col("id").alias("chunk_id"), *[F.col(c) for c in METADATA])
    return chunks.select(
        "id",
        metadata.alias("metadata"),
        F.col("fingerprint").alias("chunk_fingerprint"),
        "document_fingerprint",
        text.alias("embedding_text"),
    ).withColumn(
        "embedding_fingerprint", digests.embedding_fingerprint(F.col("embedding_text"), spec)
    )


def metadata_differs(stored: str, wanted: str) -> Column:
    """Null-safe difference in metadata or lineage between two aliased rows."""
    fields = ("metadata", "chunk_fingerprint", "document_fingerprint")
    changed = F.lit(False)
    for name in fields:
        changed = changed | ~F.col(f"{stored}.{name}").eqNullSafe(F.col(f"{wanted}.{name}"))
    return changed


def plan_index(
    desired: DataFrame, actual: DataFrame, rebuild: bool = False, stale_detection: bool = True
) -> DataFrame:
    """One full outer join on id: every record with its action.

    create / reembed / metadata_update / unchanged / delete. *rebuild* makes every
    desired record a create; without *stale_detection* nothing is deleted.
    """
    keep = [c for c in desired.columns if c != "id"]
    d = desired.select("*", F.lit(True).alias("wanted")).alias("d")
    a = actual.select(*[c for c in STATE if c in actual.columns], F.lit(True).alias("held")).alias("a")
    joined = d.join(a, F.col("d.id") == F.col("a.id"), "full_outer")
    action = (
        F.when(F.col("wanted").isNull(), "delete")
        .when(F.lit(rebuild) | F.col("held").isNull(), "create")
        .when(
            ~F.col("d.embedding_fingerprint").eqNullSafe(F.col("a.embedding_fingerprint")), "reembed"
        )
        .when(metadata_differs("a", "d"), "metadata_update")
        .otherwise("unchanged")
    )
    plan = joined.select(
        F.coalesce("d.id", "a.id").alias("id"),
        action.alias("action"),
        *[F.col(f"d.{c}").alias(c) for c in keep],
    )
    return plan if stale_detection else plan.filter(F.col("action") != "delete")


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("records"))


def stale_ids(desired: DataFrame, actual: DataFrame) -> DataFrame:
    return actual.select("id").join(desired.select("id"), "id", "left_anti")


def dedup_by_fingerprint(records: DataFrame) -> DataFrame:
    """One record per embedding fingerprint, the one with the smallest id.

    The rank filter is applied per task before the shuffle, so a text shared by a
    large part of the corpus sends one row per task.
    """
    window = Window.partitionBy("embedding_fingerprint").orderBy("id")
    ranked = records.withColumn("_n", F.row_number().over(window))
    return ranked.filter(F.col("_n") == 1).drop("_n")


def embeddings_required(plan: DataFrame) -> DataFrame:
    """Texts that need a vector, each distinct text once."""
    need = plan.filter(F.col("action").isin("create", "reembed"))
    columns = ["embedding_fingerprint", "embedding_text"]
    return dedup_by_fingerprint(need.select("id", *columns)).select(*columns)


def assign_vectors(plan: DataFrame, embedded: DataFrame) -> DataFrame:
    """create / reembed rows with the vector of their fingerprint; null where it is missing."""
    need = plan.filter(F.col("action").isin("create", "reembed"))
    made = embedded.select("embedding_fingerprint", "embedding")
    return need.join(made, "embedding_fingerprint", "left")


def reuse_vectors(plan: DataFrame, index: DataFrame) -> DataFrame:
    """metadata_update rows with the vector the index already holds; null where missing."""
    need = plan.filter(F.col("action") == "metadata_update")
    return need.join(index.select("id", "embedding"), "id", "left")


def vector_problems(records: DataFrame, spec: EmbeddingSpec) -> DataFrame:
    """Records whose vector may not enter the index, with the reason."""
    wrong_space = (
        ~F.col("spec").eqNullSafe(identity.space_literal(spec))
        if "spec" in records.columns
        else F.lit(False)
    )
    problem = F.when(wrong_space, "other_space").otherwise(
        vectors.vector_problem(F.col("embedding"), spec.dimensions)
    )
    return records.select("id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def require_valid_vectors(records: DataFrame, spec: EmbeddingSpec) -> None:
    """All or nothing: one bad record refuses the whole batch, before any write."""
    bad = vector_problems(records, spec).limit(1).collect()
    if bad:
        raise ValueError(f"record {bad[0].id}: {bad[0].problem}")


def upsert(index: DataFrame, records: DataFrame) -> DataFrame:
    kept = index.join(records.select("id"), "id", "left_anti")
    return kept.unionByName(records.select(*index.columns))


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Known ids only. *ids* may carry a `position`; order by it at the output."""
    return ids.join(index, "id", "inner")


def fetch_states(index: DataFrame, ids: DataFrame) -> DataFrame:
    return fetch(index.select(*[c for c in STATE if c in index.columns]), ids)


def list_state(index: DataFrame) -> DataFrame:
    return index.select(*[c for c in STATE if c in index.columns]).orderBy("id")


def changed_records(plan: DataFrame, index: DataFrame, embedded: DataFrame, spec: EmbeddingSpec) -> DataFrame:
    """The records of a plan that are new or differ, with their vectors."""
    written = assign_vectors(plan, embedded).unionByName(
        reuse_vectors(plan, index), allowMissingColumns=True
    )
    return written.select(
        "id", identity.space_literal(spec).alias("spec"), *WANTED, F.col("embedding").cast("array<double>")
    )


def deleted_records(plan: DataFrame, index: DataFrame) -> DataFrame:
    """(id, document_id) of the records that a plan deletes."""
    gone = plan.filter(F.col("action") == "delete").select("id")
    return index.select("id", F.col("metadata.document_id").alias("document_id")).join(gone, "id", "left_semi")


def synchronized(plan: DataFrame, index: DataFrame, embedded: DataFrame, spec: EmbeddingSpec) -> DataFrame:
    """The next version of the index: plan, stored vectors and new vectors put together."""
    space = identity.space_literal(spec)
    records = changed_records(plan, index, embedded, spec)
    kept = index.join(
        plan.filter(F.col("action") == "unchanged").select("id"), "id", "left_semi"
    ).select("id", space.alias("spec"), *WANTED, F.col("embedding").cast("array<double>"))
    return kept.unionByName(records)
