"""Continuous index sync: every micro-batch of documents becomes one version of the index table.

A batch reads and writes only the buckets of the documents it holds. The number of the last
batch stands in the manifest, so a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import chunking, embeddings, indexing
from lodestone.plans.index_sync import empty_index
from lodestone.policies import ChunkingPolicy, EmbeddingSpec
from lodestone.session import stage
from lodestone.sources import index_table


def live_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest state of every record; null before the first batch."""
    if index_table.current_version(spark, root) is None:
        return None
    return index_table.read_index(spark, root)


def apply_batch(
    documents: DataFrame,
    batch_id: int,
    root: str,
    spec: EmbeddingSpec,
    provider: embeddings.Embedder,
    policy: ChunkingPolicy = ChunkingPolicy(),
    stream: str = "documents",
) -> None:
    """Commit the changes of one batch; a batch of *stream* that is part of the index is left out.

    When a document comes twice in a batch, its row with the greatest fingerprint wins,
    so that every replay decides alike.
    """
    spark = documents.sparkSession
    found = index_table.current_version(spark, root)
    known = index_table.manifest(spark, root, found) if found else None
    if known and known.batches.get(stream, -1) >= batch_id:
        return
    fields = [c for c in documents.columns if c != "document_id"]
    latest = (
        documents.groupBy("document_id")
        .agg(F.max_by(F.struct(*fields), "document_fingerprint").alias("d"))
        .select("document_id", "d.*")
    )
    docs = stage(latest, "batch")
    desired = indexing.desired_state(chunking.chunk_corpus(docs, policy), spec)
    if known is None:
        empty = empty_index(desired, spec)
        found = index_table.write_index(empty, root, spec, base=None)
        known = index_table.manifest(spark, root, found)
    bucket = index_table.bucket_of(F.col("document_id"), known.buckets)
    touched = {r["b"] for r in docs.select(bucket.alias("b")).distinct().collect()}
    actual = index_table.read_index(spark, root, found, touched).join(
        docs.select("document_id"), F.col("metadata.document_id") == docs["document_id"], "left_semi"
    )
    plan = stage(indexing.plan_index(desired, actual), "plan")
    needed = indexing.embeddings_required(plan)
    made = stage(
        embeddings.embed(needed, "embedding_fingerprint", "embedding_text", provider), "vectors"
    )
    puts = stage(indexing.changed_records(plan, actual, made, spec), "puts")
    deletes = stage(indexing.deleted_records(plan, actual), "deletes")
    index_table.update_index(puts, deletes, root, spec, found, (stream, batch_id))


def stream_index_sync(
    documents: DataFrame,
    root: str,
    spec: EmbeddingSpec,
    provider: embeddings.Embedder,
    checkpoint: str,
    policy: ChunkingPolicy = ChunkingPolicy(),
    **trigger,
) -> StreamingQuery:
    """documents is a stream of new and changed documents (the input of chunk_corpus).

    A file stream does not see removed files: deleting whole documents stays with the
    batch job. One stream writes to *root*; it is named by its checkpoint.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, root, spec, provider, policy, checkpoint)

    writer = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def compact(spark: SparkSession, root: str, target: str, spec: EmbeddingSpec) -> int:
    """Write the live index whole, as a new version of the index table *target*."""
    live = live_index(spark, root)
    if live is None:
        raise ValueError(f"no changes under {root}")
    return index_table.write_index(live.drop("visibility"), target, spec)
