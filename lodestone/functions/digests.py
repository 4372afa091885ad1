"""Canonical forms and SHA-256 digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.policies import ChunkingPolicy, EmbeddingSpec


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and explicit nulls."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


METADATA_FIELDS = (
    "document_type",
    "id",
    "language",
    "license",
    "schema_version",
    "source",
    "source_type",
    "technologies",
    "title",
    "topics",
    "trust_level",
    "updated_at",
    "version",
    "visibility",
)


def document_fingerprint(metadata: Column, body: Column) -> Column:
    """Over the authored metadata and the body; paths and times are left out."""
    json = canonical_json(**{name: metadata[name] for name in METADATA_FIELDS})
    return sha256(F.concat(json, F.lit("\0"), body))


def chunk_fingerprint(
    policy: ChunkingPolicy, document_id: Column, heading_path: Column, content: Column
) -> Column:
    """Over what a chunk contains. Its position and its document's digest are left out."""
    limits = F.struct(
        F.lit(policy.max_chars).alias("max_chars"),
        F.lit(policy.overlap_chars).alias("overlap_chars"),
        F.lit(policy.target_chars).alias("target_chars"),
    )
    return sha256(
        canonical_json(
            content=content,
            document_id=document_id,
            heading_path=heading_path,
            policy=limits,
            strategy_version=F.lit(k.CHUNKING_STRATEGY),
        )
    )


def embedding_fingerprint(text: Column, spec: EmbeddingSpec) -> Column:
    """Changes exactly when a new vector is needed."""
    space = F.struct(
        F.lit(spec.dimensions).alias("dimensions"),
        F.lit(spec.model).alias("model"),
        F.lit(spec.provider).alias("provider"),
        F.lit(spec.representation_version).alias("representation_version"),
    )
    return sha256(canonical_json(spec=space, text=text))


def digest_sums(line: Column) -> list[Column]:
    """Aggregates of a set digest: eight sums over the 32-bit words of each row's SHA-256.

    Addition commutes, so rows need no order, each task keeps eight numbers and the
    partial sums combine before the shuffle.
    """
    row = sha256(line)
    return [
        F.sum(
            F.conv(F.substring(row, 1 + 8 * word, 8), 16, 10).cast("decimal(20,0)")
        ).alias(f"_d{word}")
        for word in range(8)
    ]


def finish_digest() -> Column:
    parts = [F.coalesce(F.col(f"_d{word}").cast("string"), F.lit("0")) for word in range(8)]
    return sha256(F.concat_ws(":", *parts))


def set_digest(rows: DataFrame, line: Column, name: str = "sha256") -> DataFrame:
    """One row: how many rows there are and the digest of the whole set."""
    totals = rows.agg(F.count(F.lit(1)).alias("rows"), *digest_sums(line))
    return totals.select("rows", finish_digest().alias(name))
