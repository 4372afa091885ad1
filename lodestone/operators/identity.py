"""Identities of corpora, file sets, embedding spaces and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.functions import digests
from lodestone.policies import EmbeddingSpec


def corpus_identity(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, sha256 over the set of (document, fingerprint).

    chunks(document_id, document_fingerprint). The digest is a set digest: a flat
    hash over all lines in order would have to run in one task.
    """
    per_document = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("document_fingerprint").alias("fingerprint")
    )
    line = F.concat("document_id", F.lit(":"), "fingerprint")
    return per_document.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        *digests.digest_sums(line),
    ).select("documents", "chunks", digests.finish_digest().alias("sha256"))


def files_identity(files: DataFrame) -> DataFrame:
    """files(source_path, content binary) -> one row: files, sha256 of the whole set."""
    line = F.concat("source_path", F.lit("\0"), F.sha2("content", 256))
    return digests.set_digest(files, line).withColumnRenamed("rows", "files")


def file_digests(files: DataFrame) -> DataFrame:
    """Per-file SHA-256, as recorded for a question set or a suite file."""
    return files.select("source_path", F.sha2("content", 256).alias("sha256"))


def space_identity(spec: Column) -> Column:
    return F.concat_ws(
        ":",
        spec["provider"],
        spec["model"],
        spec["dimensions"].cast("string"),
        spec["representation_version"],
    )


def space_literal(spec: EmbeddingSpec) -> Column:
    return F.struct(
        F.lit(spec.provider).alias("provider"),
        F.lit(spec.model).alias("model"),
        F.lit(spec.dimensions).alias("dimensions"),
        F.lit(spec.representation_version).alias("representation_version"),
    )


def foreign_spaces(index: DataFrame, spec: EmbeddingSpec) -> DataFrame:
    """Spaces in the index (column *spec*) other than the wanted one, with record counts."""
    return (
        index.groupBy(space_identity(F.col("spec")).alias("space"))
        .agg(F.count(F.lit(1)).alias("records"))
        .filter(F.col("space") != spec.identity)
    )


def require_space(index: DataFrame, spec: EmbeddingSpec) -> None:
    """Raise when any record was made in another space."""
    found = [row.space for row in foreign_spaces(index, spec).limit(20).collect()]
    if found:
        raise ValueError(f"index holds {sorted(found)}, not {spec.identity}")


def _field(run: Column, path: str) -> Column:
    for name in path.split("."):
        run = run[name]
    return run


def run_identity(
    runs: DataFrame, run: str, question_ids: str, fields: Sequence[str] = k.IDENTITY_FIELDS
) -> DataFrame:
    """Adds *identity* (field -> JSON text) and *identity_sha256* to a table of runs.

    *run* names the struct column of run settings, *question_ids* the ordered ids.
    """

    def text(path: str) -> Column:
        wrapped = F.to_json(F.struct(_field(F.col(run), path).alias("v")), {"ignoreNullFields": "false"})
        return F.substring(wrapped, 6, F.length(wrapped) - 6)

    ids = F.to_json(question_ids)
    ordered = sorted([*fields, "question_ids"])
    entries = [F.lit(p) if p else p for p in ordered]
    values = [ids if p == "question_ids" else text(p) for p in ordered]
    pairs = [c for pair in zip(entries, values, strict=True) for c in pair]
    canonical = F.concat_ws(
        ",", *[F.concat(F.lit(f'"{p}":'), v) for p, v in zip(ordered, values, strict=True)]
    )
    return runs.withColumn("identity", F.create_map(*pairs)).withColumn(
        "identity_sha256", digests.sha256(F.concat(F.lit("{"), canonical, F.lit("}")))
    )


def identity_mismatches(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Fields in which two identities of one run differ: key, field, before, now."""

    def unpivot(runs: DataFrame, name: str) -> DataFrame:
        return runs.select(key, F.explode("identity").alias("field", name))

    both = unpivot(stored, "before").join(unpivot(current, "now"), [key, "field"], "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("now")))
