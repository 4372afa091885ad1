"""The vector index as a versioned Parquet table of buckets, and its flat exchange form.

Records are dealt to buckets by their document. A version is a manifest: one small file that
names, for every bucket, the folder its rows are in. A change writes the buckets it touches
anew and takes the other folders over from the version it starts from (copy-on-write), so
readers of any version are never disturbed. A manifest's file name is its number and it is
created only if absent: of two writers that start from one version, the second is refused.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import identity, indexing
from lodestone.policies import EmbeddingSpec

SEPARATOR = " > "
BUCKETS = 64
NEWEST = -1


class ConcurrentWrite(RuntimeError):
    """Another writer committed a version after the one this change starts from."""


@dataclass(frozen=True)
class Manifest:
    version: int
    spec_identity: str
    written_at: str
    buckets: int
    schema: str
    #: Bucket -> folder under data/; buckets without rows are absent.
    folders: dict[str, str]
    #: The last batch of each stream that is part of this version.
    batches: dict[str, int]


# --- manifests ------------------------------------------------------------------
def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest committed version; null before the first write."""
    files, folder = _place(spark, f"{root}/versions")
    if not files.exists(folder):
        return None
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return max((int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit()), default=None)


def manifest(spark: SparkSession, root: str, version: int) -> Manifest:
    files, path = _place(spark, f"{root}/versions/{version:012d}.json")
    if not files.exists(path):
        raise ValueError(f"no committed version {version} under {root}")
    text = spark.read.text(f"{root}/versions/{version:012d}.json", wholetext=True).first()[0]
    return Manifest(**json.loads(text))


def _commit(spark: SparkSession, root: str, made: Manifest) -> None:
    """Publish a manifest under its number, whole or not at all, unless the number is taken."""
    files, written = _place(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    _, final = _place(spark, f"{root}/versions/{made.version:012d}.json")
    out = files.create(written, False)
    out.write(bytearray(json.dumps(asdict(made)).encode()))
    out.close()
    if files.getScheme() == "file":  # a rename would replace a file here, a link does not
        try:
            os.link(written.toUri().getPath(), final.toUri().getPath())
            done = True
        except FileExistsError:
            done = False
        files.delete(written, False)
    else:
        done = files.rename(written, final)
    if not done:
        files.delete(written, False)
        raise ConcurrentWrite(f"version {made.version} of {root} was committed by another writer")


# --- reading --------------------------------------------------------------------
def bucket_of(document_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def _document(records: DataFrame) -> Column:
    """What a record is dealt by: its document, or its id where the metadata names none."""
    named = "document_id" in records.schema["metadata"].dataType.names
    return F.col("metadata.document_id") if named else F.col("id")


def _read_folders(spark: SparkSession, root: str, schema: str, folders: dict[str, str]) -> DataFrame:
    wanted = StructType.fromJson(json.loads(schema))
    if not folders:
        return spark.createDataFrame([], wanted)
    paths = [f"{root}/data/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
    read = spark.read.schema(wanted).option("basePath", f"{root}/data").parquet(*paths)
    return read.drop("write", "bucket")


def read_index(
    spark: SparkSession, root: str, version: int | None = None, buckets: set[int] | None = None
) -> DataFrame:
    """The rows of a version, the newest by default; of some buckets only if *buckets* are given."""
    found = version or current_version(spark, root)
    if found is None:
        raise ValueError(f"no committed index under {root}")
    known = manifest(spark, root, found)
    folders = {b: f for b, f in known.folders.items() if buckets is None or int(b) in buckets}
    return _read_folders(spark, root, known.schema, folders)


# --- writing --------------------------------------------------------------------
def _write_buckets(rows: DataFrame, root: str, buckets: int, spec: EmbeddingSpec) -> tuple[str, dict[str, str]]:
    """Write *rows* into a folder of their own; returns their schema and the folder of each bucket.

    Rows are laid out by visibility, which every search filters on. Large buckets are
    split into several files.
    """
    spark = rows.sparkSession
    folder = f"write={uuid.uuid4().hex}"
    placed = rows.withColumn("bucket", bucket_of(_document(rows), buckets)).withColumn(
        "visibility", F.col("metadata.visibility")
    )
    placed.hint("rebalance", "bucket").write.partitionBy("bucket", "visibility").parquet(f"{root}/data/{folder}")
    written = spark.read.schema(placed.schema).parquet(f"{root}/data/{folder}")
    indexing.require_valid_vectors(written, spec)
    present = [r["bucket"] for r in written.select("bucket").distinct().collect()]
    return placed.drop("bucket").schema.json(), {str(b): folder for b in present}


def write_index(
    records: DataFrame, root: str, spec: EmbeddingSpec, buckets: int = BUCKETS, base: int | None = NEWEST
) -> int:
    """Write a complete new version, check it, then commit it.

    Readers keep the old version until its manifest exists, so a failed write changes
    nothing. *base* is the version this one replaces (None: there is none); when another
    has been committed since, the write is refused.
    """
    spark = records.sparkSession
    base = current_version(spark, root) if base == NEWEST else base
    schema, folders = _write_buckets(records, root, buckets, spec)
    version = (base or 0) + 1
    _commit(spark, root, Manifest(version, spec.identity, _now(), buckets, schema, folders, {}))
    return version


def update_index(
    puts: DataFrame,
    deletes: DataFrame,
    root: str,
    spec: EmbeddingSpec,
    base: int,
    batch: tuple[str, int] | None = None,
) -> int:
    """Commit version *base* with records put in place of those with their id, and ids deleted.

    deletes(id, document_id). A record's id stands for one document for good. Only the
    buckets of these documents are read and written; nothing changes the others' files.
    *batch* (stream, number) is noted in the manifest.
    """
    spark = puts.sparkSession
    old = manifest(spark, root, base)
    gone = puts.select("id", _document(puts).alias("document_id")).unionByName(deletes.select("id", "document_id"))
    touched = {
        r["b"] for r in gone.select(bucket_of(F.col("document_id"), old.buckets).alias("b")).distinct().collect()
    }  # at most as many as there are buckets
    if not touched:
        rows, fresh = None, {}
    else:
        stored = read_index(spark, root, base, touched).drop("visibility")
        rows = stored.join(gone.select("id"), "id", "left_anti").unionByName(puts.select(*stored.columns))
        _, fresh = _write_buckets(rows, root, old.buckets, spec)
    kept = {b: f for b, f in old.folders.items() if int(b) not in touched}
    batches = old.batches | ({batch[0]: batch[1]} if batch else {})
    made = replace(old, version=base + 1, written_at=_now(), folders=kept | fresh, batches=batches)
    _commit(spark, root, made)
    return made.version


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


FLAT = (
    "chunk_id", "document_id", "document_title", "heading_path", "source_path", "document_type",
    "language", "visibility", "trust_level", "topics", "technologies",
)


def index_payload(index: DataFrame) -> DataFrame:
    """Records -> id, values and flat meta_* columns; the heading path becomes one text."""
    def field(name: str):
        stored = "title" if name == "document_title" else name
        value = F.col(f"metadata.{stored}")
        return F.array_join(value, SEPARATOR) if name == "heading_path" else value

    prints = ("embedding_fingerprint", "chunk_fingerprint", "document_fingerprint")
    return index.select(
        "id",
        F.col("embedding").alias("values"),
        *[field(name).alias(f"meta_{name}") for name in FLAT],
        *[F.col(name).alias(f"meta_{name}") for name in prints],
        identity.space_identity(F.col("spec")).alias("meta_embedding_space"),
    )


def index_from_payload(payload: DataFrame, spec: EmbeddingSpec) -> DataFrame:
    """The inverse: flat rows back to index records."""
    heading = F.col("meta_heading_path")
    path = F.when(heading == "", F.array().cast("array<string>")).otherwise(F.split(heading, SEPARATOR))

    def field(name: str):
        if name == "heading_path":
            return path.alias(name)
        return F.col(f"meta_{name}").alias("title" if name == "document_title" else name)

    prints = ("embedding_fingerprint", "chunk_fingerprint", "document_fingerprint")
    return payload.select(
        "id",
        identity.space_literal(spec).alias("spec"),
        *[F.col(f"meta_{name}").alias(name) for name in prints],
        F.struct(*[field(name) for name in FLAT]).alias("metadata"),
        F.col("values").alias("embedding"),
    )
