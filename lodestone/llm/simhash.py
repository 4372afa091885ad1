"""SimHash fingerprints and their links by deletion-variant signatures.

A fingerprint has 64 bits. Two of them link at `DISTANCE` = 2 or fewer differing bits.
They are cut into two segments of 32 bits, so that one segment differs by at most one
bit: every segment is indexed under its 32 variants with one bit deleted, and variants
are joined on equality. Members of one bucket are verified by the count of differing
bits and only a spanning forest of their links leaves the task. A bucket with more than
`BUCKET` fingerprints is not compared pair by pair: its members are joined on the 65
points at one bit or less around each, and two of them share a point exactly when they
differ by two bits or fewer.

Cases: null text counts as empty; a text without words has fingerprint zero and links
like any other; a null doc_id is kept, and its component is the least id of its group
(null if there is none). Rows that repeat an id are fingerprinted each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.flat import slices
from lodestone.llm.tables import read, side
from lodestone.session import stage

DISTANCE, BITS, SEGMENTS = 2, 64, 2
SEGMENT_BITS = BITS // SEGMENTS
SHINGLE_WORDS, SEED = 3, 42
#: Fingerprints of one bucket compared with each other in a task.
BUCKET = 256
#: Byte value -> its bits, one in each byte of a 64-bit lane.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]
LANE_ROWS = 255


def shingle_hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit value for each run of *counts* hashes: the bits set in over half of them."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    firsts = np.cumsum(counts[full]) - counts[full]
    blocks = (counts[full] + LANE_ROWS - 1) // LANE_ROWS
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(int(blocks.sum())) - np.repeat(first_block, blocks)
    starts = np.repeat(firsts, blocks) + within * LANE_ROWS
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    lanes = np.stack([np.add.reduceat(SPREAD[octets[:, j]], starts) for j in range(8)], axis=1)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, BITS).astype(np.int64), first_block, axis=0)
    bits = ones * 2 > counts[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column(1)):
            raw = data.tobytes()
            hashes = [shingle_hashes(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            counts = np.array([len(h) for h in hashes], dtype=np.int64)
            flat = np.fromiter((x for h in hashes for x in h), dtype=np.uint64, count=int(counts.sum()))
            values = majority(flat, counts).view(np.int64)
            own = [batch.column(i).slice(low, high - low) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(values)], ["doc_id", "twin", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, twin, fp) for every row; twin is a hash of the text, fp the fingerprint as a signed number."""
    twin = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), twin.alias("twin"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, twin long, fp long")


def signatures(values: DataFrame) -> DataFrame:
    """(key, fp): segment, deleted bit and the remaining bits of the segment, for each fingerprint."""
    deleted = values.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i"))
    segment = F.expr(f"shiftrightunsigned(fp, int(i div {SEGMENT_BITS}) * {SEGMENT_BITS}) & {(1 << SEGMENT_BITS) - 1}L")
    rest = segment.bitwiseAND(F.expr(f"~shiftleft(1L, i % {SEGMENT_BITS})"))
    return deleted.select((F.col("i").cast("long") * F.lit(1 << SEGMENT_BITS) + rest).alias("key"), "fp")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits differ; of a signed number numpy would count those of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member it is linked to) inside one bucket of sorted fingerprints."""
    near = differing(members[:, None], members[None, :]) <= DISTANCE
    label = np.arange(len(members))
    while True:
        least = np.where(near, label[None, :], len(members)).min(axis=1)
        if (least == label).all():
            break
        label = least
    return [(int(members[i]), int(members[j])) for i, j in enumerate(label.tolist()) if i != j]


def _bucket_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and fp -> links (a, b) inside buckets; (a, null) for members of large ones."""
    held_key, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        near = two[differing(fps[two], fps[two + 1]) <= DISTANCE]
        left, right = [fps[near + 1]], [fps[near]]
        large = []
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if size > BUCKET:
                large.append(fps[start : start + size])
                continue
            found = _forest(fps[start : start + size])
            left.append(np.array([a for a, _ in found], dtype=np.int64))
            right.append(np.array([b for _, b in found], dtype=np.int64))
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        big = np.unique(np.concatenate(large)) if large else np.zeros(0, dtype=np.int64)
        a = pa.array(np.concatenate([pairs[:, 0], big]))
        b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(big), pa.int64())])
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if cut:
            yield from links(keys[:cut], fps[:cut])
        held_key, held = keys[cut:], fps[cut:]
    if len(held):
        yield from links(held_key, held)


def linked(values: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints: enough links to join all that any links join."""
    sorted_keys = signatures(values).repartition("key").sortWithinPartitions("key", "fp")
    found = stage(sorted_keys.mapInArrow(_bucket_links, "a long, b long").distinct(), "simhash-links")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    points = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("i")).select(
        "fp", F.expr("fp ^ if(i < 0, 0L, shiftleft(1L, i))").alias("point")
    )
    centres = points.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
    by_points = points.join(centres.select("point", "least"), "point").where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return found.where("b is not null").union(by_points.distinct())


def _placed(rows: DataFrame) -> DataFrame:
    """(fp, least_id, component) for every fingerprint; component is the least fingerprint of its group."""
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    parts = connected_components(linked(values.select("fp"))).withColumnRenamed("node", "fp")
    placed = values.join(parts, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    return stage(placed, "simhash-parts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, twin, fingerprint, component_id) for every row of *docs*."""
    rows = stage(fingerprints(docs, id_col, text_col), "simhash")
    placed = _placed(rows)
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", "twin", F.lpad(F.lower(F.hex("fp")), BITS // 4, "0").alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of *docs*, with its columns, for each group of near copies.

    It is the row with the least id (null is larger than any), of those the one with the
    least hash of its text, of rows equal in both any one. Groups are told apart by their
    fingerprints: one id may stand in several groups.
    """
    rows = stage(fingerprints(docs, id_col, text_col), "simhash")
    found = stage(rows.join(_placed(rows), "fp").select("doc_id", "twin", "component"), "simhash-groups")
    return keep_one_of_each(docs, found, id_col, text_col)


def keep_one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of *docs* for each component of *found* (doc_id, twin, component), chosen as above."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "twin")
    first = found.groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.twin", F.lit(0).alias("n"), F.lit(True).alias("stays"))
    counts = found.select("doc_id", "twin", F.lit(1).alias("n"), F.lit(False).alias("stays")).union(first)
    counts = stage(counts.groupBy("doc_id", "twin").agg(F.sum("n").alias("n"), F.max("stays").alias("stays")), "simhash-stays")

    def named(rows, name):
        rows = rows.select(F.col("doc_id").alias(f"{name}__id"), F.col("twin").alias(f"{name}__twin"))
        return side(rows, f"simhash-{name}", F.lit(16)), own_id.eqNullSafe(F.col(f"{name}__id")) & (twin == F.col(f"{name}__twin"))

    own_id, twin = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = docs.join(*named(counts.where("not stays"), "drop"), "left_anti")
    again, same = named(counts.where("stays and n > 1"), "again")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, same, "left_semi")
    one = repeated.groupBy(own_id.alias("again__id"), twin.alias("again__twin")).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("again__row"))
    return kept.join(again, same, "left_anti").union(one.select("again__row.*"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("twin")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLE: dict[str, str] = {}
