"""Document fingerprints by one-permutation MinHash.

The hash of every five-word shingle is computed once; its first byte names one of `BINS`
bins, which keeps its least hash. An empty bin takes the value of another by optimal
densification: each bin has its own order of donors, the same for all documents. Stored
are the low `BITS` bits of every bin, one byte each, in hexadecimal. Two bins agree by
chance once in 2**BITS; the likeness is the share of equal bins corrected for that.

Two texts follow each other through the documents (`edited_pairs`): each partition holds
a range of ids and, besides, the first document of the next range, so texts are shuffled
once and no task needs another's rows.

Cases: null text counts as empty; a text of fewer than five words has one shingle, all of
it; a text without words has the empty fingerprint, alike (1.0) only to another of those;
null ids come first; rows with one id follow each other in the order of their texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.flat import WINDOW_BASE, Words, mix, prefix, ranges
from lodestone.llm.tables import parallelism, read

SHINGLE_WORDS = 5
BINS, BITS = 256, 8
BATCH_BYTES = 1 << 20
FIRST_ID = np.iinfo(np.int64).min


@cache
def donors() -> np.ndarray:
    """Row i: the order in which bin i asks the other bins when it is empty."""
    keys = mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BINS, BINS)
    return np.argsort(keys, axis=1)


def bins(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BINS low bits of the bins, whether a text has any shingle)."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    hashes = words.hashes()
    starts, shingles = words.windows(hashes, SHINGLE_WORDS)
    rows = words.rows[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE_WORDS))
    if len(short):
        sums = prefix(hashes, WINDOW_BASE)
        own = ranges(sums, words.firsts[short], words.firsts[short + 1], WINDOW_BASE)
        rows, shingles = np.append(rows, short), np.append(shingles, mix(own + words.counts[short].astype(np.uint64)))
    least = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    place = rows * BINS + (shingles >> np.uint64(56)).astype(np.int64)
    np.minimum.at(least, place, shingles & np.uint64((1 << 56) - 1))
    least = least.reshape(-1, BINS)
    filled = least != np.iinfo(np.uint64).max
    low = (least & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    some = filled.any(axis=1)
    row, empty = np.nonzero(~filled & some[:, None])
    for attempt in range(BINS):
        if not len(row):
            break
        donor = donors()[empty, attempt]
        found = filled[row, donor]
        low[row[found], empty[found]] = low[row[found], donor[found]]
        row, empty = row[~found], empty[~found]
    return low, some


def fingerprint_texts(low: np.ndarray, some: np.ndarray) -> list[str]:
    return [x.tobytes().hex() if s else "" for x, s in zip(low, some.tolist())]


def likeness(left: np.ndarray, left_some: np.ndarray, right: np.ndarray, right_some: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles, 0 to 1, row by row."""
    chance = 2.0**-BITS
    value = np.clip(((left == right).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(left_some & right_some, value, (left_some == right_some).astype(float))


def edited_text(text: str, other: str) -> str:
    """The last quarter of *text* replaced by the first characters of *other*, as many or all."""
    size = len(text) // 4
    return text[: len(text) - size] + other[:size]


def _deal(bounds):
    """Each row to the range of its id; the first id of a range also to the range before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = bounds.value
        for batch in batches:
            ids = batch.column(0).fill_null(FIRST_ID).to_numpy()
            goes = np.maximum(np.searchsorted(firsts, ids, "right") - 1, 0)
            again = np.flatnonzero(firsts[goes] == ids)
            taken = np.append(np.arange(len(ids)), again)
            dest = np.append(goes, (goes[again] - 1) % len(firsts))
            extra = np.append(np.zeros(len(ids), dtype=bool), np.ones(len(again), dtype=bool))
            own = batch.take(pa.array(taken))
            yield pa.RecordBatch.from_arrays([pa.array(dest.astype(np.int32)), pa.array(extra), own.column(0), own.column(1)], ["dest", "extra", "doc_id", "text"])

    return run


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(dest, extra, doc_id, text), sorted inside partitions: ranges of ids, and behind each the next id's row."""
    spark = docs.sparkSession
    parts = parallelism(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(int(FIRST_ID))).alias("id"))
    steps = F.array(*[F.lit(i / parts) for i in range(parts)])
    found = ids.agg(F.min("id").alias("low"), F.percentile_approx("id", steps, 10_000).alias("marks")).first()
    firsts = np.unique(np.array([found["low"] if found["low"] is not None else 0, *(found["marks"] or [])], dtype=np.int64))
    dealt = rows.mapInArrow(_deal(spark.sparkContext.broadcast(firsts)), "dest int, extra boolean, doc_id long, text string")
    return dealt.repartitionById(parts, F.col("dest")).sortWithinPartitions("dest", "extra", "doc_id", "text")


PAIRED = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(id, text, next text) of all rows that are not extra."""
    last = None
    for batch in batches:
        for dest, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if last is not None and last[0] == dest:
                yield last[1], last[2], text or ""
                last = None
            last = None if extra else (dest, doc_id, text or "")


def _fingerprint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, str, str]] = []
    size = 0

    def send() -> pa.RecordBatch:
        ids, texts, others = zip(*held)
        edited = [edited_text(t, o) for t, o in zip(texts, others)]
        own, some = bins([t.encode() for t in (*texts, others[-1])])
        changed, changed_some = bins([t.encode() for t in edited])
        next_low, next_some = own[1:], some[1:]
        own, some = own[:-1], some[:-1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(edited, pa.string()),
                pa.array(fingerprint_texts(own, some), pa.string()), pa.array(fingerprint_texts(changed, changed_some), pa.string()),
                pa.array(likeness(own, some, changed, changed_some)), pa.array(likeness(own, some, next_low, next_some)),
            ],
            [f.split()[0] for f in PAIRED.split(", ")],
        )

    # Pairs inside one range follow each other, so the next text of one is the text of the
    # following; a batch ends where that does not hold.
    for pair in _pairs(batches):
        if held and (size >= BATCH_BYTES or held[-1][2] is not pair[1] and held[-1][2] != pair[1]):
            yield send()
            held, size = [], 0
        held.append(pair)
        size += len(pair[1])
    if held:
        yield send()


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to that and to the next text."""
    return neighbours(docs, id_col, text_col).mapInArrow(_fingerprint, PAIRED)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_pairs(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


QUERIES = {"op3_document_fingerprints": op3_document_fingerprints}
ORACLE: dict[str, str] = {}
