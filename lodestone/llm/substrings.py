"""Removal of passages of 50 words or more that a document with a smaller id has.

Every window of 50 consecutive words gets a 64-bit Rabin-Karp hash. Spark brings equal
hashes together and the least doc_id of each is found; windows of other documents are
repeats, and overlapping repeats merge into maximal removal intervals.

How the rows travel: a task first settles the windows it can (the least document of a
hash within the task stays, the others are repeats already), so a passage that a third
of all documents share is sent once per task and not once per document. What is left is
packed into one binary row per target partition: 8 bytes of hash and about 2 of place
for each window, which is a fifth of one row per window. Repeated windows go by a hash of
doc_id and text, so rows with null or one equal doc_id are spread like any others; rows
equal in both have the same windows and are sent once per task.

Windows are compared by their hash. Two different windows agree with a probability of
2**-64 for each pair that is compared (about 4e-4 for one wrong pair among all 130
million windows of the larger check tables).

Cases: null text counts as empty; a document with fewer than 50 words has no window; a
repeat inside one document is no repeat; rows with one doc_id are judged separately
against smaller ids and never against each other; a null doc_id is larger than any other,
so such rows lose what others have.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.flat import Words, mix, slices
from lodestone.llm.tables import parallelism, read, side

WINDOW = 50
#: Windows a task holds before it settles and sends them.
HELD = 1_000_000
NO_ID = np.iinfo(np.int64).max
MARKED = "doc_id long, twin long, starts array<int>, ends array<int>"


# --- packed places: (document, position) pairs in order ------------------------
def pack_places(docs: np.ndarray, positions: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Runs of a document with their lengths; positions as steps, long ones apart."""
    new = np.concatenate([[True], docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, dtype=bool)
    runs = np.flatnonzero(new)
    steps = np.diff(positions, prepend=0)
    steps[runs] = positions[runs]
    long = steps >= 255
    head = np.stack([docs[runs], np.diff(np.append(runs, len(docs)))], axis=1).astype("<i8")
    return head.tobytes(), np.where(long, 255, steps).astype(np.uint8).tobytes(), steps[long].astype("<i4").tobytes()


def unpack_places(head: bytes, steps: bytes, long: bytes) -> tuple[np.ndarray, np.ndarray]:
    head = np.frombuffer(head, dtype="<i8").reshape(-1, 2)
    steps = np.frombuffer(steps, dtype=np.uint8).astype(np.int64)
    steps[steps == 255] = np.frombuffer(long, dtype="<i4")
    docs = np.repeat(head[:, 0], head[:, 1])
    total = np.cumsum(steps)
    firsts = np.cumsum(head[:, 1]) - head[:, 1]
    before = total[firsts] - steps[firsts] if len(firsts) else firsts
    return docs, total - np.repeat(before, head[:, 1])


PACKED = pa.schema(
    [("part", pa.int32()), ("settled", pa.bool_()), ("ids", pa.binary()), ("hashes", pa.binary()), ("head", pa.binary()), ("steps", pa.binary()), ("long", pa.binary())]
)
PACKED_SQL = "part int, settled boolean, ids binary, hashes binary, head binary, steps binary, long binary"


def _least(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row, whether its id is the least of its hash."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.minimum.reduceat(ids[order], starts)
    out = np.empty(len(hashes), dtype=bool)
    out[order] = ids[order] == np.repeat(least, np.diff(np.append(starts, len(hashes))))
    return out


def _dealt(ids: np.ndarray, twins: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a document, by its id and text."""
    spread = mix(mix(ids.astype(np.uint64)) ^ twins.astype(np.uint64))
    return (spread >> np.uint64(32)).astype(np.int64) * parts >> 32


def _windows(parts: int, size: int):
    def send(ids, twins, hashes, docs, positions) -> Iterator[pa.RecordBatch]:
        """ids, twins: of each held document; docs: index of a window's document."""
        if not len(hashes):
            return
        first = np.zeros(len(ids), dtype=bool)
        first[np.unique(np.stack([ids, twins], axis=1), axis=0, return_index=True)[1]] = True
        once = first[docs]
        hashes, docs, positions = hashes[once], docs[once], positions[once]
        least = _least(hashes, ids[docs])
        target = (hashes >> np.uint64(32)).astype(np.int64) * parts >> 32
        rows = []
        for settled, chosen in ((False, np.flatnonzero(least)), (True, np.flatnonzero(~least))):
            goes = target[chosen] if not settled else _dealt(ids[docs[chosen]], twins[docs[chosen]], parts)
            chosen = chosen[np.argsort(goes, kind="stable")]
            goes = np.sort(goes)
            cuts = np.flatnonzero(np.concatenate([[True], goes[1:] != goes[:-1]])) if len(goes) else []
            for low, high in zip(cuts, np.append(cuts[1:], len(goes)) if len(goes) else []):
                own = chosen[low:high]
                used, local = np.unique(docs[own], return_inverse=True)
                table = np.stack([ids[used], twins[used]], axis=1).astype("<i8").tobytes()
                rows.append((int(goes[low]), settled, table, b"" if settled else hashes[own].tobytes(), *pack_places(local, positions[own])))
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, PACKED)], schema=PACKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, count = [], 0, 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            twins = batch.column(2).to_numpy()
            for low, high, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                starts, hashes = words.windows(words.hashes(), size)
                rows = words.rows[starts]
                held.append((ids[low:high], twins[low:high], hashes, rows + documents, starts - words.firsts[rows]))
                documents += high - low
                count += len(hashes)
                if count >= HELD:
                    yield from send(*map(np.concatenate, zip(*held)))
                    held, documents, count = [], 0, 0
        if held:
            yield from send(*map(np.concatenate, zip(*held)))

    return run


def _by_document(ids, twins, positions, parts: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows, packed by the partition of their document."""
    goes = _dealt(ids, twins, parts)
    order = np.lexsort((positions, twins, ids, goes))
    goes, ids, twins, positions = goes[order], ids[order], twins[order], positions[order]
    cuts = np.flatnonzero(np.concatenate([[True], goes[1:] != goes[:-1]])) if len(goes) else []
    for low, high in zip(cuts, np.append(cuts[1:], len(goes)) if len(goes) else []):
        new = np.concatenate([[True], (np.diff(ids[low:high]) != 0) | (np.diff(twins[low:high]) != 0)])
        table = np.stack([ids[low:high][new], twins[low:high][new]], axis=1).astype("<i8").tobytes()
        row = (int(goes[low]), True, table, b"", *pack_places(np.cumsum(new) - 1, positions[low:high]))
        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, PACKED)], schema=PACKED)


def _repeats(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        counted = [row for row in rows if not row["settled"]]
        tables = [np.frombuffer(row["ids"], dtype="<i8").reshape(-1, 2) for row in counted]
        masks = [np.ones(len(row["steps"]), dtype=bool) for row in rows if row["settled"]]
        if counted:
            hashes = np.concatenate([np.frombuffer(row["hashes"], dtype=np.uint64) for row in counted])
            heads = [np.frombuffer(row["head"], dtype="<i8").reshape(-1, 2) for row in counted]
            ids = np.concatenate([np.repeat(t[h[:, 0], 0], h[:, 1]) for t, h in zip(tables, heads)])
            repeat = ~_least(hashes, ids)
            del hashes, ids
            masks += np.split(repeat, np.cumsum([len(row["steps"]) for row in counted])[:-1])
        places = []
        for row, mask in zip([row for row in rows if row["settled"]] + counted, masks):
            docs, positions = unpack_places(row["head"], row["steps"], row["long"])
            table = np.frombuffer(row["ids"], dtype="<i8").reshape(-1, 2)[docs[mask]]
            places.append((table[:, 0], table[:, 1], positions[mask]))
        if places:
            yield from _by_document(*map(np.concatenate, zip(*places)), parts)

    return run


def _merged(size: int):
    """All repeated windows of a document -> its maximal removal intervals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = []
        for batch in batches:
            for row in batch.to_pylist():
                docs, positions = unpack_places(row["head"], row["steps"], row["long"])
                table = np.frombuffer(row["ids"], dtype="<i8").reshape(-1, 2)[docs]
                places.append((table[:, 0], table[:, 1], positions))
        if not places:
            return
        ids, twins, positions = map(np.concatenate, zip(*places))
        if not len(ids):
            return
        order = np.lexsort((positions, twins, ids))
        ids, twins, positions = ids[order], twins[order], positions[order]
        new_doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (twins[1:] != twins[:-1])])
        firsts = np.flatnonzero(new_doc | np.concatenate([[True], positions[1:] > positions[:-1] + size]))
        ends = positions[np.append(firsts[1:], len(ids)) - 1] + size
        doc_rows = np.flatnonzero(new_doc[firsts])
        offsets = pa.array(np.append(doc_rows, len(firsts)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (positions[firsts], ends)]
        at = firsts[doc_rows]
        table = pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(twins[at]), *lists], ["doc_id", "twin", "starts", "ends"])
        for low in range(0, table.num_rows, 10_000):
            yield table.slice(low, 10_000)

    return run


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, twin, starts, ends): the maximal word intervals covered by repeated windows.

    twin is a hash of the text; it tells rows with one doc_id apart.
    """
    parts = parallelism(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("twin"))
    packed = rows.mapInArrow(_windows(parts, window), PACKED_SQL).repartitionById(parts, F.col("part"))
    repeats = packed.mapInArrow(_repeats(parts), PACKED_SQL).repartitionById(parts, F.col("part"))
    found = repeats.mapInArrow(_merged(window), MARKED)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")))


def removed_words(starts, ends, count: int) -> np.ndarray:
    """The words covered by any of the intervals."""
    step = np.zeros(count + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, starts, ends = batch.column(1), batch.column(2), batch.column(3)
        counts, removed, kept = [], [], []
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or "").encode().split()
            counts.append(len(words))
            if starts[i].is_valid:
                gone = removed_words(starts[i].values.to_numpy(), ends[i].values.to_numpy(), len(words))
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            removed.append(counts[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text of the words that stay, joined by one space."""
    cut = side(repeated_intervals(docs, id_col, text_col, window), "repeats", 40 + 8 * F.size("starts"))
    cut = cut.select(F.col("doc_id").alias("cut_id"), "twin", "starts", "ends")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.xxhash64("text") == F.col("twin")), "left")
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(_keep, KEPT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE: dict[str, str] = {}
