"""Removal of repeated and nearly repeated lines by a segment-partition edit join.

Lines are near when few enough characters are inserted, deleted or replaced. How many is a
parameter: `classes` names least lengths and the edits from there on, and the shorter line
of a pair decides. `CLASSES` allows 2 edits from 16 characters (at least 0.87 of the longer
line agrees), `TENTHS` about a tenth of the length; lines below the first class only repeat
exactly. A line of a class of e edits is cut into e + 1 segments, of which e edits leave one
whole. Segments are indexed under line length, place and content; a line probes, for its
own length and the e below, the substrings that a segment may have moved to. Keys meet
in Spark, packed into one binary row per task, target partition and class. A sketch of 16
letter counters travels with each key and rejects most pairs that share a segment only; the
rest is verified by a bit-parallel edit distance in a band of 2 * e + 1 cells.

Classes are the connected components of links. Of all occurrences of all lines of a class
the first, by (doc_id, line), stays; the others are removed. Lines without any character
but white space are never compared nor removed. Lines are identified by a 64-bit hash.

Cases: null text counts as empty; rows with one doc_id and one text are judged as one,
other rows with that id each; null doc_ids come last among occurrences; a text may lose
all its lines and is then empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.flat import WORD_BASE, mix, powers
from lodestone.llm.tables import parallelism, read, released, side
from lodestone.session import stage

Classes = tuple[tuple[int, int], ...]
#: (least length, edits) of classes of line lengths, lengths and edits rising.
CLASSES = ((16, 2),)
#: Wider classes for callers who pay for them: a line has about edits ** 3 / 3 probes.
TENTHS = ((16, 2), (40, 4), (80, 8))
#: Characters of distinct lines a task holds before it sends their keys.
HELD_CHARS = 1_000_000
#: Entries of one key compared at once.
GROUP = 48
BLOCK = 512
SOLID = r"[^\x20\x09-\x0D]"
NO_ID = np.iinfo(np.int64).max


# --- keys ----------------------------------------------------------------------
def segments(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of edits + 1 in lines of these lengths; longer ones stand last."""
    size, rest = length // (edits + 1), length % (edits + 1)
    longer = i - (edits + 1 - rest)
    return size * i + np.maximum(longer, 0), size + (longer >= 0)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) that a longer or equal line probes."""
    out = []
    for delta in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, delta - (edits - i)), min(i, delta + (edits - i))
            out += [(delta, i, shift) for shift in range(low, high + 1)]
    return out


def checked(classes: Classes) -> Classes:
    """The classes as a tuple, if lengths and edits rise and every segment has a character."""
    classes = tuple((int(least), int(edits)) for least, edits in classes)
    rising = all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(classes, classes[1:]))
    if not classes or not rising or any(edits < 0 or least <= edits for least, edits in classes):
        raise ValueError("classes are (least length, edits), rising, with fewer edits than characters")
    return classes


def edits_for(length: int, classes: Classes) -> int:
    """Edits allowed where the shorter line of a pair has this length; -1 below the first class."""
    return max((edits for least, edits in classes if length >= least), default=-1)


def line_keys(lines: list[str], classes: Classes = CLASSES) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each class (edits, keys, line numbers, whether it is an index key) of its segments and
    of all probes for its lines, and the sketches of the lines."""
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.cumsum(lengths) - lengths
    values = mix(points.astype(np.uint64) + np.uint64(1))
    up, down = powers(WORD_BASE, len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(points)], out=sums[1:])
    owner = np.repeat(np.arange(len(lines)), lengths)
    counts = np.bincount(owner * 16 + (values >> np.uint64(60)).astype(np.int64), minlength=16 * len(lines))
    nibbles = (counts & 15).astype(np.uint8).reshape(-1, 16)
    sketches = (nibbles[:, ::2] | nibbles[:, 1::2] << 4).copy().view("<u8")[:, 0]
    out = []
    for (least, edits), above in zip(classes, [n for n, _ in classes[1:]] + [np.inf]):
        keys, numbers, index = [], [], []
        for delta, i, shift in probes(edits):
            own = lengths - delta
            start, size = segments(own, i, edits)
            start = start + shift
            fits = np.flatnonzero((own >= least) & (own < above) & (start >= 0) & (start + size <= lengths))
            at = first[fits] + start[fits]
            content = (sums[at + size[fits]] - sums[at]) * down[at]
            place = own[fits].astype(np.uint64) * np.uint64(edits + 1) + np.uint64(i)
            keys.append(mix(content + mix(place)))
            numbers.append(fits)
            index.append(np.full(len(fits), delta == 0 and shift == 0))
        out.append((edits, np.concatenate(keys), np.concatenate(numbers), np.concatenate(index)))
    return out, sketches


def line_id(line: str) -> int:
    """The 64-bit id of a line, as Spark's xxhash64 gives it."""
    value = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return value - (1 << 64) if value >> 63 else value


PACKED = pa.schema([("part", pa.int32()), ("edits", pa.int32()), ("keys", pa.binary()), ("lines", pa.binary()), ("sketches", pa.binary()), ("index", pa.binary())])
PACKED_SQL = "part int, edits int, keys binary, lines binary, sketches binary, index binary"


def _keys(parts: int, classes: Classes):
    def send(lines: list[str]) -> Iterator[pa.RecordBatch]:
        ids = np.fromiter(map(line_id, lines), dtype=np.int64, count=len(lines))
        by_class, sketches = line_keys(lines, classes)
        for edits, keys, numbers, index in by_class:
            target = (keys >> np.uint64(32)).astype(np.int64) * parts >> 32
            order = np.argsort(target, kind="stable")
            bounds = np.searchsorted(target[order], np.arange(parts + 1))
            for part in np.flatnonzero(np.diff(bounds)).tolist():
                own = order[bounds[part] : bounds[part + 1]]
                row = (
                    part, edits, keys[own].astype("<u4").tobytes(), ids[numbers[own]].tobytes(),
                    sketches[numbers[own]].tobytes(), np.packbits(index[own]).tobytes(),
                )
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, PACKED)], schema=PACKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, None] = {}
        size = 0
        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) >= classes[0][0] and line not in held and line.encode("utf-8", "surrogatepass").split():
                        held[line] = None
                        size += len(line)
                if size >= HELD_CHARS:
                    yield from send(list(held))
                    held, size = {}, 0
        if held:
            yield from send(list(held))

    return run


# --- pairs of one key ----------------------------------------------------------
def apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least number of letters that differ, by the counters of two sketches."""
    left, right = (x.astype("<u8").view(np.uint8).reshape(*x.shape, 8) for x in (left, right))
    total = np.zeros(np.broadcast_shapes(left.shape, right.shape)[:-1], dtype=np.uint8)
    for shift in (0, 4):
        gap = ((left >> shift) - (right >> shift)) & 15
        total += np.minimum(gap, 16 - gap).sum(axis=-1, dtype=np.uint8)
    return total


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_edits: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            by_edits.setdefault(row["edits"], []).append(row)
    for edits in sorted(by_edits):
        yield from _pairs(by_edits.pop(edits), edits)


def _pairs(rows: list[dict], edits: int) -> Iterator[pa.RecordBatch]:
    """Pairs of lines under one key of a class, an index key on one side, whose sketches allow it."""
    keys = np.concatenate([np.frombuffer(r["keys"], dtype="<u4") for r in rows])
    lines = np.concatenate([np.frombuffer(r["lines"], dtype=np.int64) for r in rows])
    sketches = np.concatenate([np.frombuffer(r["sketches"], dtype=np.uint64) for r in rows])
    index = np.concatenate([np.unpackbits(np.frombuffer(r["index"], dtype=np.uint8), count=len(r["keys"]) // 4) for r in rows]).astype(bool)
    rows.clear()
    order = np.lexsort((~index, lines, keys))
    keys, lines, sketches, index = keys[order], lines[order], sketches[order], index[order]
    kept = np.concatenate([[True], (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])])
    keys, lines, sketches, index = keys[kept], lines[kept], sketches[kept], index[kept]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    indexed = np.add.reduceat(index.astype(np.int64), starts)
    useful = (sizes > 1) & (indexed > 0)
    found = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        good = (index[a] | index[b])
        a, b = a[good], b[good]
        near = apart(sketches[a], sketches[b]) <= 2 * edits
        if near.any():
            found.append(np.stack([lines[a[near]], lines[b[near]]], axis=1))

    small = np.flatnonzero(useful & (sizes <= GROUP))
    for step in range(1, GROUP):
        small = small[sizes[small] > step]
        if not len(small):
            break
        counts = sizes[small] - step
        base = np.repeat(starts[small], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        for low in range(0, len(base), 1 << 20):
            keep(base[low : low + (1 << 20)], base[low : low + (1 << 20)] + step)
    for group in np.flatnonzero(useful & (sizes > GROUP)).tolist():
        low, high = int(starts[group]), int(starts[group] + sizes[group])
        for first in range(low, high, BLOCK):
            left = np.arange(first, min(first + BLOCK, high))
            for second in range(first, high, BLOCK):
                right = np.arange(second, min(second + BLOCK, high))
                near = (apart(sketches[left][:, None], sketches[right][None, :]) <= 2 * edits) & (index[left][:, None] | index[right][None, :])
                a, b = np.nonzero(near)
                a, b = left[a], right[b]
                found.append(np.stack([lines[a], lines[b]], axis=1)[a < b])
    if found:
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        for low in range(0, len(pairs), 100_000):
            part = pairs[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])


# --- verification --------------------------------------------------------------
def edit_distance(left: str, right: str, most: int) -> int:
    """The edit distance if it is at most *most*, else most + 1.

    Equal ends are cut off. Then, column by column, one small bit vector for each number of
    edits says which cells of a band of 2 * most + 1 around the diagonal can be reached with
    so many: bit b of column j stands for j + b - most characters of the left line.
    """
    if abs(len(left) - len(right)) > most:
        return most + 1
    low, high, short = 0, 0, min(len(left), len(right))
    while low < short and left[low] == right[low]:
        low += 1
    while high < short - low and left[-1 - high] == right[-1 - high]:
        high += 1
    left, right = left[low : len(left) - high], right[low : len(right) - high]
    places: dict[str, int] = {}
    for i, letter in enumerate(left):
        places[letter] = places.get(letter, 0) | 1 << i + most
    full = (1 << 2 * most + 1) - 1
    reached = [((1 << d + 1) - 1) << most for d in range(most + 1)]  # deletions from the left line alone
    reached = [r & ((1 << len(left) + most + 1) - 1) for r in reached]
    for j, letter in enumerate(right):
        match = places.get(letter, 0) >> j & full
        inside = full & ((1 << max(0, len(left) - j + most)) - 1)
        inside &= ~((1 << max(0, most - j - 1)) - 1)
        before, new = 0, 0
        for d in range(most + 1):
            own = reached[d]
            new = ((own & match) | before | before >> 1 | new << 1) & inside
            reached[d], before = new, own
        if not new:
            return most + 1
    last = 1 << len(left) - len(right) + most
    return next((d for d in range(most + 1) if reached[d] & last), most + 1)


def _verify(classes: Classes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            most = [edits_for(min(len(x), len(y)), classes) for x, y in zip(left, right)]
            gaps = list(map(edit_distance, left, right, most))
            good = [i for i, gap in enumerate(gaps) if gap <= most[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[i] for i in good], pa.int64()) for v in (a, b)] + [pa.array([gaps[i] for i in good], pa.int32())], ["a", "b", "distance"]
            )

    return run


# --- the join ------------------------------------------------------------------
def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def occurrences(texts: DataFrame) -> DataFrame:
    """(doc_id, twin, line_no, line, id) of every line that is not blank; line numbers from 0."""
    lines = texts.select("doc_id", F.xxhash64("text").alias("twin"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(SOLID)).withColumn("id", F.xxhash64("line"))


def line_links(texts: DataFrame, classes: Classes = CLASSES) -> DataFrame:
    """(a, b, distance), a < b: all pairs of different lines that are near, by line id."""
    classes = checked(classes)
    parts = parallelism(texts.sparkSession)
    packed = texts.select("text").mapInArrow(released(_keys(parts, classes)), PACKED_SQL).repartitionById(parts, F.col("part"))
    pairs = stage(packed.mapInArrow(released(_candidates), "a long, b long").distinct(), "line-pairs")
    needed = side(pairs.select(F.explode(F.array("a", "b")).alias("needed")).distinct(), "line-ids", F.lit(8))
    lines = occurrences(texts).join(needed, F.col("id") == F.col("needed")).groupBy("id").agg(F.min("line").alias("line"))
    lines = stage(lines, "line-texts")
    left = lines.select(F.col("id").alias("a"), F.col("line").alias("left"))
    right = lines.select(F.col("id").alias("b"), F.col("line").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(released(_verify(classes)), "a long, b long, distance int")


def line_classes(texts: DataFrame, classes: Classes = CLASSES) -> DataFrame:
    """(id, class_id, n_links, first_doc, first_line) of lines that repeat or have links.

    class_id is the least id of the class; the first occurrence is that of the class.
    """
    links = stage(line_links(texts, classes), "line-links")
    ends = links.select("a").union(links.select("b"))
    degree = ends.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_links"))
    parts = connected_components(links.select("a", "b")).withColumnRenamed("node", "id")
    order = F.struct(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc"), F.col("line_no").alias("line"))
    found = occurrences(texts).groupBy("id").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    known = found.join(parts, "id", "left").join(degree, "id", "left")
    known = known.where("n > 1 or component is not null").select(
        "id", F.coalesce("component", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "first"
    )
    known = stage(known, "line-known")
    firsts = known.groupBy("class_id").agg(F.min("first").alias("first"))
    return known.drop("first").join(firsts, "class_id").select("id", "class_id", "n_links", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))


REMOVED = "array<struct<line_no:int,class_id:bigint>>"


def removals(texts: DataFrame, classes: Classes = CLASSES) -> DataFrame:
    """(cut_id, cut_twin, cut_lines, cut_links), once for each text with repeated or linked lines."""
    known = side(line_classes(texts, classes), "line-classes", F.lit(44))
    hit = occurrences(texts).drop("line").join(known, "id")
    first = (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    gone = F.when(~first, F.struct("line_no", "class_id"))
    # One entry for each line of a text, also where rows repeat.
    per_text = hit.groupBy("doc_id", "twin").agg(
        F.array_sort(F.collect_set(gone)).alias("cut_lines"), F.collect_set(F.struct("line_no", "n_links")).alias("linked")
    )
    links = F.aggregate("linked", F.lit(0).cast("long"), lambda n, x: n + x["n_links"])
    per_text = per_text.select(F.col("doc_id").alias("cut_id"), F.col("twin").alias("cut_twin"), "cut_lines", links.alias("cut_links"))
    return side(per_text, "line-removed", 40 + 16 * F.size("cut_lines"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Classes = CLASSES) -> DataFrame:
    """(doc_id, twin, n_lines, n_links, removed, kept) for every row of *docs*.

    n_lines counts lines that are not blank, n_links the links of its lines to other lines,
    removed the lines taken out with their class, kept is what is left of the text.
    twin is a hash of the text, which tells rows with one id apart.
    """
    texts = _texts(docs, id_col, text_col)
    rows = texts.withColumn("twin", F.xxhash64("text"))
    joined = rows.join(removals(texts, classes), F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("twin") == F.col("cut_twin")), "left")
    removed = F.coalesce(F.col("cut_lines"), F.array().cast(REMOVED))
    lines = F.split("text", "\n")
    return joined.select(
        "doc_id",
        "twin",
        F.size(F.filter(lines, lambda x: x.rlike(SOLID))).cast("long").alias("n_lines"),
        F.coalesce("cut_links", F.lit(0)).cast("long").alias("n_links"),
        removed.alias("removed"),
        kept_text(F.col("text")).alias("kept"),
    )


def kept_text(text: Column) -> Column:
    """The text without its removed lines, beside the columns of `removals`."""
    return F.when(F.size("cut_lines") > 0, _kept(F.split(text, "\n"), F.col("cut_lines"))).otherwise(text)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Classes = CLASSES) -> DataFrame:
    """The rows and columns of *docs* with the removed lines taken out of the text."""
    cut = removals(_texts(docs, id_col, text_col), classes)
    names = {c: f"cut__{c}" for c in cut.columns}
    same = F.col(id_col).cast("long").eqNullSafe(F.col("cut__cut_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("cut__cut_twin"))
    joined = docs.join(cut.withColumnsRenamed(names), same, "left")
    gone = F.col("cut__cut_lines")
    text = F.when(F.size(gone) > 0, _kept(F.split(F.col(text_col), "\n"), gone)).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _kept(lines: Column, removed: Column) -> Column:
    """The lines between the removed ones: slices, so long texts stay linear."""
    at = F.transform(removed, lambda r: r["line_no"])
    bounds = F.concat(F.array(F.lit(-1)), at, F.array(F.size(lines)))
    parts = F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: F.slice(lines, F.get(bounds, i) + 2, F.get(bounds, i + 1) - F.get(bounds, i) - 1))
    return F.array_join(F.flatten(parts), "\n")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_links", "removed", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE: dict[str, str] = {}
