"""Groups of near copies: SimHash deletion variants as candidates, five-word similarity as proof.

Two texts are near when at least `LEAST` = 0.8 of their distinct five-word shingles (A-Z
lower-cased; of a shorter text its words as one) are shared, as intersection over union.
Near copies differ in few words, so the SimHash of a text's distinct words moves little: each
text has three such fingerprints of 64 bits, and a pair is a candidate when one of them differs
by at most `DISTANCE` = 5 bits. A fingerprint is cut into three segments, of which one differs
by at most one bit; each segment is indexed under its variants with one bit deleted, variants
are joined on equality, and fingerprints compared. Candidates are then verified on their
shingles; groups are the connected components of the verified links.

A bucket gives all its pairs up to `SMALL` members. A larger one is a family of near copies;
it gives a forest over its members, in an order that differs by fingerprint and segment, so a
family gets nine different forests to be verified. Of the pairs that forests leave out, those
whose ends are in different components by then are verified too: the groups are those of all pairs.
They are found by shingles: a text is looked up under the few rarest of those it shares with other
components, and only if it shares enough of them to be near any text there (`rare_shingles`). So a
family whose members are alike but not near gives few rows, in proportion to its texts. Sketches of
the sets rule out pairs that differ in too many shingles for certain.

Texts that are equal are one from the start. Cases: null counts as empty; all texts without
words are one group; a null id is larger than any.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.flat import mix, slices
from lodestone.llm.simhash import differing, keep_one_of_each, majority
from lodestone.llm.tables import parallelism, released, side
from lodestone.session import stage

SHINGLE_WORDS, LEAST = 5, 0.8
DISTANCE, BITS, PRINTS = 5, 64, 3
#: First bit of each segment, and the end.
EDGES = (0, 22, 43, 64)
SMALL, BLOCK = 24, 1024
#: Bits of the sketch of a set of shingles, and pairs of sketches compared at once.
SKETCH_BITS, SKETCHES = 1024, 16_384
#: Rows of sorted keys looked at together.
AT_ONCE = 100_000


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(first row, end row, words of each row) of slices of a batch."""
    for low, high, data, offsets in slices(column):
        raw = data.tobytes()
        yield low, high, [raw[s:e].lower().split() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in _texts(batch.column(2)):
            sets = [set(words) for words in texts]
            counts = np.array([len(s) for s in sets], dtype=np.int64)
            hashes = np.fromiter((h for s in sets for h in map(xxhash.xxh64_intdigest, s)), dtype=np.uint64, count=int(counts.sum()))
            values = [majority(mix(hashes + np.uint64(k)), counts).view(np.int64) for k in range(PRINTS)]
            own = [batch.column(i).slice(low, high - low) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, values)], ["doc_id", "twin", *(f"fp{k}" for k in range(PRINTS))])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, twin, fp0, fp1, fp2) for every row; twin is a hash of the text."""
    twin = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), twin.alias("twin"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(_prints), "doc_id long, twin long, " + ", ".join(f"fp{k} long" for k in range(PRINTS)))


def signatures(texts: DataFrame) -> DataFrame:
    """(key, twin, fp): which fingerprint, which bit is deleted, and the other bits of its segment."""
    prints = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"fp{k}").alias("fp")) for k in range(PRINTS)]))
    bits = texts.select("twin", prints.alias("p")).select("twin", "p.*", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i"))
    rest = None
    for low, high in reversed(list(zip(EDGES, EDGES[1:]))):
        part = F.expr(f"shiftrightunsigned(fp & ~shiftleft(1L, i), {low}) & {(1 << (high - low)) - 1}L")
        rest = part if rest is None else F.when(F.col("i") < high, part).otherwise(rest)
    key = (F.col("k") * BITS + F.col("i")).cast("long") * F.lit(1 << 32) + rest
    return bits.select(key.alias("key"), "twin", "fp")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """(place, an earlier place within the distance) for every member but the first of its kind.

    A member of a single block that is near any other has a link, also if it is the first of its kind.
    """
    links: list[tuple[int, int]] = []
    roots = np.zeros(0, dtype=np.int64)
    for low in range(0, len(fps), BLOCK):
        own = fps[low : low + BLOCK]
        near = differing(own[:, None], own[None, :]) <= DISTANCE
        first = near.argmax(axis=1)  # a member is near itself
        links += [(low + i, low + j) for i, j in enumerate(first.tolist()) if j < i]
        new = low + np.flatnonzero(first == np.arange(len(own)))
        left = np.setdiff1d(new - low, first[first != np.arange(len(own))])  # those near them went to others
        near[left, left] = False
        left = left[near[left].any(axis=1)]
        links += list(zip((low + near[left].argmax(axis=1)).tolist(), (low + left).tolist()))
        if len(roots):
            far = differing(fps[new][:, None], fps[roots][None, :]) <= DISTANCE
            found = far.any(axis=1)
            links += list(zip(new[found].tolist(), roots[far[found].argmax(axis=1)].tolist()))
            new = new[~found]
        roots = np.concatenate([roots, new])[-BLOCK:]
    return links


def _apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, twin, fp, component and, if known, size, sketch, other fingerprints) sorted by key -> all pairs of a key that
    are within the distance by one of the fingerprints and whose components differ, without those whose sketches show
    that they share too few shingles."""

    def found(twins: np.ndarray, fp: np.ndarray, parts: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        if (parts == parts[0]).all():
            return
        for low in range(0, len(twins), BLOCK):
            own = slice(low, low + BLOCK)
            for other in range(low, len(twins), BLOCK):
                against = slice(other, other + BLOCK)
                near = np.logical_or.reduce([differing(fps[own][:, None], fps[against][None, :]) <= DISTANCE for fps in (fp, *more)])
                near &= parts[own][:, None] != parts[against][None, :]
                i, j = np.nonzero(np.triu(near) if low == other else near)
                for start in range(0, len(i), SKETCHES):
                    x, y = i[start : start + SKETCHES] + low, j[start : start + SKETCHES] + other
                    kept = may_be_near(sizes[x], sizes[y], sketches[x], sketches[y])
                    a, b = twins[x[kept]], twins[y[kept]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    key, held = None, []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]
        if batch.num_columns > 4:
            columns.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64))
            columns += [c.to_numpy(zero_copy_only=False) for c in batch.columns[6:]]
        else:  # nothing is known of the sets, so nothing is ruled out
            columns += [np.zeros(batch.num_rows, dtype=np.int64), np.zeros((batch.num_rows, 1), dtype=np.uint64)]
        edges = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if low == high:
                continue
            if held and columns[0][low] != key:
                yield from found(*(np.concatenate(c) for c in zip(*held)))
                held = []
            key = columns[0][low]
            held.append([c[low:high].copy() for c in columns[1:]])
    if held:
        yield from found(*(np.concatenate(c) for c in zip(*held)))


def may_be_near(sizes: np.ndarray, other_sizes: np.ndarray, sketches: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether two sets can share `LEAST` of their shingles; no pair that does is refused.

    A bit of a sketch is the parity of the shingles that fall on it, so as many shingles as bits differ,
    or more, are in one set only.
    """
    apart = np.bitwise_count(sketches ^ others).sum(axis=1, dtype=np.int64)
    apart = np.maximum(apart, np.abs(sizes - other_sizes))
    both = sizes + other_sizes
    # Of |A| + |B| = 2 * shared + apart, shared is at least LEAST * (shared + apart); a little room for rounding.
    return both - apart >= 2 * LEAST / (1 + LEAST) * both - 1e-6


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, twin, fp) sorted by key -> candidate pairs (a, b), a < b; if there are large buckets, (null, null) and
    (a, null) for members of those of several blocks that have no pair."""

    def found(keys: np.ndarray, twins: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        left, right, single = [], [], []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():  # all buckets of one size at once
            own = starts[sizes == size]
            for i in range(size - 1):
                for j in range(i + 1, size):
                    near = own[differing(fps[own + i], fps[own + j]) <= DISTANCE]
                    left.append(near + i)
                    right.append(near + j)
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            place = slice(start, start + size)
            print_no, bit = divmod(int(keys[start]) >> 32, BITS)
            turn = mix(np.array([print_no * BITS + np.searchsorted(EDGES, bit, "right")], dtype=np.uint64))
            order = np.argsort(mix(twins[place].view(np.uint64) ^ turn), kind="stable") + start
            links = np.array(_forest(fps[order]), dtype=np.int64).reshape(-1, 2)
            left.append(order[links[:, 0]])
            right.append(order[links[:, 1]])
            if size > BLOCK:
                single.append(twins[np.delete(order, links.ravel())])
        a, b = (twins[np.concatenate(side)] if side else twins[:0] for side in (left, right))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        alone = np.unique(np.concatenate(single)) if single else twins[:0]
        marks = pa.nulls(int((sizes > SMALL).any()), pa.int64())
        a = pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(alone), marks])
        b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(alone), pa.int64()), marks])
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    waiting: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        count += batch.num_rows
        if count < AT_ONCE or waiting[0][0][0] == waiting[-1][0][-1]:
            continue  # a bucket that goes on is put together once
        held = [np.concatenate([part[i] for part in waiting]) for i in range(3)]
        cut = int(np.searchsorted(held[0], held[0][-1]))
        yield found(*(c[:cut] for c in held))
        waiting = [[c[cut:].copy() for c in held]]
        count = len(waiting[0][0])
    if waiting:
        yield found(*(np.concatenate([part[i] for part in waiting]) for i in range(3)))


# --- proof --------------------------------------------------------------------------
def _shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the distinct five-word shingles of a text."""
    count = max(1, len(words) - SHINGLE_WORDS + 1) if words else 0
    hashes = {xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE_WORDS])) for i in range(count)}
    return np.fromiter(hashes, dtype=np.uint64, count=len(hashes))


def _shingle_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in _texts(batch.column(1)):
            sets = [_shingles(words).view(np.int64) for words in texts]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), values], ["twin", "shingles"])


def sketch(shingles: np.ndarray) -> bytes:
    """For each bit the parity of the shingles that fall on it."""
    places = np.bincount((shingles >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits(places & 1, bitorder="little").tobytes()


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (twin, shingles) -> (twin, size, sketch)."""
    for batch in batches:
        sets = [row.values.to_numpy(zero_copy_only=False).view(np.uint64) for row in batch.column(1)]
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(map(sketch, sets), pa.binary())], ["twin", "size", "sketch"])


def rare_shingles(marked: DataFrame) -> DataFrame:
    """(key, twin): shingles under which each text of *marked* (twin, component, shingles) meets all near ones of other components.

    A text that is near shares `LEAST` of the shingles, so it lacks some of them only; of one more than that it has
    at least one, whichever they are, if all texts take the first in one order of all shingles. Here those
    come first that one component has alone: nobody there has them, so they need no row. The others follow by
    their number of texts. A text with too many of the former has no row at all. A set without
    shingles counts as the one shingle 0.
    """
    shingles = F.when(F.size("shingles") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("shingles"))
    each = marked.select("twin", "component", F.size(shingles).alias("size"), F.explode(shingles).alias("key"))
    alike = Window.partitionBy("key")
    crossing = F.min("component").over(alike) < F.max("component").over(alike)
    each = each.select("twin", "size", "key", F.count("*").over(alike).alias("n"), crossing.alias("crossing")).where("crossing")
    shared = each.groupBy("twin", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    lacked = F.col("size") - F.ceil(F.col("size") * LEAST - 1e-6)  # a little room for rounding
    rows = (lacked + 1 - (F.col("size") - F.size("shared"))).cast("int")
    shared = shared.select("twin", "shared", rows.alias("rows")).where("rows > 0")
    return shared.select("twin", F.explode(F.slice("shared", 1, F.col("rows"))).alias("s")).select("s.key", "twin")


def _asked(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(twin, text) of the wanted twins."""
    wanted = side(wanted, "near-texts", F.lit(8))
    twin = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(twin.alias("twin"), F.col(text_col).alias("text")).join(wanted, "twin", "left_semi").dropDuplicates(["twin"])


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(twin, shingles) of the wanted twins."""
    return stage(_asked(docs, wanted, text_col).mapInArrow(released(_shingle_sets), "twin long, shingles array<long>"), "near-shingles")


def _proved(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (a, b) that share enough shingles."""
    a, b = (sets.select(F.col("twin").alias(n), F.col("shingles").alias(f"{n}_set")) for n in "ab")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    both = candidates.join(a, "a").join(b, "b").withColumn("shared", shared)
    union = F.size("a_set") + F.size("b_set") - F.col("shared")
    return both.where(F.col("shared") >= LEAST * union).select("a", "b")


def distinct_texts(prints: DataFrame) -> DataFrame:
    """(twin, fp0, fp1, fp2), dealt over all tasks: a text becomes 192 rows, so few bytes are much work."""
    dealt = prints.repartition(parallelism(prints.sparkSession), "twin")
    return dealt.groupBy("twin").agg(*[F.first(f"fp{k}").alias(f"fp{k}") for k in range(PRINTS)])


def near_pairs(docs: DataFrame, prints: DataFrame, text_col: str) -> DataFrame:
    """(a, b): texts that are near, enough of them that their components are those of all candidates that are near.

    First all pairs of small buckets and the forests of large ones are proved. Then every pair of a large
    bucket whose ends are still in different components is, so no link that would join two groups is left out.
    Each of its ends has a candidate or stands alone in `found`, so the sets of the first proof are all that is needed.
    """
    texts = distinct_texts(prints)
    keyed = signatures(texts).repartition("key").sortWithinPartitions("key")
    found = stage(keyed.mapInArrow(released(_pairs), "a long, b long").distinct(), "near-candidates")
    pairs = found.where("b IS NOT NULL")
    sets = _sets(docs, found.select(F.explode(F.array("a", "b")).alias("twin")).where("twin IS NOT NULL").distinct(), text_col)
    links = stage(_proved(sets, pairs), "near-proved")
    if found.where("b IS NULL").isEmpty():  # no large buckets
        return links
    parts = side(connected_components(links).select(F.col("node").alias("twin"), "component"), "near-parts", F.lit(16))
    marked = sets.join(parts, "twin", "left").select("twin", "shingles", F.coalesce("component", "twin").alias("component"))
    rare = stage(rare_shingles(marked), "near-rare")
    met = side(rare.select("twin").distinct(), "near-met", F.lit(8))
    sketches = sets.join(met, "twin", "left_semi").mapInArrow(released(_sketches), "twin long, size long, sketch binary")
    known = texts.join(sketches, "twin").join(parts, "twin", "left").withColumn("component", F.coalesce("component", "twin"))
    known = side(known, "near-sketches", F.lit(48 + SKETCH_BITS // 8))
    held = rare.join(known, "twin").select("key", "twin", "fp0", "component", "size", "sketch", *(f"fp{k}" for k in range(1, PRINTS)))
    apart = held.repartition("key").sortWithinPartitions("key")
    rest = stage(apart.mapInArrow(released(_apart), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"), "near-rest")
    return links.union(_proved(sets, rest))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, twin, component) for every row; rows of one component are near copies of each other."""
    prints = stage(fingerprints(docs, id_col, text_col), "near-prints")
    links = stage(near_pairs(docs, prints, text_col), "near-links")
    parts = connected_components(links).select(F.col("node").alias("twin"), "component")
    parts = side(parts, "near-parts", F.lit(16))
    return prints.select("doc_id", "twin").join(parts, "twin", "left").select("doc_id", "twin", F.coalesce("component", "twin").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of *docs*, with its columns, for each group of near copies: that with the least id, null last."""
    return keep_one_of_each(docs, stage(groups(docs, id_col, text_col), "near-groups"), id_col, text_col)
