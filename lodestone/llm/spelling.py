"""Grouping of spelling variants by a relational frontier over tries.

Words of one length form a trie, whose edge table Spark holds: (node, label, child or leaf). A
word looks for its neighbours of its own length (one code point replaced) and of one more (one
inserted); the mirror image of the latter gives those of one less. Its states (text, position,
node, edits) start at the node of its first (length - 1) div 2 code points, once in the tries of
the words and once in those of the reversed words: a single edit leaves one of the two starts
whole. Level by level the states are joined with the edges on the node. A label that agrees is
followed; one that differs is followed if one edit of the wanted kind mends it and none was used.
States with one edit at a leaf are neighbours. Chains without a branch are one edge, so levels
are branchings on a path, not code points.

Edges are made by a stream over each sorted group of words (a stack of one path). Every level is
written to the shared folder. Words and words under one node share a 64-bit key; pairs are
verified at the end.

A word's form is its most frequent neighbour if that is at least twice as frequent. Roots follow
forms by pointer jumping; counts at least double on the way, so it takes few rounds.

Cases: null texts have no words; a null id counts as the text `null`; rows that repeat are
counted each; texts are read in pieces cut between words, so only a word is ever held whole; no
word gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import read, side
from lodestone.session import stage

#: Of UTF-8: A-Z are lower-cased before; U+00C0 to U+00FF are C3 and one more byte.
WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BETWEEN = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
DROPPED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Distinct words a task holds before it sends their counts; bytes of text looked at at once.
HELD_WORDS, PIECE = 300_000, 1 << 20
OUT_ROWS = 20_000


# --- words --------------------------------------------------------------------------
def _pieces(data: bytes) -> Iterator[bytes]:
    """*data* cut after bytes that belong to no word, about every `PIECE` bytes."""
    low = 0
    while len(data) - low > PIECE:
        cut = BETWEEN.search(data, low + PIECE)
        if not cut:
            break
        yield data[low : cut.end()]
        low = cut.end()
    yield data[low:]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id as text, text as bytes) -> (word, n), combined within the task."""
    totals: dict[bytes, int] = {}

    def sent() -> pa.RecordBatch:
        words = pa.array(list(totals), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(totals.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for own_id, text in zip(batch.column(0), batch.column(1)):
            if not text.is_valid:
                continue
            seed = zlib.crc32(own_id.as_py().encode() + b":")
            for piece in _pieces(text.as_py().lower()):
                counts: dict[bytes, int] = {}
                for word in WORD.findall(piece):
                    counts[word] = counts.get(word, 0) + 1
                for word, n in counts.items():
                    check = zlib.crc32(word, seed)
                    if not check % DROPPED:
                        letters = word.decode()
                        place = check % len(letters)
                        word = (letters[:place] + letters[place + 1 :]).encode()
                    totals[word] = totals.get(word, 0) + n
                if len(totals) >= HELD_WORDS:
                    yield sent()
                    totals.clear()
    if totals:
        yield sent()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of `LEAST_LENGTH` code points and `LEAST_COUNT` occurrences or more."""
    own_id = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(own_id.alias("id"), F.col(text_col).cast("binary").alias("text"))
    counts = rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))


# --- tries --------------------------------------------------------------------------
def _node(backward, length, text):
    """The key of the start node of *text* in the trie of words of *length*."""
    return F.xxhash64(backward, length, F.substring(text, F.lit(1), F.floor((length - 1) / 2).cast("int")))


def _shared(a: str, b: str, known: int) -> int:
    """Length of the common prefix of two texts of one length that agree up to *known*."""
    end = len(a)
    while known < end and a[known] == b[known]:
        known += 1
    return known


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, length, text) sorted by node and text -> (node, label, child, leaf)."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    root = last = None
    open_depths: list[int] = []

    def key(text: str, depth: int) -> int:
        if depth == open_depths[0]:
            return root
        return xxhash.xxh64_intdigest(f"{root}/{text[:depth]}") - (1 << 63)

    def emit(text: str, depth: int, end: int) -> None:
        leaf = end == len(text)
        for column, value in zip(out, (key(text, depth), text[depth:end], None if leaf else key(text, end), text if leaf else None)):
            column.append(value)

    def close(text: str, down_to: int) -> None:
        """Emit the edges of the open path that end: those below *down_to*."""
        end = len(text)
        while open_depths[-1] > down_to:
            emit(text, open_depths[-1], end)
            end = open_depths.pop()
        if open_depths[-1] < down_to:
            open_depths.append(down_to)
        emit(text, down_to, end)

    def finish(text: str) -> None:
        end = len(text)
        for depth in reversed(open_depths):
            emit(text, depth, end)
            end = depth

    def sent() -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.int64(), pa.string())
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["node", "label", "child", "leaf"])
        for column in out:
            column.clear()
        return done

    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node == root and len(text) == len(last):
                close(last, _shared(last, text, open_depths[0]))
            else:
                if last is not None:
                    finish(last)
                root = node
                open_depths[:] = [(len(text) - 1) // 2]
            last = text
            if len(out[0]) >= OUT_ROWS:
                yield sent()
    if last is not None:
        finish(last)
    if out[0]:
        yield sent()


def _both_ways(words: DataFrame) -> DataFrame:
    ways = F.array(F.struct(F.lit(0).alias("backward"), F.col("word").alias("text")), F.struct(F.lit(1).alias("backward"), F.reverse("word").alias("text")))
    return words.select(F.explode(ways).alias("way")).select("way.*", F.char_length("way.text").alias("length"))


def trie_edges(words: DataFrame) -> DataFrame:
    """(node, label, child, leaf): the edges of the tries of all lengths, forward and backward."""
    rows = _both_ways(words).select(_node(F.col("backward"), F.col("length"), F.col("text")).alias("node"), "text")
    return rows.repartition("node").sortWithinPartitions("node", "text").mapInArrow(_edges, "node long, label string, child long, leaf string")


# --- frontier -----------------------------------------------------------------------
def _start(words: DataFrame) -> DataFrame:
    """(text, backward, longer, position, node, edits); longer is how much longer the wanted word is."""
    rows = _both_ways(words).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    length = F.col("length") + F.col("longer")
    return rows.select(
        "text", "backward", "longer",
        F.floor((length - 1) / 2).cast("int").alias("position"),
        _node(F.col("backward"), length, F.col("text")).alias("node"),
        F.lit(0).alias("edits"),
    )


def _advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """All states one edge further down; `leaf` is set where a word ends."""
    joined = states.join(edges, "node").withColumn("size", F.char_length("label"))
    agrees = F.substring("text", F.col("position") + 1, F.col("size")) == F.col("label")
    taken = F.col("size") - F.col("longer")
    own = F.substring("text", F.col("position") + 1, taken)
    mended = (F.col("edits") == 0) & (F.char_length(own) == taken) & (F.levenshtein(own, F.col("label"), 1) == 1)
    step = F.when(agrees, F.struct((F.col("position") + F.col("size")).alias("position"), F.col("edits").alias("edits"))).when(
        mended, F.struct((F.col("position") + taken).alias("position"), F.lit(1).alias("edits"))
    )
    moved = joined.select("text", "backward", "longer", step.alias("step"), F.col("child").alias("node"), "leaf").where("step is not null")
    return moved.select("text", "backward", "longer", "step.position", "node", "step.edits", "leaf").where("leaf is null or edits = 1")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of *words* that differ by one inserted, deleted or replaced code point."""
    edges = stage(trie_edges(words), "spelling-edges")
    states = _start(words)
    found = None
    while True:
        level = stage(_advance(states, edges), "spelling-level")
        ends = level.where("leaf is not null").select("text", "leaf", "backward", "longer")
        found = ends if found is None else found.union(ends)
        states = level.where("leaf is null").drop("leaf")
        if states.isEmpty():
            break
        states = side(states, "spelling-frontier", F.octet_length("text") + 32)
    turned = [F.when(F.col("backward") == 1, F.reverse(c)).otherwise(F.col(c)) for c in ("text", "leaf")]
    pairs = found.select(turned[0].alias("word"), turned[1].alias("near"), "longer").where(F.levenshtein("word", "near", 1) == 1)
    mirrored = pairs.where("longer = 1").select(F.col("near").alias("word"), F.col("word").alias("near"))
    return pairs.select("word", "near").union(mirrored).distinct()


# --- forms --------------------------------------------------------------------------
def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) for every word."""
    counts = side(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "spelling-counts", F.octet_length("near") + 16)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    judged = pairs.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= 2 * F.col("n")
    return words.join(judged, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for every row of *links* (word, form) with a form: the end of its chain."""
    known = stage(links.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not known.where("moved").isEmpty():
        after = side(known.select(F.col("word").alias("root"), F.col("root").alias("next")), "spelling-next", F.octet_length("root") + F.octet_length("next") + 16)
        known = stage(known.select("word", "root").join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
    return known.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of *docs*."""
    words = stage(vocabulary(docs, id_col, text_col), "spelling-words")
    judged = stage(forms(words, neighbours(words)), "spelling-forms")
    return judged.join(roots(judged), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE: dict[str, str] = {}
