"""Documents that hold test items: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared without case and punctuation. Of every item, each place gives one rare
seed: the shortest n-gram from there, of 3 to 8 words, whose words meet by chance at most
once in 1 / `CHANCE` places by their shares of the corpus, which are counted over all
documents. Leaks raise these shares and edits break long n-grams, so each place also gives
three short seeds, of three words in a row and with one left out (`SHORT_SEEDS`). Seeds join
documents to items; hits that predict about the same place are one candidate, if one of them
is rare or two short ones agree, and the item is aligned with the words around it. The score
is the alignment's over that of a whole copy; it must reach `needed(words)`, a half from eight
words on and more for fewer, so edited, shortened and extended copies count.

Documents are never shuffled: the seeds of at most `PASS_BYTES` of item text are sent to
every executor, and a larger benchmark takes several passes over the documents.

Cases: null or wordless texts and items match nothing; items of four words or fewer
count only as whole copies, those of five or six with one word changed; a null doc_id or item_id is returned as null; repeated rows are
reported each; without items or documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.flat import WINDOW_BASE, Words, mix, prefix, ranges, slices
from lodestone.llm.tables import read

SEED_WORDS = (3, 8)
CHANCE = 1e-9
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE, MORE_A_WORD = 0.5, 0.075
#: Places of the words of a short seed.
SHORT_SEEDS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
SHORT_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
PASS_BYTES = 8 << 20
FILTER_BITS = 20
BATCH_CELLS = 4_000_000

SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False
SEPARATORS[128:] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals U+00C0 to U+00DE as small letters, in UTF-8."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = data[:-1] == 0xC3
    out[latin & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def words_of(texts: list[str]) -> tuple[Words, np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    words = Words(lowered(np.frombuffer(b"".join(raw), dtype=np.uint8)), offsets, SEPARATORS)
    return words, words.hashes()


def needed(sizes: np.ndarray) -> np.ndarray:
    """The least score of an item by its words: falls with each word, down to `LEAST_SCORE`."""
    return np.maximum(LEAST_SCORE, 1 - MORE_A_WORD * (sizes - 1))


def short_seeds(words: Words, hashes: np.ndarray, shape: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the short seeds of one shape, inside texts."""
    places = SHORT_SEEDS[shape]
    size = len(hashes) - places[-1]
    if size <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    value = np.full(size, shape, dtype=np.uint64)
    for base, place in zip(SHORT_BASE, places):
        value += hashes[place : place + size] * base
    starts = np.flatnonzero(words.rows[:size] == words.rows[places[-1] :])
    return starts, mix(value[starts])


def _count(vocabulary):
    """Occurrences of the given word hashes, and of all words under hash 0 (as null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        counts, total = np.zeros(len(known) + 1, dtype=np.int64), 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                hashes = Words(lowered(data), offsets, SEPARATORS).hashes()
                total += len(hashes)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                counts[:-1] += np.bincount(at[known[at] == hashes], minlength=len(known)) if len(known) else 0
        counts[-1] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int64)), pa.array(counts)], ["place", "n"])

    return run


class Items:
    """The items of one pass: words, and seeds by length."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        self.words, self.hashes = words_of(texts)
        self.firsts, self.counts = self.words.firsts, self.words.counts
        self.vocabulary = np.unique(self.hashes)
        #: By length for rare seeds, by -1 - shape for short ones.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.filters: dict[int, np.ndarray] = {}

    def _enter(self, kind: int, hashes: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(hashes)
        rows = self.words.rows[at[order]]
        self.seeds[kind] = hashes[order], rows, at[order] - self.firsts[rows]
        table = np.zeros(1 << FILTER_BITS, dtype=bool)
        table[hashes >> np.uint64(64 - FILTER_BITS)] = True
        self.filters[kind] = table

    def choose(self, shares: np.ndarray) -> None:
        """Seeds from the share of each word of the vocabulary in the corpus."""
        logs = np.log(np.maximum(shares, 1e-12))[np.searchsorted(self.vocabulary, self.hashes)] if len(self.hashes) else np.zeros(0)
        sums = np.concatenate([[0], np.cumsum(logs)])
        ends = self.firsts[self.words.rows + 1]
        places = np.arange(len(self.hashes))
        size = np.zeros(len(places), dtype=np.int64)
        for n in range(*SEED_WORDS, 1):
            fits = (size == 0) & (places + n <= ends)
            rare = fits.copy()
            rare[fits] = sums[places[fits] + n] - sums[places[fits]] <= np.log(CHANCE)
            size[rare] = n
        longest = SEED_WORDS[1]
        size[(size == 0) & (places + longest <= ends)] = longest
        # A short item, or an end with common words only, still has its last words as one seed.
        for item in np.flatnonzero(self.counts):
            first, count = self.firsts[item], self.counts[item]
            if not size[first : first + count].any():
                start = max(0, count - longest)
                size[first + start] = count - start
        prefixes = prefix(self.hashes, WINDOW_BASE)
        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == n)
            self._enter(n, mix(ranges(prefixes, at, at + n, WINDOW_BASE) + np.uint64(n)), at)
        for shape in range(len(SHORT_SEEDS)):
            at, hashes = short_seeds(self.words, self.hashes, shape)
            if len(at):
                self._enter(-1 - shape, hashes, at)

    def hits(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word of a hit, item, place in the item, whether the seed is rare)."""
        out = []
        for n, (seeds, items, places) in self.seeds.items():
            starts, found = words.windows(hashes, n) if n > 0 else short_seeds(words, hashes, -1 - n)
            maybe = np.flatnonzero(self.filters[n][found >> np.uint64(64 - FILTER_BITS)])
            low, high = np.searchsorted(seeds, found[maybe]), np.searchsorted(seeds, found[maybe], "right")
            many = high - low
            seed = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append((np.repeat(starts[maybe], many), items[seed], places[seed], np.full(len(seed), n > 0)))
        if not out:
            return (np.zeros(0, dtype=np.int64),) * 4
        return tuple(map(np.concatenate, zip(*out)))


def align(regions: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, Smith-Waterman with linear gaps, in batches."""
    scores = np.zeros(len(regions), dtype=np.int64)
    order = sorted(range(len(regions)), key=lambda i: (len(items[i]), len(regions[i])))
    low = 0
    while low < len(order):
        high, width, height = low, 0, 0
        while high < len(order):
            width, height = max(width, len(regions[order[high]])), len(items[order[high]])
            if high > low and (high - low + 1) * width > BATCH_CELLS // 64:
                break
            high += 1
        own = order[low:high]
        width = max(len(regions[i]) for i in own)
        height = max(len(items[i]) for i in own)
        text = np.zeros((len(own), width), dtype=np.uint64)
        item = np.full((len(own), height), 1, dtype=np.uint64)
        for row, i in enumerate(own):
            text[row, : len(regions[i])] = regions[i]
            item[row, : len(items[i])] = items[i]
        steps = -GAP * np.arange(width + 1)
        cells = np.zeros((len(own), width + 1), dtype=np.int64)
        best = np.zeros(len(own), dtype=np.int64)
        for k in range(height):
            straight = np.where(text == item[:, k : k + 1], MATCH, MISMATCH) + cells[:, :-1]
            new = np.maximum(cells + GAP, 0)
            np.maximum(new[:, 1:], straight, out=new[:, 1:])
            cells = np.maximum.accumulate(new + steps, axis=1) - steps
            np.maximum(best, cells.max(axis=1), out=best)
        scores[own] = best
        low = high
    return scores


FOUND = "doc_id long, item_id long, score double, n_item_words long, at_word long"


def found_in(known: Items, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
    """(row, item) -> (score, place of the item's first word in the text) of the items in a slice."""
    words = Words(lowered(data), offsets, SEPARATORS)
    hashes = words.hashes()
    at, item, place, rare = known.hits(words, hashes)
    if not len(at):
        return {}
    row, start = words.rows[at], at - place
    order = np.lexsort((start, item, row))
    row, item, start, rare = row[order], item[order], start[order], rare[order]
    slack = known.counts[item] // 4 + 2
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    told = np.logical_or.reduceat(rare, first) | (last > first)
    first, last = first[told], last[told]
    if not len(first):
        return {}
    begin = np.maximum(start[first] - slack[first], words.firsts[row[first]])
    end = np.minimum(start[last] + known.counts[item[first]] + slack[first], words.firsts[row[first] + 1])
    row, item, start = row[first], item[first], start[first]
    own = [known.hashes[known.firsts[i] : known.firsts[i] + known.counts[i]] for i in item.tolist()]
    scores = align([hashes[a:b] for a, b in zip(begin.tolist(), end.tolist())], own)
    sizes = known.counts[item]
    shares = scores / (MATCH * sizes)
    good = shares >= needed(sizes) - 1e-9
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for r, i, share, b in zip(row[good].tolist(), item[good].tolist(), shares[good].tolist(), start[good].tolist()):
        best[r, i] = max(best.get((r, i), (0.0, 0)), (share, -max(0, b - int(words.firsts[r]))))
    return {key: (share, -b) for key, (share, b) in best.items()}


def _find(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = shared.value
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                best = sorted(found_in(known, data, offsets).items())
                if best:
                    ids = batch.column(0).slice(low, high - low)
                    columns = [
                        ids.take(pa.array([r for (r, _), _ in best])), pa.array([known.ids[i] for (_, i), _ in best], pa.int64()),
                        pa.array([round(v[0], 6) for _, v in best]), pa.array([int(known.counts[i]) for (_, i), _ in best], pa.int64()),
                        pa.array([v[1] for _, v in best], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])

    return run


def _clean(shared, place: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.ones(batch.num_rows, dtype=bool)
            for low, _, data, offsets in slices(batch.column(place)):
                kept[[low + r for r, _ in found_in(shared.value, data, offsets)]] = False
            yield batch.filter(pa.array(kept))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, n_item_words, at_word): one row for each item found in a row of *docs*."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    found = [texts.mapInArrow(_find(known), FOUND) for known in passes(texts.select("text"), benchmark, item_col, item_text_col)]
    return reduce(DataFrame.union, found) if found else texts.limit(0).mapInArrow(lambda batches: iter(()), FOUND)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of *docs*, all columns, that hold no item."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    for known in passes(texts, benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_clean(known, docs.columns.index(text_col)), docs.schema)
    return docs


def passes(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> list:
    """Broadcast items with their seeds, at most about `PASS_BYTES` of text in each."""
    spark = texts.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = -(-size // PASS_BYTES)
    found = []
    for number in range(count):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number).orderBy("item_id", "text").collect()  # bounded by PASS_BYTES
        known = Items([r["item_id"] for r in own], [r["text"] for r in own])
        vocabulary = spark.sparkContext.broadcast(known.vocabulary)
        counted = texts.mapInArrow(_count(vocabulary), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(known.vocabulary) + 1)
        for r in counted.collect():  # one row for each distinct word of the items of the pass
            counts[r["place"]] = r["n"]
        known.choose(counts[:-1] / max(counts[-1], 1.0))
        found.append(spark.sparkContext.broadcast(known))
    return found


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLE: dict[str, str] = {}
