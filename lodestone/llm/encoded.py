"""Token ids in files of Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 bits of payload: the selector says how many
ids of which width are packed. `FORMS` lists count and width for selectors 0 to 14;
selector 15 is an escape, its payload the place of an id of more than 60 bits in a list
behind the words. Ids are coded in blocks of `BLOCK`; the offset of every block's first
word is stored, so that blocks are decoded side by side in numpy.

A file is one binary value, at most about `FILE_IDS` ids (a longer document has a file of
its own), so a reader's memory is bounded; files stand in rows of a Parquet table with
their document ids, counts and order. Documents are written in ascending doc_id order.

Cases: null text counts as empty and has the end id alone; null doc_ids come first; rows
with one doc_id follow each other in the order of their texts; no documents, no files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.flat import SPACE, slices
from lodestone.llm.tables import read, side

#: Selector -> (ids in a word, bits of each).
FORMS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (0, 0))
ESCAPE = 15
BLOCK = 512
FILE_IDS = 1 << 20
END_ID = 1
#: Distinct words a worker remembers the ids of.
WORDS_KEPT = 400_000
#: Longer ones are not remembered beyond the texts at hand.
LONGEST_KEPT = 256
#: Bytes of text whose words are looked up together.
SLICE_BYTES = 4 << 20
#: New words of letters sent through the tokenizer as one text.
AT_ONCE = 2000
COUNTS = np.array([n for n, _ in FORMS] + [1], dtype=np.int64)


def encode(ids: np.ndarray) -> bytes:
    """The ids as one file: header, block offsets, words, escaped ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    size = len(ids)
    blocks = -(-size // BLOCK)
    # The form at each place: the one with most ids whose ids all fit. A block's last word
    # may be short: it holds what is left, so places behind a block count as width 0.
    widths = np.zeros((blocks, BLOCK), dtype=np.uint8)
    widths.reshape(-1)[:size] = bit_widths(ids)
    form = np.full((blocks, BLOCK), ESCAPE, dtype=np.uint8)
    widest = {1: widths}
    for selector in range(len(FORMS) - 1):
        count, width = FORMS[selector]
        np.minimum(form, np.where(_window_max(widest, count) <= width, np.uint8(selector), np.uint8(ESCAPE)), out=form)
    form = form.reshape(-1)[:size]
    left = np.minimum((np.arange(size) // BLOCK + 1) * BLOCK, size) - np.arange(size)
    taken = np.minimum(COUNTS[form], left)
    at = np.arange(blocks) * BLOCK
    stop = np.minimum(at + BLOCK, size)
    places, owners = [], []
    active = np.arange(blocks)
    while len(active):
        places.append(at[active])
        owners.append(active)
        at[active] += taken[at[active]]
        active = active[at[active] < stop[active]]
    places = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
    places.sort()
    words = np.zeros(len(places), dtype=np.uint64)
    chosen = form[places]
    escaped = ids[places[chosen == ESCAPE]]
    words[chosen == ESCAPE] = np.arange(len(escaped), dtype=np.uint64)
    padded = np.concatenate([ids, np.zeros(64, dtype=np.uint64)])
    for selector, (count, width) in enumerate(FORMS):
        mine = np.flatnonzero(chosen == selector)
        if not len(mine) or not count:
            continue
        start, left = places[mine], taken[places[mine]]
        packed = np.zeros(len(mine), dtype=np.uint64)
        for k in range(count):
            value = np.where(k < left, padded[start + k], np.uint64(0))
            packed |= value << np.uint64(k * width)
        words[mine] = packed
    words |= chosen.astype(np.uint64) << np.uint64(60)
    per_block = np.bincount(places // BLOCK, minlength=blocks)
    offsets = np.concatenate([[0], np.cumsum(per_block)])[: blocks + 1]
    head = np.array([size, blocks, len(words), len(escaped)], dtype="<u8")
    return b"".join(x.tobytes() for x in (head, offsets.astype("<u8"), words.astype("<u8"), escaped.astype("<u8")))


def bit_widths(ids: np.ndarray) -> np.ndarray:
    high, low = ids >> np.uint64(32), ids & np.uint64(0xFFFFFFFF)
    width = np.frexp(low.astype(np.float64))[1]
    if high.any():
        width = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], width)
    return width.astype(np.uint8)


def _window_max(known: dict[int, np.ndarray], count: int) -> np.ndarray:
    """The greatest of *count* values from each place on, inside its row."""
    base = max(n for n in known if n <= count)
    while base * 2 <= count:
        known[base * 2] = _both(known[base], base)
        base *= 2
    return known[base] if base == count else _both(known[base], count - base)


def _both(values: np.ndarray, shift: int) -> np.ndarray:
    out = values.copy()
    np.maximum(out[:, :-shift], values[:, shift:], out=out[:, :-shift])
    return out


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks [first, last) of a file, all by default."""
    size, blocks, words, escapes = np.frombuffer(data, dtype="<u8", count=4).astype(np.int64).tolist()
    offsets = np.frombuffer(data, dtype="<u8", count=blocks + 1, offset=32).astype(np.int64)
    last = blocks if last is None else min(last, blocks)
    low, high = int(offsets[first]), int(offsets[last])
    coded = np.frombuffer(data, dtype="<u8", count=high - low, offset=32 + 8 * (blocks + 1) + 8 * low)
    beyond = np.frombuffer(data, dtype="<u8", count=escapes, offset=32 + 8 * (blocks + 1) + 8 * words)
    selectors = (coded >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    block = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1]))
    total = np.cumsum(counts) - counts
    starts = offsets[first:last] - low
    within = total - np.repeat(total[starts], np.diff(offsets[first : last + 1])) if len(coded) else total
    place = (block - first) * BLOCK + within
    # Room for one word's zeros behind every block end.
    out = np.zeros((last - first) * BLOCK + 64, dtype=np.uint64)
    for selector in np.unique(selectors).tolist():
        mine = np.flatnonzero(selectors == selector)
        payload = coded[mine] & np.uint64((1 << 60) - 1)
        if selector == ESCAPE:
            out[place[mine]] = beyond[payload.astype(np.int64)]
            continue
        count, width = FORMS[selector]
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            inside = within[mine] + k < BLOCK
            out[(place[mine] + k)[inside]] = (payload >> np.uint64(k * width) & mask)[inside]
    return out[: min(last * BLOCK, size) - first * BLOCK]


# --- encoding texts ------------------------------------------------------------
#: The splitting rule under which letters, marks and digits are separate pieces.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: letters and digits of ASCII, marks other than the apostrophe, the rest.
OTHER, PLAIN, MARK = range(3)
KINDS = bytes(PLAIN if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else MARK if 33 <= b < 127 and b != 39 and not chr(b).isalnum() else OTHER for b in range(256))
PLAINS = np.frombuffer(KINDS, dtype=np.uint8) == PLAIN
#: Second byte of the letters U+00E0 to U+00FF behind 0xC3 (U+00F7 is a division sign), and of their capitals.
LATIN = np.zeros(256, dtype=bool)
LATIN[[b for b in range(0xA0, 0xC0) if b != 0xB7]] = True
CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[[b for b in range(0x80, 0x9F) if b != 0x97]] = True
#: Words that the normalizer leaves as they are and the splitting rule leaves whole.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")


def plain_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the first word of each (and the end), for a lower-casing
    tokenizer that separates letters from marks.

    Marks and the letters or digits beside them are words of their own, and capitals become
    small: the tokenizer gives the same ids, and far fewer words are distinct. Texts that may
    hold a special token, or marks that join a letter before them, stay as they are.
    """
    kept = np.array([b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in texts], dtype=bool)
    # Blanks end each text; the last two also stand before the first byte.
    raw = b" ".join([*(t if k else t.lower() for t, k in zip(texts, kept.tolist())), b" "])
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])

    def changed(at: np.ndarray) -> np.ndarray:
        return at[~kept[np.searchsorted(edges, at, "right") - 1]] if kept.any() else at

    data = np.frombuffer(raw, dtype=np.uint8)
    second = np.flatnonzero(data == 0xC3) + 1
    second = changed(second[CAPITAL[data[second]]])
    if len(second):
        data = data.copy()
        data[second] += 0x20
    at = changed(np.flatnonzero(np.frombuffer(raw.translate(KINDS), dtype=np.uint8) == MARK))
    left, right = data[at - 1], data[at + 1]
    before = PLAINS[left] | (LATIN[left] & (data[at - 2] == 0xC3))
    after = PLAINS[right] | ((right == 0xC3) & LATIN[data[np.minimum(at + 2, len(data) - 1)]])
    places = np.sort(np.concatenate([at[before], at[after] + 1]))
    data = np.insert(data, places, 32)
    edges += np.searchsorted(places, edges)
    solid = ~SPACE[data]
    turns = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    bounds = np.concatenate([[0], turns]) if solid[0] else turns
    offsets = np.concatenate([[0], np.cumsum(bounds[1::2] - bounds[::2])])
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[solid])]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers), np.searchsorted(bounds[::2], edges)


class Known(dict):
    """Words with their ids; a missing one is taken from the older generation, or noted and None."""

    def __init__(self, old: dict):
        self.old, self.missing = old, []

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            self.missing.append(word)
        else:
            self[word] = ids
        return ids


class WordIds:
    """Ids of texts under a tokenizer that never joins characters across ASCII white space.

    Each distinct word goes through the tokenizer once and is remembered; two generations
    bound what is kept and keep frequent words.
    """

    def __init__(self, vocabulary: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.kept = kept
        # Spark runs a task on each core already: the library's own threads only take turns.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.new, self.long = Known({}), []
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.bare, self.ends = self._bare(json.loads(vocabulary), suffix) if suffix else (None, None)

    @staticmethod
    def _bare(vocabulary: dict, suffix: str):
        """The same model for many words of letters at once, and which ids end a word; None where that is not sure."""
        from tokenizers import Tokenizer

        model, rule = vocabulary["model"], (vocabulary.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if len(rule) != 2 or rule[0].get("pattern") != {"Regex": APART} or rule[1]["type"] != "ByteLevel":
            return None, None
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, rule[1]]}
        bare = Tokenizer.from_str(json.dumps(vocabulary | {"normalizer": None, "pre_tokenizer": split, "added_tokens": [], "truncation": None, "padding": None}))
        ends = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        return bare, ends

    @property
    def old(self) -> dict[bytes | str, bytes]:
        return self.new.old

    def _coded(self, words: list[bytes | str]) -> Iterator[tuple[bytes | str, bytes]]:
        """(word, its ids) of each word."""
        rest = words
        if self.bare is not None:
            plain, rest = [], []
            for word in words:
                (plain if LETTERS.fullmatch(word) else rest).append(word)
            for low in range(0, len(plain), AT_ONCE):
                part = plain[low : low + AT_ONCE]
                ids = np.array(self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
                stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                if len(stops) != len(part):
                    rest += part
                    continue
                raw = ids.tobytes()
                yield from zip(part, (raw[s:e] for s, e in zip([0, *stops], stops)))
        for low in range(0, len(rest), 20_000):
            part = rest[low : low + 20_000]
            coded = self.tokenizer.encode_batch_fast([w if isinstance(w, str) else w.decode() for w in part], add_special_tokens=False)
            yield from zip(part, (array("I", x.ids).tobytes() for x in coded))

    def _add(self, words: Iterable[bytes | str]) -> None:
        words = list(set(words))
        self.new.update(self._coded(words))
        self.long += [w for w in words if len(w) > LONGEST_KEPT]

    def learn(self, words: Iterable[bytes | str]) -> None:
        deque(map(self.new.__getitem__, set(words)), 0)
        self._add(self.new.missing)
        self.new.missing.clear()

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """32-bit ids of each text, with the end id behind."""
        if not texts:
            return []
        words, firsts = plain_words(texts)
        distinct = words.dictionary_encode()
        known = distinct.dictionary.to_pylist()
        ids = list(map(self.new.__getitem__, known))
        self._add(self.new.missing)
        self.new.missing.clear()
        ids = [self.new[word] if own is None else own for word, own in zip(known, ids)]
        self.forget()
        pool = np.frombuffer(b"".join([*ids, np.array([end_id], dtype="<u4").tobytes()]), dtype="<u4")
        sizes = np.array([*map(len, ids), 4]) // 4
        codes = np.insert(distinct.indices.to_numpy(), firsts[1:], len(ids))
        counts = sizes[codes]
        ends = np.cumsum(counts)
        starts = (np.cumsum(sizes) - sizes)[codes]
        flat = pool[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]
        return np.split(flat, ends[firsts[1:] + np.arange(len(texts))][:-1])

    def forget(self) -> None:
        for word in self.long:
            del self.new[word]
        self.long.clear()
        if len(self.new) > self.kept:
            self.new.old = {}
            self.new = Known(self.new)


@cache
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


FILES = pa.schema([("first_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("n_tokens", pa.int64()), ("data", pa.binary())])
FILES_SQL = "first_id long, part int, seq int, ids binary, counts binary, n_tokens long, data binary"


def _write(vocabulary, end_id: int, file_ids: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = word_ids(vocabulary.value)
        part, seq = TaskContext.get().partitionId(), 0
        ids, coded, held = [], [], 0

        def flush() -> pa.RecordBatch:
            known = pa.array(ids, pa.int64())
            counts = np.array([len(x) for x in coded], dtype="<u8")
            row = (ids[0], part, seq, _ids_to_bytes(known), counts.tobytes(), int(counts.sum()), encode(np.concatenate(coded)))
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, FILES)], schema=FILES)

        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1), SLICE_BYTES):
                raw = data.tobytes()
                texts = [raw[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                for doc_id, found in zip(batch.column(0).slice(low, high - low).to_pylist(), coder.encode(texts, end_id)):
                    ids.append(doc_id)
                    coded.append(found)
                    held += len(found)
                    if held >= file_ids:
                        yield flush()
                        ids, coded, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    return run


def _ids_to_bytes(ids: pa.Array) -> bytes:
    """Ids and, for nulls, a mark."""
    return np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)], axis=1).astype("<i8").tobytes()


def write_token_files(docs: DataFrame, vocabulary_json: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, write the files as a Parquet table at *path*, return it as read back."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(vocabulary_json)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(_write(vocabulary, end_id, file_ids), FILES_SQL)
    files.write.option("compression", "none").parquet(path)
    return spark.read.schema(files.schema).parquet(path)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            known = np.frombuffer(row["ids"], dtype="<i8").reshape(-1, 2)
            counts = np.frombuffer(row["counts"], dtype="<u8").astype(np.int64)
            tokens = decode(row["data"]).astype("<u4")
            ends = np.cumsum(counts)
            checks = [zlib.crc32(tokens[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(known[:, 0], mask=known[:, 1] == 1), pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(checks, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    # Parts are ranges of ids in ascending order. Their totals, one row for each part of the
    # write, are the only ordered pass over all; files are counted within their part.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "seq", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_part"))
    firsts = totals.select("part", F.coalesce(F.sum("n_part").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    within = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    starts = sizes.select("part", "seq", within.alias("in_part")).join(firsts, "part")
    starts = side(starts, "token-starts", F.lit(24))
    placed = files.join(starts, ["part", "seq"]).withColumn("start", F.col("part_start") + F.col("in_part"))
    return placed.select("ids", "counts", "data", "start").mapInArrow(_read, READ)


def op5_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from lodestone.session import shared_folder

    vocabulary = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(read(spark, sf_dir, "documents"), vocabulary, path))


QUERIES = {"op5_token_binary_output": op5_token_binary_output}
ORACLE: dict[str, str] = {}
