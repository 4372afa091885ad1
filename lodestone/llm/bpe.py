"""Byte-level BPE of whole texts by chunks that documents share, and its inverse.

A text is cut where a rolling hash of the last 16 bytes meets a condition, so the cuts
depend on content alone and a passage has the same chunks in every document. A chunk
that a worker has met is not encoded again; inside a new chunk every piece of the
tokenizer's own splitting rule goes through the tokenizers library once and is remembered.

A cut may fall inside a piece, so joins are repaired: the last pieces of the left side
(`MARGIN` characters or more, which is further than the rule looks ahead) and the first
pieces of the right side are split anew, and the window grows until both splittings agree
on a boundary. From there on they are the same, since the rule reads left to right and
looks back at nothing. Chunks without a boundary inside (parts of one long run of letters,
digits, marks or blanks) are put together again and split once, and pieces are encoded when
all joins are made, so a long run is encoded once, as a whole. Special tokens in a text are
cut out first, as the library does.

What a worker remembers is bounded (`PIECES` of `encoded.LONGEST_KEPT` characters at most,
and `CHUNK_CHARS`); it lives in the worker, so nothing is shuffled and a lost executor costs
its own tasks only.

Cases: null text counts as empty (no ids, empty text); repeated rows are encoded each;
a null doc_id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.encoded import WordIds
from lodestone.llm.flat import BYTE_VALUES, powers, prefix, slices, WORD_BASE
from lodestone.llm.tables import read, released

WINDOW_BYTES, CUT_BITS = 16, 8
LEAST_CHUNK, MOST_CHUNK = 64, 8192
MARGIN = 4
#: Characters of chunks a worker remembers.
CHUNK_CHARS = 1_000_000
#: Pieces a worker remembers, in each of two generations.
PIECES = 120_000
SLICE = 1 << 18

#: The splitting rule for the characters that `COMMON` covers; the library splits the rest.
PIECE = re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on which Python's classes and the tokenizer's are not known to agree.
UNCOMMON = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkCoder:
    def __init__(self, vocabulary: str):
        self.ids = WordIds(vocabulary, PIECES)
        self.tokenizer = self.ids.tokenizer
        self.chunks: dict[bytes, tuple[list[str], list[bytes]]] = {}
        self.held = 0
        symbols = byte_of_symbol()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token_bytes: dict[int, bytes] = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            raw = token.encode() if token in self.special else bytes(symbols[c] for c in token)
            self.token_bytes[i] = raw

    def split(self, text: str) -> list[str]:
        if UNCOMMON.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return PIECE.findall(text)

    def learn(self, chunks: Iterable[bytes]) -> None:
        new = [(chunk, self.split(chunk.decode())) for chunk in set(chunks).difference(self.chunks)]
        self.ids.learn(chain.from_iterable(pieces for _, pieces in new if len(pieces) > 1))
        for chunk, pieces in new:
            codes = list(map(self.ids.new.__getitem__, pieces)) if len(pieces) > 1 else None
            self.chunks[chunk] = pieces, codes
            self.held += len(chunk)

    def forget(self) -> None:
        self.ids.forget()
        if self.held > CHUNK_CHARS:
            self.chunks, self.held = {}, 0

    def parts(self, chunks: list[bytes]) -> Iterator[tuple[list[str], list[bytes | None]]]:
        """(pieces, their codes) of the chunks of a text; neighbours without a boundary inside are one."""
        run: list[bytes] = []
        for chunk in [*chunks, None]:
            pieces, codes = self.chunks[chunk] if chunk is not None else ((), ())
            if codes is None:
                run.append(chunk)
                continue
            if run:
                whole = self.split(b"".join(run).decode()) if len(run) > 1 else self.chunks[run[0]][0]
                yield whole, [None] * len(whole)
                run = []
            if pieces:
                yield pieces, codes

    def join(self, pieces: list[str], codes: list[bytes | None], right: list[str], right_codes: list[bytes | None]) -> None:
        """Append a part to the pieces of a text, splitting anew around the join."""
        tail, size = len(pieces), 0
        while tail and size < MARGIN:
            tail -= 1
            size += len(pieces[tail])
        left = "".join(pieces[tail:])
        taken = 4
        while True:
            taken = min(taken, len(right))
            text = left + "".join(right[:taken])
            trusted = len(text) if taken == len(right) else len(text) - MARGIN
            anew = self.split(text)
            i, j, a, b = 0, 0, 0, len(left)
            while a != b and b <= trusted:
                if a < b:
                    a += len(anew[i])
                    i += 1
                else:
                    b += len(right[j])
                    j += 1
            if a == b <= trusted:
                pieces[tail:] = anew[:i]
                codes[tail:] = [None] * i
                pieces += right[j:]
                codes += right_codes[j:]
                return
            taken *= 4

    def encode(self, chunks: list[bytes]) -> bytes:
        """32-bit ids of a text without special tokens, given as its chunks."""
        pieces: list[str] = []
        codes: list[bytes | None] = []
        for own, own_codes in self.parts(chunks):
            if pieces:
                self.join(pieces, codes, own, own_codes)
            else:
                pieces, codes = list(own), list(own_codes)
        missing = [i for i, code in enumerate(codes) if code is None]
        self.ids.learn(pieces[i] for i in missing)
        for i in missing:
            codes[i] = self.ids.new[pieces[i]]
        return b"".join(codes)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Content-defined cuts in a slice, ascending: ends of rolling-hash windows, at character starts."""
    if len(data) <= WINDOW_BYTES:
        return np.zeros(0, dtype=np.int64)
    sums = prefix(BYTE_VALUES[data], WORD_BASE)
    hashes = (sums[WINDOW_BYTES:] - sums[:-WINDOW_BYTES]) * powers(WORD_BASE, len(sums))[1][: len(sums) - WINDOW_BYTES]
    at = np.flatnonzero(hashes >> np.uint64(64 - CUT_BITS) == 0) + WINDOW_BYTES
    at = at[at < len(data)]
    at = at[data[at] & 0xC0 != 0x80]
    rows = np.searchsorted(offsets, at, "right") - 1
    return at[at - offsets[rows] >= WINDOW_BYTES]


def chunk_ends(low: int, high: int, found: list[int], data: np.ndarray) -> list[int]:
    """Ends of the chunks of [low, high): found cuts, none too close, none too far apart."""
    ends, last = [], low
    for at in [*found, high]:
        while at - last > MOST_CHUNK:
            step = last + MOST_CHUNK
            while data[step] & 0xC0 == 0x80:
                step -= 1
            ends.append(step)
            last = step
        if at - last >= LEAST_CHUNK and at < high:
            ends.append(at)
            last = at
    return [*ends, high] if high > last else ends


@cache
def coder(vocabulary: str) -> ChunkCoder:
    return ChunkCoder(vocabulary)


CODED = "doc_id long, ids array<int>, decoded string"


def _encode(vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary.value)
        special = [s.encode() for s in own.special]
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1), SLICE):
                raw, at = data.tobytes(), cuts(data, offsets)
                firsts = np.searchsorted(at, offsets)
                texts = []
                for k, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    found = at[firsts[k] : firsts[k + 1]].tolist()
                    parts, marks = [(start, end)], []
                    if any(s in raw[start:end] for s in special):
                        parts, marks, here = [], [], start
                        for piece in own.cut.split(raw[start:end].decode()):
                            size = len(piece.encode())
                            if piece in own.special:
                                marks.append(own.special[piece])
                            else:
                                parts.append((here, here + size))
                            here += size
                    chunks = []
                    for a, b in parts:
                        ends = chunk_ends(a, b, [x for x in found if a < x < b], data)
                        chunks.append([raw[x:y] for x, y in zip([a, *ends], ends)])
                    texts.append((chunks, marks))
                own.learn(c for chunks, _ in texts for part in chunks for c in part)
                coded = []
                for chunks, marks in texts:
                    ids = own.encode(chunks[0])
                    for mark, part in zip(marks, chunks[1:]):
                        ids += mark.to_bytes(4, "little") + own.encode(part)
                    coded.append(np.frombuffer(ids, dtype="<i4"))
                own.forget()
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
                flat = np.concatenate(coded) if coded else np.zeros(0, dtype=np.int32)
                listed = flat.tolist()
                decoded = [own.decode(listed[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_texts(docs: DataFrame, vocabulary_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text, and the text they decode to."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_json)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(_encode(vocabulary)), CODED)


def byte_vocabulary() -> str:
    import public_tokenizers

    return open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_texts(read(spark, sf_dir, "documents"), byte_vocabulary()))


QUERIES = {"op10_bpe_encode_decode": op10_bpe_encode_decode}
ORACLE: dict[str, str] = {}
