"""Language of whole texts by multinomial naive Bayes over hashed character n-grams.

Characters other than letters count as one space; 1- to 3-grams of the lower-cased rest
are hashed into `BUCKETS` features. Counts per language come from a bounded sample of
labelled rows (`TRAIN_ROWS`, chosen by a hash of the id, so runs agree). The matrix of
log-probabilities, languages x buckets, is broadcast; texts are scored in numpy, every
n-gram of the whole text.

score is the posterior of the chosen language with the evidence counted as at most
`EVIDENCE` n-grams, so that it stays telling for long texts of two languages.

Cases: null text, or one without a letter, gives `und` and score 0; no labelled row,
likewise for all; a null doc_id is not held out and not learned from; repeated rows are
learned from and predicted each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import read, released

ORDERS = (1, 2, 3)
BUCKETS = 1 << 17
#: About so many labelled rows are learned from, all if there are fewer.
TRAIN_ROWS = 40_000
SMOOTHING = 0.5
EVIDENCE = 64
SLICE_CHARS = 400_000
UNKNOWN = "und"
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all n-grams, rows ascending, one order at a time."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    points = np.where(letters()[points], points, np.uint32(32))
    first = np.ones(len(points), dtype=bool)
    first[1:] = rows[1:] != rows[:-1]
    kept = np.ones(len(points), dtype=bool)
    kept[1:] = (points[1:] != 32) | (points[:-1] != 32) | first[1:]
    points, rows = points[kept], rows[kept]
    for order in ORDERS:
        size = len(points) - order + 1
        if size <= 0:
            continue
        value = np.full(size, order, dtype=np.uint32)
        for k in range(order):
            value = (value ^ points[k : k + size]) * FACTORS[k]
            value ^= value >> np.uint32(15)
        inside = rows[:size] == rows[order - 1 :]
        yield rows[:size][inside], (value[inside] & np.uint32(BUCKETS - 1)).astype(np.int32)


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about SLICE_CHARS characters."""
    held, size, first = [], 0, 0
    for i, value in enumerate(column):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> n-gram counts per language, summed within the task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for first, texts in _pieces(batch.column(1)):
            langs = np.array(batch.column(0).slice(first, len(texts)).to_pylist(), dtype=object)
            for rows, buckets in grams(texts):
                for lang in set(langs.tolist()):
                    own = np.bincount(buckets[langs[rows] == lang], minlength=BUCKETS)
                    totals[lang] = totals.get(lang, 0) + own
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used].astype(np.int64))],
            ["lang", "bucket", "n"],
        )


class Model:
    """Languages, log priors, and log-probabilities as buckets x languages."""

    def __init__(self, langs: list[str], priors: np.ndarray, logs: np.ndarray):
        self.langs, self.priors, self.logs = langs, priors, logs

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        total = np.zeros((len(texts), len(self.langs)))
        counts = np.zeros(len(texts))
        if self.langs:
            for rows, buckets in grams(texts):
                starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else []
                if len(rows):
                    total[rows[starts]] += np.add.reduceat(self.logs[buckets], starts, axis=0, dtype=np.float64)
                    counts += np.bincount(rows, minlength=len(texts))
        known = np.array([bool(self.langs) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), counts
        scale = np.minimum(counts, EVIDENCE) / np.maximum(counts, 1)
        best = (total + self.priors).argmax(axis=1)
        tempered = total * scale[:, None] + self.priors
        odds = np.exp(tempered - tempered.max(axis=1, keepdims=True))
        score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        names = [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        return names, np.where(known, score, 0.0)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learn from about *rows* rows of *labelled*, by id hash; rows without label or text are skipped."""
    usable = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.where("lang is not null and text is not null")
    count = usable.count()
    share = min(1.0, rows / max(count, 1))
    sample = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else usable
    found = sample.select("lang", "text").mapInArrow(released(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = found.toPandas()  # at most languages x buckets rows
    priors = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(set(table["lang"]))
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    for i, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        counts[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    logs = np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else counts.astype(np.float32)
    weights = np.array([float(priors[x]) for x in langs])
    return Model(langs, np.log(weights / weights.sum()) if langs else weights, logs)


def _predict(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _pieces(batch.column(2)):
                names, scores = model.value.predict(texts)
                own = [batch.column(i).slice(first, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


#: Texts below this score are rejected.
LEAST_SCORE = 0.5


def _accept(model, place: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for _, texts in _pieces(batch.column(place)):
                names, scores = model.value.predict(texts)
                if model.value.langs:
                    kept += [n != UNKNOWN and s >= LEAST_SCORE for n, s in zip(names, scores.tolist())]
                else:
                    kept += [any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of *docs*, all columns, whose language is known with a score of `LEAST_SCORE` or more.

    Without any learned language, the rows whose text has a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(released(_accept(shared, docs.columns.index(text_col))), docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(_predict(shared)), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs.where(~held_out() & F.col("doc_id").isNotNull())))


QUERIES = {"op7_language_id": op7_language_id}
ORACLE: dict[str, str] = {}
