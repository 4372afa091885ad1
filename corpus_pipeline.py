"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame: the columns of documents for all but the last, whose rows are doc_id, n_tokens,
ids_sha256 and decoded_sha256 of every document that is left.

1. language_id: rows without a known language go.
2. line_dedup: repeated and nearly repeated lines go from the texts, rows stay.
3. simhash_near_dedup: one row stays of each group of near copies (candidates by deletion variants of
   SimHashes, links verified at a five-word similarity of 0.8 or more): that with the least id, null last.
4. benchmark_decontamination: rows that hold a benchmark item go.
5. bpe_encode_decode: texts as ids of the byte-level vocabulary, and back.

Null and empty texts go in the first stage (they have no letter). Texts that lose all lines
in the second are copies of others and form one group in the third. Empty tables give empty
results. Columns beyond those of documents are carried along unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, language, lines, near_copies
from lodestone.llm.tables import prepare, read
from lodestone.session import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    learned = docs.where(~language.held_out() & F.col("doc_id").isNotNull())
    return language.accepted(docs, language.train(learned))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    kept = lines.without_repeats(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.char_length("text").cast(kind))
    return kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_copies.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.digests(bpe.encode_texts(docs, bpe.byte_vocabulary()))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encode_decode", bpe_encode_decode),
]
#: No SQL: a trained classifier, an edit join and a tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
