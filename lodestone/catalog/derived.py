"""Inputs derived from the driver tables; the same rules in Spark and in SQL.

The tables carry no visibility, titles, Markdown or calls, so these are computed
from their columns, for every row. `SQL` holds the matching common table
expressions by name, each with the ones it needs.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import constants as k


@cache
def _sql_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_list(values) -> str:
    return _sql_list(tuple(values))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(number, values):
    """values[number % n] as a CASE; the arithmetic is the same in both engines."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def sql_pick(number: str, values) -> str:
    return f"(['" + "','".join(values) + f"'])[(({number}) % {len(values)} + 1)]"


# --- documents ----------------------------------------------------------------
def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the metadata the operators need."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    labelled = docs.join(labels, "doc_id", "left")
    return labelled.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("source"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_path"),
        pick(F.col("doc_id"), k.DOCUMENT_TYPES).alias("document_type"),
        F.col("lang").alias("language"),
        F.when(F.col("toxic") == 1, "internal").otherwise("public").alias("visibility"),
        F.when(F.col("quality") == 1, "verified").otherwise("unverified").alias("trust_level"),
        F.array("source", "lang").alias("topics"),
        F.array().cast("array<string>").alias("technologies"),
        F.col("text").alias("content"),
    )


#: Lines 1 to 4 of a nested fence (number modulo 4) and the underlines of setext headings.
NESTED = ("~~~~ ", "~~~~", "```", "~~~")
UNDERLINES = ("===", "---", "")
#: Containers around every seventh line of some documents, and the heading inside: by number modulo 11.
BOXES = {7: ("list", "- ", "  ## in a list"), 9: ("quote", "> ", "> ## in a quote"), 2: ("html", "<!-- ", "## in a comment -->")}


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, content: the text with headings of both kinds, blank lines and fences.

    Some fences hold shorter fences and fences of the other character; some list items,
    quotes and comments hold headings.
    """
    docs = table(spark, folder, "documents")

    def shape(line, number):
        fence = (F.col("doc_id") % 11 == 0) & ((number == 1) | (number == 4))
        nested = (F.col("doc_id") % 11 == 4) & number.between(1, 4)
        under = F.when((number % 7 == 5) & (F.col("doc_id") % 3 < 2), pick(F.col("doc_id"), UNDERLINES))
        start = F.when(fence, "```").when(nested, pick(number, NESTED))
        for residue, (_, mark, heading) in BOXES.items():
            boxed = (F.col("doc_id") % 11 == residue) & (number % 7 == 2)
            start = start.when(boxed, F.concat(F.lit(mark), line))
            under = F.when(boxed, heading).otherwise(under)
        return F.concat(
            start.when(number % 7 == 0, F.concat(F.lit("## "), line))
            .when(number % 7 == 3, F.concat(F.lit("### "), line))
            .otherwise(line),
            F.lit("\n"),
            F.coalesce(under, F.lit("")),
        )

    body = F.array_join(F.transform(F.split("text", "\n"), shape), "\n")
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        "source",
        body.alias("content"),
    )


SQL: dict[str, str] = {}
SQL["docs"] = f"""docs AS (
  SELECT d.doc_id, 'doc-' || d.doc_id AS document_id, 'Document ' || d.doc_id AS title,
    d.source, d.source || '/' || d.doc_id || '.md' AS source_path,
    {sql_pick('d.doc_id', k.DOCUMENT_TYPES)} AS document_type, d.lang AS language,
    CASE WHEN l.toxic = 1 THEN 'internal' ELSE 'public' END AS visibility,
    CASE WHEN l.quality = 1 THEN 'verified' ELSE 'unverified' END AS trust_level,
    [d.source, d.lang] AS topics, d.text AS content
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
SQL["md_lines"] = f"""md_lines AS (
  SELECT doc_id, 'doc-' || doc_id AS document_id, 2 * i AS line_no,
    CASE {"".join(f"WHEN doc_id % 11 = {n} AND i % 7 = 2 THEN '{b[2]}' " for n, b in BOXES.items())}
         WHEN i % 7 = 5 THEN {sql_pick("doc_id", UNDERLINES)} ELSE '' END AS under,
    CASE {"".join(f"WHEN doc_id % 11 = {n} AND i % 7 = 2 THEN '{b[0]}' " for n, b in BOXES.items())} END AS box,
    CASE {"".join(f"WHEN doc_id % 11 = {n} AND i % 7 = 2 THEN '{b[1]}' || line " for n, b in BOXES.items())}
         WHEN doc_id % 11 = 0 AND i IN (1, 4) THEN '```'
         WHEN doc_id % 11 = 4 AND i BETWEEN 1 AND 4 THEN {sql_pick("i", NESTED)}
         WHEN i % 7 = 0 THEN '## ' || line
         WHEN i % 7 = 3 THEN '### ' || line ELSE line END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM documents))"""
SQL["md_docs"] = """md_docs AS (
  SELECT document_id, string_agg(line || chr(10) || under, chr(10) ORDER BY line_no) AS content
  FROM md_lines GROUP BY document_id)"""


def with_sql(names: str, body: str, extra: str = "") -> str:
    """WITH clause of the named expressions, then *extra* ones, then the query."""
    parts = [SQL[name] for name in names.split()]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body
