"""Markdown structure: lines of documents, their headings, sections and blocks.

`markdown_lines` tells what each line of a document is; a document is one row, so this
needs no shuffle. Sections, heading paths and blocks are windows and groups over the lines.

Every window is partitioned by document, so one shuffle by document id serves
everything up to the finished chunks. A window task holds lines of one document;
no other key is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators.markdown_lines import read_lines

HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
LINES = pa.schema(
    [
        ("document_id", pa.string()),
        ("line_no", pa.int32()),
        ("line", pa.string()),
        ("kind", pa.string()),
        ("block_no", pa.int32()),
        ("item_no", pa.int32()),
        ("is_fence", pa.bool_()),
        ("fence_no", pa.int32()),
        ("heading_level", pa.int32()),
        ("heading_text", pa.string()),
        ("in_heading", pa.bool_()),
    ]
)
LINES_SQL = (
    "document_id string, line_no int, line string, kind string, block_no int, item_no int, is_fence boolean, "
    "fence_no int, heading_level int, heading_text string, in_heading boolean"
)
#: Lines sent at once.
BATCH = 20_000


def explode_lines(documents: DataFrame) -> DataFrame:
    """document_id, content -> document_id, line_no, line."""
    placed = documents.select("document_id", "content").repartition("document_id")
    return placed.select(
        "document_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line")
    )


def _so_far(*keys: str):
    return (
        Window.partitionBy(*keys)
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _read(html: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = LINES.names[3:]
        columns: list[list] = [[] for _ in LINES]

        def sent() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LINES)], schema=LINES)
            for column in columns:
                column.clear()
            return done

        for batch in batches:
            for document_id, content in zip(batch.column(0), batch.column(1)):
                if not content.is_valid:
                    continue
                own_id = document_id.as_py()
                for number, line in enumerate(read_lines(content.as_py(), html)):
                    columns[0].append(own_id)
                    columns[1].append(number)
                    columns[2].append(line.text)
                    for column, name in zip(columns[3:], names):
                        column.append(getattr(line, name))
                    if len(columns[0]) >= BATCH:
                        yield sent()
        if columns[0]:
            yield sent()

    return run


def mark_lines(documents: DataFrame, html: bool = False) -> DataFrame:
    """document_id, content -> one row a line with its kind, block, list item, fence and heading.

    Columns: document_id, line_no, line; kind and block_no (null outside blocks), item_no (in
    lists); is_fence, fence_no and in_code for fences outside lists and quotes; heading_level
    and heading_text, and in_heading for all lines of a heading. A null content has no lines.
    """
    rows = documents.select("document_id", "content").mapInArrow(_read(html), LINES_SQL)
    atx = F.col("heading_level").isNotNull() & F.col("heading_text").isNull()
    title = F.when(atx, t.strip(F.regexp_extract("line", HEADING, 2))).otherwise(F.col("heading_text"))
    marked = rows.withColumn("heading_text", title).withColumn("in_code", F.col("fence_no").isNotNull())
    return marked.repartition("document_id")


def mark_fences(documents: DataFrame) -> DataFrame:
    """Lines with is_fence, fence_no (null outside) and in_code (a fence line or inside one).

    An unclosed fence reaches to the end of its text.
    """
    return mark_lines(documents).select("document_id", "line_no", "line", "is_fence", "fence_no", "in_code")


def heading_path(lines: DataFrame) -> DataFrame:
    """Adds section_no (headings so far) and heading_path.

    The last heading of level n still counts when no heading of a higher rank
    (smaller n) came after it; an empty heading ends deeper ones and adds nothing.
    """
    window = _so_far("document_id")
    last = {
        level: F.last(
            F.when(
                F.col("heading_level") == level,
                F.struct(F.col("line_no").alias("at"), F.col("heading_text").alias("text")),
            ),
            ignorenulls=True,
        ).over(window)
        for level in range(1, 7)
    }
    marked = lines.select(
        "*",
        F.count("heading_level").over(window).alias("section_no"),
        *[last[level].alias(f"_h{level}") for level in last],
    )

    def live(level: int) -> Column:
        text, at = F.col(f"_h{level}.text"), F.col(f"_h{level}.at")
        shadowed = F.lit(False)
        for above in range(1, level):
            shadowed = shadowed | F.coalesce(F.col(f"_h{above}.at") > at, F.lit(False))
        return F.when(~shadowed & (text != ""), text)

    path = F.filter(F.array(*[live(level) for level in last]), lambda text: text.isNotNull())
    return marked.withColumn("heading_path", path).drop(*[f"_h{level}" for level in last])


def blocks(lines: DataFrame) -> DataFrame:
    """One row per block: document_id, section_no, block_no, kind, text, units.

    *units* are the top-level items of a list, in order; null for other kinds. Texts are
    the lines as they stand, trimmed at the end.
    """
    grouped = lines.filter(F.col("kind").isNotNull()).groupBy("document_id", "section_no", "block_no").agg(
        F.first("kind").alias("kind"),
        F.first("heading_path").alias("heading_path"),
        F.sort_array(F.collect_list(F.struct("line_no", "item_no", "line"))).alias("pieces"),
    )

    def joined(rows: Column) -> Column:
        return t.rstrip(F.array_join(F.transform(rows, lambda row: row["line"]), "\n"))

    numbers = F.array_distinct(F.transform("pieces", lambda row: row["item_no"]))
    units = F.transform(
        numbers, lambda number: joined(F.filter("pieces", lambda row: row["item_no"] == number))
    )
    found = grouped.select(
        "document_id", "section_no", "block_no", "kind", "heading_path",
        joined(F.col("pieces")).alias("text"), F.when(F.col("kind") == "list", units).alias("units"),
    ).filter(F.col("text") != "")
    order = Window.partitionBy("document_id", "section_no").orderBy("block_no")
    return found.withColumn("block_no", F.row_number().over(order))


def analyze(documents: DataFrame, html: bool = False) -> DataFrame:
    """Lines of all documents with blocks, headings, section numbers and paths."""
    return heading_path(mark_lines(documents, html))


def sections(documents: DataFrame) -> DataFrame:
    """Non-empty sections: document_id, section_ordinal, heading_path, blocks, chars."""
    found = (
        blocks(analyze(documents))
        .groupBy("document_id", "section_no")
        .agg(
            F.first("heading_path").alias("heading_path"),
            F.count(F.lit(1)).alias("blocks"),
            F.sum(F.length("text")).alias("chars"),
        )
    )
    order = Window.partitionBy("document_id").orderBy("section_no")
    return found.select(
        "document_id",
        (F.row_number().over(order) - 1).alias("section_ordinal"),
        "heading_path",
        "blocks",
        "chars",
    )
