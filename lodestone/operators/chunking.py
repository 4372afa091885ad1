"""Chunks from blocks: fitting, packing, overlap, ids, statistics and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.functions import digests
from lodestone.functions import text as t
from lodestone.functions.binding import let
from lodestone.operators import structure
from lodestone.policies import ChunkingPolicy

SENTENCE_END = r"(?U)([.!?…][\"'»”’)\]]*+)" + t.WS + "+"
#: A noncharacter put where sentences part.
BREAK = "\ufdd0"
FIRST_SENTENCE_BREAK = r"(?sU)^.*?[.!?…][\"'»”’)\]]*" + t.WS + "+(.*)$"


def pack_units(units: Column, separator: str, limit: int) -> Column:
    """Greedy grouping: a unit joins the current group while the sum stays within *limit*."""
    gap = len(separator)
    empty = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("current")
    )

    def step(acc: Column, unit: Column) -> Column:
        fits = acc["current"].isNotNull() & (
            F.length(acc["current"]) + gap + F.length(unit) <= limit
        )
        flushed = F.when(acc["current"].isNull(), acc["done"]).otherwise(
            F.array_append(acc["done"], acc["current"])
        )
        return F.struct(
            F.when(fits, acc["done"]).otherwise(flushed).alias("done"),
            F.when(fits, F.concat(acc["current"], F.lit(separator), unit)).otherwise(unit).alias("current"),
        )

    return F.aggregate(
        units,
        empty,
        step,
        lambda acc: F.when(acc["current"].isNull(), acc["done"]).otherwise(
            F.array_append(acc["done"], acc["current"])
        ),
    )


def split_sentences(text: Column) -> Column:
    trimmed = F.transform(F.split(F.regexp_replace(text, SENTENCE_END, "$1" + BREAK), BREAK), lambda s: t.strip(s))
    return F.filter(trimmed, lambda s: s != "")


def hard_cut(text: Column, limit: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), ((F.length(text) - 1) / limit).cast("int")),
        lambda n: F.substring(text, n * limit + 1, F.lit(limit)),
    )


def split_text(text: Column, limit: int) -> Column:
    """Pieces of at most *limit* characters: by lines, else sentences, else words, else cut.

    A packed group never exceeds the limit unless it is a single unit, and a single
    unit cannot be divided again at its own level, so going down one level at a time
    covers every case.
    """

    def refine(pieces: Column, finer) -> Column:
        return F.flatten(
            F.transform(
                pieces, lambda p: F.when(F.length(p) > limit, finer(p)).otherwise(F.array(p))
            )
        )

    def by_words(piece: Column) -> Column:
        return refine(pack_units(F.split(piece, " "), " ", limit), lambda p: hard_cut(p, limit))

    def by_sentences(piece: Column) -> Column:
        return refine(pack_units(split_sentences(piece), " ", limit), by_words)

    return refine(pack_units(F.split(text, "\n"), "\n", limit), by_sentences)


def fit_blocks(found: DataFrame, policy: ChunkingPolicy) -> DataFrame:
    """Adds *fragments* (null when the block cannot be divided) and *problem*."""
    limit = policy.max_chars
    long = F.length("text") > limit
    from_units = F.flatten(
        F.transform(
            pack_units(F.col("units"), "\n", limit),
            lambda p: F.when(F.length(p) > limit, split_text(p, limit)).otherwise(F.array(p)),
        )
    )
    divided = (
        F.when(~long, F.array("text"))
        .when(F.col("kind") == "code", None)
        .when(F.size("units") > 0, from_units)
        .otherwise(split_text(F.col("text"), limit))
    )
    cut_fence = F.exists("fragments", lambda p: ~t.balanced_fences(p))
    problem = F.when(long & (F.col("kind") == "code"), "unsplittable_code_block").when(
        long & cut_fence, "cut_through_fence"
    )
    return found.withColumn("fragments", divided).withColumn("problem", problem)


def pack_fragments(fragments: Column, policy: ChunkingPolicy) -> Column:
    """Greedy fold of fragments into pieces: append while under target and within max."""
    gap = 2
    empty = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("current")
    )

    def step(acc: Column, fragment: Column) -> Column:
        length = F.length(acc["current"])
        fits = acc["current"].isNotNull() & (
            (length + gap + F.length(fragment) <= policy.max_chars)
            & (length < policy.target_chars)
        )
        flushed = F.when(acc["current"].isNull(), acc["done"]).otherwise(
            F.array_append(acc["done"], acc["current"])
        )
        return F.struct(
            F.when(fits, acc["done"]).otherwise(flushed).alias("done"),
            F.when(fits, F.concat(acc["current"], F.lit("\n\n"), fragment)).otherwise(fragment).alias("current"),
        )

    return F.aggregate(
        fragments,
        empty,
        step,
        lambda acc: F.when(acc["current"].isNull(), acc["done"]).otherwise(
            F.array_append(acc["done"], acc["current"])
        ),
    )


def overlap_prefix(previous: Column, body: Column, policy: ChunkingPolicy) -> Column:
    """Trailing text of the previous piece, snapped to the widest clean boundary."""
    room = F.lit(policy.max_chars) - F.length(body) - 2
    budget = F.least(F.lit(policy.overlap_chars), room)
    cut = F.length(previous) > budget
    last = F.substring(previous, F.length(previous) - budget + 1, budget)
    before_tail = F.substring(previous, F.length(previous) - budget, F.lit(1))
    mid_word = cut & ~before_tail.rlike(rf"(?U){t.WS}")

    def usable(candidate: Column) -> Column:
        return let(candidate, lambda c: F.when((c != "") & t.balanced_fences(c), c))

    def snapped(tail: Column) -> Column:
        def after(marker: str) -> Column:
            at = F.instr(tail, marker)
            return F.when(at > 0, t.strip(F.substring(tail, at + len(marker), F.length(tail))))

        sentence = t.strip(F.regexp_extract(tail, FIRST_SENTENCE_BREAK, 1))
        word = F.when(mid_word, F.coalesce(after(" "), F.lit(""))).otherwise(t.strip(tail))
        return F.coalesce(
            usable(after("\n\n")), usable(after("\n")), usable(sentence), usable(word)
        )

    return F.when(budget > 0, let(F.when(cut, last).otherwise(previous), snapped))


def chunk_blocks(found: DataFrame, policy: ChunkingPolicy) -> DataFrame:
    """Blocks -> chunk texts with ordinals; a document with a problem yields none."""
    document = Window.partitionBy("document_id")
    section_pieces = (
        fit_blocks(found, policy)
        .groupBy("document_id", "section_no")
        .agg(
            F.first("heading_path").alias("heading_path"),
            F.max("problem").alias("problem"),
            F.flatten(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("block_no", "fragments"))),
                    lambda block: block["fragments"],
                )
            ).alias("fragments"),
        )
        .withColumn("failed", F.max("problem").over(document))
        .filter(F.col("failed").isNull())
        .withColumn(
            "section_ordinal",
            F.row_number().over(document.orderBy("section_no")) - 1,
        )
    )
    pieces = section_pieces.select(
        "document_id",
        "section_ordinal",
        "heading_path",
        F.posexplode(pack_fragments(F.col("fragments"), policy)).alias("piece_no", "body"),
    )
    in_section = Window.partitionBy("document_id", "section_ordinal").orderBy("piece_no")
    in_document = Window.partitionBy("document_id").orderBy("section_ordinal", "piece_no")
    prefix = overlap_prefix(F.col("previous"), F.col("body"), policy)
    return (
        pieces.withColumn("previous", F.lag("body").over(in_section))
        .withColumn("ordinal", F.row_number().over(in_document) - 1)
        .withColumn("prefix", prefix)
        .select(
            "document_id",
            "ordinal",
            "section_ordinal",
            "heading_path",
            F.when(F.col("prefix").isNull(), F.col("body"))
            .otherwise(F.concat("prefix", F.lit("\n\n"), "body"))
            .alias("content"),
            F.coalesce(F.length("prefix"), F.lit(0)).alias("overlap_prefix_chars"),
        )
    )


def chunk_corpus(documents: DataFrame, policy: ChunkingPolicy = ChunkingPolicy()) -> DataFrame:
    """documents(document_id, content, ...) -> chunks with ids and fingerprints.

    All other columns of *documents* ride along; they are joined back after the
    text work, on the partitioning the chunks already have.
    """
    cut = chunk_blocks(structure.blocks(structure.analyze(documents)), policy)
    chunks = cut.select(
        t.chunk_id(F.col("document_id"), F.col("ordinal")).alias("id"),
        "*",
        digests.chunk_fingerprint(
            policy, F.col("document_id"), F.col("heading_path"), F.col("content")
        ).alias("fingerprint"),
        F.lit(k.CHUNKING_STRATEGY).alias("strategy_version"),
    )
    carried = [c for c in documents.columns if c not in ("document_id", "content")]
    if not carried:
        return chunks
    return chunks.join(documents.select("document_id", *carried), "document_id")


def chunking_issues(documents: DataFrame, policy: ChunkingPolicy = ChunkingPolicy()) -> DataFrame:
    """Blocks that stop their document from being chunked."""
    found = fit_blocks(structure.blocks(structure.analyze(documents)), policy)
    return found.filter(F.col("problem").isNotNull()).select(
        "document_id", "section_no", "block_no", "problem", F.length("text").alias("chars")
    )


def require_chunkable(documents: DataFrame, policy: ChunkingPolicy = ChunkingPolicy()) -> None:
    """Strict mode: raise on the first block that cannot be divided."""
    first = chunking_issues(documents, policy).limit(1).collect()
    if first:
        row = first[0]
        raise ValueError(
            f"document {row.document_id}, section {row.section_no}, block {row.block_no}: "
            f"{row.problem} ({row.chars} characters)"
        )


def chunk_invariants(chunks: DataFrame, policy: ChunkingPolicy = ChunkingPolicy()) -> DataFrame:
    """One row of counts; a sound corpus has zeros everywhere but *chunks*."""
    per_document = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("ordinal").alias("last"),
        F.min("ordinal").alias("first"),
        F.count_if(F.length("content") > policy.max_chars).alias("over_max"),
        F.count_if(~t.has_visible(F.col("content"))).alias("empty"),
    )
    ids = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("uses"))
    repeated = ids.agg(F.count_if(F.col("uses") > 1).alias("repeated_ids"))
    totals = per_document.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.count_if((F.col("last") + 1 != F.col("n")) | (F.col("first") != 0)).alias("gaps"),
        F.coalesce(F.sum("over_max"), F.lit(0)).alias("over_max"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("empty"),
    )
    # Both sides are single aggregate rows.
    return totals.join(repeated, F.lit(True))


def chunk_statistics(chunks: DataFrame, policy: ChunkingPolicy = ChunkingPolicy()) -> DataFrame:
    """One row: documents, chunks, sections, split sections, overlap, sizes."""
    size = F.length("content")
    per_section = chunks.groupBy("document_id", "section_ordinal").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("overlap_prefix_chars") > 0).alias("with_overlap"),
        F.sum(size).alias("chars"),
        F.min(size).alias("smallest"),
        F.max(size).alias("largest"),
        F.count_if(size > policy.max_chars).alias("over_max"),
    )
    per_document = per_section.groupBy("document_id").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("sections"),
        F.count_if(F.col("n") > 1).alias("split_sections"),
        F.sum("with_overlap").alias("with_overlap"),
        F.sum("chars").alias("chars"),
        F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
        F.sum("over_max").alias("over_max"),
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    average = F.bround(F.sum("chars") / F.sum("n")).cast("long")
    return per_document.agg(
        F.count(F.lit(1)).alias("documents"),
        total("n").alias("chunks"),
        total("sections").alias("sections"),
        total("split_sections").alias("split_sections"),
        total("with_overlap").alias("chunks_with_overlap"),
        F.coalesce(average, F.lit(0)).alias("average_chars"),
        F.coalesce(F.min("smallest"), F.lit(0)).alias("smallest_chars"),
        F.coalesce(F.max("largest"), F.lit(0)).alias("largest_chars"),
        total("over_max").alias("over_max"),
    )
