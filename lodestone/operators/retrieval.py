"""Batch top-k cosine retrieval restricted to public content."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as t
from lodestone.functions import vectors
from lodestone.functions.binding import let
from lodestone.policies import RetrievalPolicy

SCORE_DIGITS = 12
#: Scores are rounded, so a bound this little below the k-th best score may still reach it.
SLACK = 1e-9
BLOCK_QUERIES = 1024
#: Records compared at once: at most, and at least where the direction changes.
BLOCK_RECORDS = 4096
LEAST_RECORDS = 1024
#: Pairs scored one by one at once.
CANDIDATES = 16_384
#: Tasks of a join with one block of queries: every part of the records has its copy of the queries.
MOST_PARTS = 64
FEW_QUERIES = 50_000


# --- filters ------------------------------------------------------------------
def public_only(index: DataFrame) -> DataFrame:
    """Only public records; there is no argument to widen it."""
    return index.filter(F.col("metadata.visibility") == "public")


def metadata_filter(index: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Exact match per metadata field, all of them; arrays match by membership.

    A field the metadata does not have matches nothing.
    """
    fields = {f.name: f.dataType.typeName() for f in index.schema["metadata"].dataType.fields}
    condition = F.lit(True)
    for name, value in wanted.items():
        if name not in fields:
            condition = F.lit(False)
        elif fields[name] == "array":
            condition = condition & F.array_contains(F.col(f"metadata.{name}"), value)
        else:
            condition = condition & (F.col(f"metadata.{name}").cast("string") == value)
    return index.filter(condition)


def threshold_filter(matches: DataFrame, min_similarity: float) -> DataFrame:
    return matches.filter(F.col("score") >= min_similarity)


# --- ranking ------------------------------------------------------------------
def top_k(matches: DataFrame, k: int) -> DataFrame:
    """The k best per query: score descending, then id.

    Spark limits the rank per task before the shuffle, so a query with very many
    matches still moves k rows per task.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cap_per_document(matches: DataFrame, window: int, per_document: int, k: int) -> DataFrame:
    """At most *per_document* hits of a document inside the first *window*, then k."""
    candidates = top_k(matches, window)
    within = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "id")
    capped = candidates.withColumn("_n", F.row_number().over(within)).filter(
        F.col("_n") <= per_document
    )
    return top_k(capped.drop("_n", "rank"), k)


# --- similarity join ----------------------------------------------------------
class Scan:
    """The k best records of every query over blocks of records, with blocks skipped exactly.

    A block has a centre and a radius, the greatest angle between the centre and a record.
    No record of it scores more than the cosine of (angle to the centre - radius), so a
    block is compared only with queries whose k-th best score so far is not above that.
    """

    def __init__(self, query_ids: Sequence, query_vectors: np.ndarray, k: int):
        self.query_ids, self.vectors, self.k = query_ids, query_vectors, k
        #: Pairs are looked through in float32. A sum is off by d * 2**-24 at most there (lengths are one); twice that and a little.
        self.rough = np.ascontiguousarray(query_vectors, dtype=np.float32)
        self.off = (query_vectors.shape[1] + 8) * 2.0**-23 + SLACK
        #: The k best of each query, best first; places not yet taken score -inf.
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.ids: np.ndarray | None = None
        #: (query, record) pairs scored, and pairs that were skipped.
        self.compared = self.skipped = 0

    @property
    def least(self) -> np.ndarray:
        """The k-th best score of each query."""
        return self.scores[:, -1]

    def bounds(self, block: np.ndarray) -> np.ndarray:
        """What no score of a query with this block exceeds."""
        centre = block.mean(axis=0)
        length = np.linalg.norm(centre)
        if length < 1e-9:
            return np.full(len(self.vectors), np.inf)
        centre /= length
        radius = np.arccos(np.clip(block @ centre, -1.0, 1.0)).max()
        angles = np.arccos(np.clip(self.vectors @ centre, -1.0, 1.0))
        most = np.cos(np.maximum(angles - radius, 0.0))
        # A vector of no length has the score 0 and no angle.
        zero = (np.abs(block).max(axis=1) == 0).any()
        return np.where(np.abs(self.vectors).max(axis=1) == 0, 0.0, np.maximum(most, 0.0) if zero else most)

    def add(self, ids: np.ndarray, block: np.ndarray) -> None:
        if not len(self.vectors) or not len(ids):
            return
        count = len(ids)
        ids, block = _few_copies(ids, np.ascontiguousarray(block), self.k)
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, dtype=ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids, ids = self.ids.astype(object), ids.astype(object)
        reached = self.bounds(block) >= self.least - SLACK
        across = np.ascontiguousarray(block.T, dtype=np.float32)
        for low in range(0, len(self.vectors), BLOCK_QUERIES):
            near = np.flatnonzero(reached[low : low + BLOCK_QUERIES]) + low
            self.skipped += (min(BLOCK_QUERIES, len(self.vectors) - low) - len(near)) * count
            self.compared += len(near) * count
            if not len(near):
                continue
            rough = self.rough[near] @ across
            hits = rough >= (self.least[near] - self.off).astype(np.float32)[:, None]
            many = np.flatnonzero(hits.sum(axis=1) > 2 * self.k)
            if len(many):
                own = np.where(hits[many], rough[many], -np.inf)
                bar = np.partition(own, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                hits[many] &= rough[many] >= (bar - np.float32(2 * self.off))[:, None]
            ends = np.cumsum(hits.sum(axis=1))
            start = 0
            while start < len(near):
                done = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, done + CANDIDATES, "right")))
                place, column = np.nonzero(hits[start:end])
                self._keep(near[start + place], ids[column], block[column])
                start = end

    def _keep(self, places: np.ndarray, ids: np.ndarray, records: np.ndarray) -> None:
        """Scores candidates, one sum a pair so that copies score the same, and keeps the k best."""
        if not len(places):
            return
        scores = np.round((self.vectors[places] * records).sum(axis=1), SCORE_DIGITS) + 0.0
        better = scores >= self.least[places]
        places, ids, scores = places[better], ids[better], scores[better]
        changed = np.unique(places)
        held = np.nonzero(self.scores[changed] > -np.inf)
        places = np.concatenate([changed[held[0]], places])
        scores = np.concatenate([self.scores[changed][held], scores])
        ids = np.concatenate([self.ids[changed][held], ids])
        order = np.lexsort((ids, -scores, places))
        places, scores, ids = places[order], scores[order], ids[order]
        rank = np.arange(len(places)) - np.searchsorted(places, places)
        kept = rank < self.k
        self.scores[places[kept], rank[kept]] = scores[kept]
        self.ids[places[kept], rank[kept]] = ids[kept]

    def result(self) -> pd.DataFrame:
        place, rank = np.nonzero(self.scores > -np.inf)
        asked = np.empty(len(self.query_ids), dtype=object)
        asked[:] = self.query_ids
        ids = self.ids[place, rank] if self.ids is not None else []
        return pd.DataFrame({"query_id": asked[place], "id": ids, "score": self.scores[place, rank]})


def _few_copies(ids: np.ndarray, block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the copies of a vector beyond the k least ids: no list of k can hold those."""
    if len(ids) <= k:
        return ids, block
    _, kind, sizes = np.unique(block.view(np.dtype((np.void, block.shape[1] * block.itemsize)))[:, 0], return_inverse=True, return_counts=True)
    if sizes.max() <= k:
        return ids, block
    order = np.lexsort((ids, kind))
    rank = np.arange(len(order)) - np.searchsorted(kind[order], kind[order])
    kept = np.sort(order[rank < k])
    return ids[kept], block[kept]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if column.null_count:
        raise ValueError("a vector is missing")
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def _batch(scan: Scan, rows: pa.Schema) -> pa.RecordBatch:
    schema = pa.schema([rows.field("query_id"), rows.field("id"), pa.field("score", pa.float64())])
    return pa.RecordBatch.from_pandas(scan.result(), schema=schema, preserve_index=False)


def _ids(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def _output_schema(queries: DataFrame, index: DataFrame) -> StructType:
    return (
        StructType()
        .add("query_id", queries.schema["query_id"].dataType)
        .add("id", index.schema["id"].dataType)
        .add("score", "double")
    )


def _direction(vector: Column) -> Column:
    """The axis, with its sign, that a vector is closest to: near vectors mostly share it."""

    def of(sizes: Column) -> Column:
        at = F.array_position(sizes, F.array_max(sizes)).cast("int")
        return at * 2 + (F.element_at(vector, at) < 0).cast("int")

    return F.when(F.size(vector) > 0, let(F.transform(vector, lambda v: F.abs(v)), of)).otherwise(0)


def similarity_join(
    queries: DataFrame, index: DataFrame, k: int, dimensions: int, query_blocks: int = 1
) -> DataFrame:
    """queries(query_id, embedding) x index(id, embedding) -> query_id, id, score, rank.

    Exact, and one plan: nothing runs while it is built. Vectors are scaled to length one.
    Queries are cut into *query_blocks* and records into parts, both by a hash of their id; a
    task has one block and one part. There are as many tasks as shuffle partitions (`MOST_PARTS`
    at most, or a part a block), so more blocks mean fewer parts: a query is copied to every
    part and has its k best in each, a record is copied to every block. Choose one block for few
    queries, about the square root of the tasks where queries are as many as records, and more
    if a block does not fit into a task. A part is sorted by direction and streamed past the
    queries in blocks (`Scan`), which are skipped for queries they cannot improve.
    """
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, min(MOST_PARTS, partitions) // query_blocks)
    schema = _output_schema(queries, index)

    def everywhere(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def spread(column: str, count: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields}
    vector = vectors.unit(F.col("embedding")).alias("embedding")
    left = queries.select(
        spread("query_id", query_blocks).alias("b"), everywhere(parts).alias("p"), F.lit(-1).alias("cell"),
        "query_id", none["id"], vector,
    )
    right = index.select(everywhere(query_blocks).alias("b"), spread("id", parts).alias("p"), "id", vector)
    right = right.select("b", "p", _direction(F.col("embedding")).alias("cell"), none["query_id"], "id", "embedding")
    placed = left.union(right).repartition(parts * query_blocks, "b", "p").sortWithinPartitions("b", "p", "cell", "id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, running = None, None, None
        asked: list[pa.RecordBatch] = []
        held: list[pa.RecordBatch] = []

        def cell_done() -> None:
            if held and running is not None:
                rows = pa.Table.from_batches(held).combine_chunks()
                running.add(_ids(_one(rows["id"])), _matrix(_one(rows["embedding"])))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                b, p, cell = keys[low].tolist()
                rows = batch.slice(low, high - low)
                if (b, p) != group:
                    cell_done()
                    if running is not None:
                        yield _batch(running, rows.schema)
                    group, running, last = (b, p), None, None
                    asked.clear()
                if cell < 0:
                    asked.append(rows)
                    continue
                if asked:
                    all_asked = pa.Table.from_batches(asked).combine_chunks()
                    running = Scan(all_asked["query_id"].to_pylist(), _matrix(_one(all_asked["embedding"])), k)
                    schema_of = rows.schema
                    asked.clear()
                if sum(r.num_rows for r in held) >= (BLOCK_RECORDS if cell == last else LEAST_RECORDS):
                    cell_done()
                last = cell
                held.append(rows)
        cell_done()
        if running is not None:
            yield _batch(running, schema_of)

    return top_k(placed.mapInArrow(scan, schema), k)


def similarity_join_few(queries: DataFrame, index: DataFrame, k: int, most: int = FEW_QUERIES) -> DataFrame:
    """The same for at most *most* queries, which the caller knows to be few.

    They are read while the plan is built and sent to every task, so the index is not shuffled.
    More of them are refused.
    """
    rows = queries.select("query_id", vectors.unit(F.col("embedding")).alias("embedding")).limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} queries: use similarity_join")
    schema = _output_schema(queries, index)
    if not rows.num_rows:
        return queries.sparkSession.createDataFrame([], schema.add("rank", "int"))
    asked = rows["query_id"].to_pylist(), _matrix(_one(rows["embedding"]))
    query_field = rows.schema.field("query_id")
    shared = queries.sparkSession.sparkContext.broadcast(asked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, held = Scan(*shared.value, k), None
        for batch in batches:
            held = batch.schema
            for low in range(0, batch.num_rows, BLOCK_RECORDS):
                rows = batch.slice(low, BLOCK_RECORDS)
                running.add(_ids(rows.column(0)), _matrix(rows.column(1)))
        if held is not None:
            yield _batch(running, pa.schema([query_field, held.field("id")]))

    records = index.select("id", vectors.unit(F.col("embedding")).alias("embedding"))
    return top_k(records.mapInArrow(scan, schema), k)


# --- retrieval ----------------------------------------------------------------
def search(queries: DataFrame, index: DataFrame, k: int, dimensions: int, query_blocks: int = 1) -> DataFrame:
    """Top-k public records per query."""
    return similarity_join(queries, public_only(index), k, dimensions, query_blocks)


def resolve_chunks(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Matches with the current chunk beside them and a *status*.

    unresolved: the corpus no longer has it; withheld: it is no longer public.
    The corpus decides, whatever the index said.
    """
    current = chunks.withColumn("_found", F.lit(True))
    joined = matches.join(current, "id", "left")
    status = (
        F.when(F.col("_found").isNull(), "unresolved")
        .when(F.col("visibility") != "public", "withheld")
        .otherwise("retrieved")
    )
    return joined.withColumn("status", status).drop("_found")


def retrieve(
    queries: DataFrame,
    index: DataFrame,
    chunks: DataFrame,
    dimensions: int,
    policy: RetrievalPolicy = RetrievalPolicy(),
    query_blocks: int = 1,
) -> DataFrame:
    """Matches per query with status: below_threshold, unresolved, withheld or retrieved.

    Retrieved rows carry *position*, their order after resolution.
    """
    matches = search(queries, index, policy.top_k, dimensions, query_blocks)
    resolved = resolve_chunks(matches, chunks).withColumn(
        "status",
        F.when(F.col("score") < policy.min_similarity, "below_threshold").otherwise(F.col("status")),
    )
    order = Window.partitionBy("query_id", "status").orderBy(F.desc("score"), "id")
    return resolved.withColumn(
        "position", F.when(F.col("status") == "retrieved", F.row_number().over(order))
    )


def retrieval_outcome(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: returned, below_threshold, unresolved, withheld, retrieved (zeros kept)."""
    def counted(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    counts = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("matches_returned"),
        *[counted(s) for s in ("below_threshold", "unresolved", "withheld", "retrieved")],
    )
    names = ("matches_returned", "below_threshold", "unresolved", "withheld", "retrieved")
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def citation_projection(retrieved: DataFrame) -> DataFrame:
    cite = t.citation(F.col("document_id"), F.col("title"), F.col("source"), F.col("heading_path"))
    return retrieved.withColumn("citation", cite)


def find_document(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(key) -> the document with that id, else the one with that source path."""
    carried = [c for c in documents.columns if c not in ("document_id", "source_path")]
    names = documents.select(
        F.explode(
            F.array(
                F.struct(F.col("document_id").alias("key"), F.lit(1).alias("priority")),
                F.struct(F.col("source_path").alias("key"), F.lit(2).alias("priority")),
            )
        ).alias("n"),
        F.struct("document_id", "source_path", *carried).alias("document"),
    ).select("n.key", "n.priority", "document")
    found = keys.select("key").distinct().join(names, "key")
    return found.groupBy("key").agg(
        F.min_by("document", F.struct("priority", "document.source_path")).alias("document")
    ).select("key", "document.*")


# --- parameter sweeps ---------------------------------------------------------
def sweep(
    hits: DataFrame,
    questions: DataFrame,
    settings: Sequence[tuple[str, float, int, int | None]],
    cutoffs: Sequence[int] = (1, 3, 5),
) -> DataFrame:
    """Re-cut one stored top-N list under many settings (name, threshold, k, per-document cap).

    hits(query_id, id, document_id, rank, score, relevant);
    questions(query_id, category) -> per setting: answerable, hit@k, mrr, rejected.
    """
    from lodestone import constants as c

    # Settings are a short list of literals, carried along as one array per hit.
    grid = F.array(
        *[
            F.struct(
                F.lit(name).alias("setting"),
                F.lit(float(threshold)).alias("threshold"),
                F.lit(k).alias("k"),
                F.lit(cap).cast("int").alias("cap"),
            )
            for name, threshold, k, cap in settings
        ]
    )
    expanded = hits.select("*", F.explode(grid).alias("s")).filter(
        F.col("score") >= F.col("s.threshold")
    )
    per_document = Window.partitionBy("query_id", "s.setting", "document_id").orderBy(
        F.desc("score"), "id"
    )
    per_query = Window.partitionBy("query_id", "s.setting").orderBy(F.desc("score"), "id")
    kept = (
        expanded.withColumn("_d", F.row_number().over(per_document))
        .filter(F.col("s.cap").isNull() | (F.col("_d") <= F.col("s.cap")))
        .withColumn("position", F.row_number().over(per_query))
        .filter(F.col("position") <= F.col("s.k"))
    )
    per_question = kept.groupBy("query_id", F.col("s.setting").alias("setting")).agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.min(F.when(F.col("relevant"), F.col("position"))).alias("rank"),
    )
    names = F.array(*[F.lit(s[0]) for s in settings])
    asked = questions.select("query_id", "category", F.explode(names).alias("setting"))
    scored = asked.join(per_question, ["query_id", "setting"], "left")
    answerable = F.col("category").isin(list(c.ANSWERABLE_CATEGORIES))
    refuse = F.col("category").isin(list(c.MUST_REFUSE_CATEGORIES))
    hit = [
        F.count_if(answerable & (F.col("rank") <= n)).alias(f"hit_at_{n}") for n in cutoffs
    ]
    return scored.groupBy("setting").agg(
        F.count_if(answerable).alias("answerable"),
        *hit,
        F.coalesce(
            F.avg(F.when(answerable, F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))), F.lit(0.0)
        ).alias("mrr"),
        F.count_if(refuse).alias("must_refuse"),
        F.count_if(refuse & F.col("retrieved").isNull()).alias("rejected"),
    )


def _covered(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits joined to the expected sources they satisfy: same document, section in the path."""
    found = hits.select("query_id", F.col("document_id").alias("document"), "rank", "heading_path")
    inside = F.col("section").isNull() | F.array_contains("heading_path", F.col("section"))
    return expected.join(found, ["query_id", "document"]).filter(inside)


def source_coverage(hits: DataFrame, expected: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Share of expected sources found inside each window size.

    hits(query_id, rank, document_id, heading_path); expected(query_id, document, section).
    """
    sizes = F.array(*[F.lit(w) for w in windows])
    wanted = expected.select("query_id", "document", "section").distinct()
    matched = _covered(wanted, hits)
    first = matched.groupBy("query_id", "document", "section").agg(F.min("rank").alias("rank"))
    per_source = wanted.alias("w").join(
        first.alias("f"),
        (F.col("w.query_id") == F.col("f.query_id"))
        & (F.col("w.document") == F.col("f.document"))
        & F.col("w.section").eqNullSafe(F.col("f.section")),
        "left",
    ).select("w.query_id", "w.document", "w.section", "f.rank")
    return (
        per_source.select("*", F.explode(sizes).alias("window"))
        .groupBy("window")
        .agg(
            F.count(F.lit(1)).alias("expected"),
            F.count_if(F.col("rank") <= F.col("window")).alias("covered"),
        )
        .withColumn("coverage", F.col("covered") / F.col("expected"))
    )


def sources_lost(hits: DataFrame, expected: DataFrame, baseline: int, window: int) -> DataFrame:
    """Expected sources inside the baseline window that the other window no longer has."""
    def covered(size: int) -> DataFrame:
        inside = hits.filter(F.col("rank") <= size)
        return _covered(expected, inside).select("query_id", "document", "section").distinct()

    before, after = covered(baseline).alias("b"), covered(window).alias("a")
    same = (
        (F.col("b.query_id") == F.col("a.query_id"))
        & (F.col("b.document") == F.col("a.document"))
        & F.col("b.section").eqNullSafe(F.col("a.section"))
    )
    return before.join(after, same, "left_anti").select("query_id", "document", "section")
