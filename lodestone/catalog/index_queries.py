"""Index diff and sync queries: two snapshots of the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import derived as d
from lodestone.catalog.text_queries import SPEC
from lodestone.functions import digests
from lodestone.operators import embeddings, identity, indexing, retrieval
from lodestone.policies import EmbeddingSpec
from lodestone.sources import index_table

QUERIES, ORACLE = {}, {}
PAIR = EmbeddingSpec("tables", "sizes", 2)


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _records(rows, text):
    """Index rows from documents; *text* decides the embedding fingerprint."""
    metadata = F.struct(
        F.col("document_id").alias("chunk_id"), "document_id", "title", "source_path",
        F.array().cast("array<string>").alias("heading_path"), "document_type", "language",
        "visibility", "trust_level", "topics", "technologies",
    )
    return rows.select(
        F.col("document_id").alias("id"),
        identity.space_literal(PAIR).alias("spec"),
        digests.sha256(text).alias("embedding_fingerprint"),
        digests.sha256(F.concat(F.lit("c"), text)).alias("chunk_fingerprint"),
        digests.sha256(F.concat("source", text)).alias("document_fingerprint"),
        metadata.alias("metadata"),
        text.alias("embedding_text"),
    )


def desired(spark, folder):
    docs = d.documents(spark, folder)
    return _records(docs, F.col("content")).drop("spec")


def actual(spark, folder):
    """An older state: some missing, some with other texts or sources, some left over."""
    docs = d.documents(spark, folder)
    held = docs.filter(F.col("doc_id") % 7 != 0)
    extra = docs.filter(F.col("doc_id") % 50 == 0).withColumn(
        "document_id", F.concat(F.lit("doc-"), (F.col("doc_id") + 1000000).cast("string"))
    )
    old = held.unionByName(extra)
    text = F.when(F.col("doc_id") % 5 == 1, F.concat("content", F.lit(" old"))).otherwise(F.col("content"))
    source = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("old-"), "source")).otherwise(F.col("source"))
    rows = _records(old.withColumn("source", source), text)
    return rows.withColumn(
        "embedding",
        F.array(F.length("embedding_text").cast("double"), F.length("id").cast("double")),
    ).drop("embedding_text")


def new_vectors(plan):
    """The vectors a provider would return for the texts of the plan."""
    need = indexing.embeddings_required(plan)
    vector = F.array(F.length("embedding_text").cast("double"), F.lit(0.0))
    return need.select("embedding_fingerprint", vector.alias("embedding"))


SQL_STATES = """desired AS (
  SELECT doc_id, document_id AS id, sha256(content) AS efp, sha256('c' || content) AS cfp,
    sha256(source || content) AS dfp, content AS text FROM docs),
actual AS (
  SELECT id, doc_id, sha256(t) AS efp, sha256('c' || t) AS cfp, sha256(s || t) AS dfp,
    [length(t)::DOUBLE, length(id)::DOUBLE] AS vec FROM (
    SELECT id, doc_id, CASE WHEN doc_id % 5 = 1 THEN content || ' old' ELSE content END AS t,
      CASE WHEN doc_id % 3 = 2 THEN 'old-' || source ELSE source END AS s FROM (
      SELECT document_id AS id, doc_id, content, source FROM docs WHERE doc_id % 7 <> 0
      UNION ALL SELECT 'doc-' || (doc_id + 1000000), doc_id, content, source FROM docs WHERE doc_id % 50 = 0))),
plan AS (
  SELECT coalesce(d.id, a.id) AS id, d.efp, d.text, a.vec,
    CASE WHEN d.id IS NULL THEN 'delete' WHEN a.id IS NULL THEN 'create' WHEN d.efp <> a.efp THEN 'reembed'
      WHEN d.cfp <> a.cfp OR d.dfp <> a.dfp THEN 'metadata_update' ELSE 'unchanged' END AS action
  FROM desired d FULL OUTER JOIN actual a ON d.id = a.id)"""


def sql(body: str, extra: str = "") -> str:
    return d.with_sql("docs", body, SQL_STATES + (",\n" + extra if extra else ""))


def _plan(spark, folder, **options):
    return indexing.plan_index(desired(spark, folder), actual(spark, folder), **options)


@query("plan_index", sql("SELECT id, action FROM plan"))
def plan_index(spark, folder):
    return _plan(spark, folder).select("id", "action")


@query(
    "plan_index_rebuild",
    sql("SELECT id, CASE WHEN action = 'delete' THEN action ELSE 'create' END AS action FROM plan"),
)
def plan_index_rebuild(spark, folder):
    return _plan(spark, folder, rebuild=True).select("id", "action")


@query("plan_counts", sql("SELECT action, count(*) AS records FROM plan GROUP BY action"))
def plan_counts(spark, folder):
    return indexing.plan_counts(_plan(spark, folder))


@query(
    "metadata_differs",
    sql("SELECT d.id, d.cfp <> a.cfp OR d.dfp <> a.dfp AS differs FROM desired d JOIN actual a ON d.id = a.id"),
)
def metadata_differs(spark, folder):
    pair = desired(spark, folder).alias("d").join(actual(spark, folder).alias("a"), F.col("d.id") == F.col("a.id"))
    return pair.select("d.id", indexing.metadata_differs("a", "d").alias("differs"))


@query("stale_ids", sql("SELECT id FROM plan WHERE action = 'delete'"))
def stale_ids(spark, folder):
    return indexing.stale_ids(desired(spark, folder), actual(spark, folder))


@query(
    "desired_state",
    d.with_sql(
        "docs",
        """SELECT document_id AS id, title, visibility, sha256(to_json({'spec': {'dimensions': 64, 'model': 'given', 'provider': 'tables',
          'representation_version': 'embedding-text-v1'},
          'text': title || chr(10) || chr(10) || source || chr(10) || chr(10) || content})::VARCHAR) AS embedding_fingerprint FROM docs""",
    ),
)
def desired_state(spark, folder):
    """One chunk per document."""
    chunks = d.documents(spark, folder).select(
        "*", F.col("document_id").alias("id"), F.array("source").alias("heading_path"),
        digests.sha256(F.col("content")).alias("fingerprint"),
        digests.sha256(F.col("source")).alias("document_fingerprint"),
    )
    return indexing.desired_state(chunks, SPEC).select(
        "id", "metadata.title", "metadata.visibility", "embedding_fingerprint"
    )


@query(
    "dedup_by_fingerprint",
    sql("SELECT efp AS embedding_fingerprint, arg_min(id, id) AS id FROM desired GROUP BY efp"),
)
def dedup_by_fingerprint(spark, folder):
    """G3 over all documents; copies share a fingerprint."""
    return indexing.dedup_by_fingerprint(desired(spark, folder)).select("embedding_fingerprint", "id")


@query(
    "embeddings_required",
    sql("SELECT DISTINCT efp AS embedding_fingerprint, length(text) AS chars FROM plan WHERE action IN ('create', 'reembed')"),
)
def embeddings_required(spark, folder):
    need = indexing.embeddings_required(_plan(spark, folder))
    return need.select("embedding_fingerprint", F.length("embedding_text").alias("chars"))


@query(
    "assign_vectors",
    sql("SELECT id, action, length(text)::DOUBLE AS first FROM plan WHERE action IN ('create', 'reembed')"),
)
def assign_vectors(spark, folder):
    plan = _plan(spark, folder)
    assigned = indexing.assign_vectors(plan, new_vectors(plan))
    return assigned.select("id", "action", F.element_at("embedding", 1).alias("first"))


@query(
    "reuse_vectors",
    sql("SELECT id, vec[1] AS first, vec[2] AS second FROM plan WHERE action = 'metadata_update'"),
)
def reuse_vectors(spark, folder):
    reused = indexing.reuse_vectors(_plan(spark, folder), actual(spark, folder))
    return reused.select("id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", 2).alias("second"))


@query(
    "sync_index",
    sql(
        "SELECT id, efp AS embedding_fingerprint, CASE WHEN action IN ('create', 'reembed') THEN length(text)::DOUBLE ELSE vec[1] END AS first, "
        "CASE WHEN action IN ('create', 'reembed') THEN 0.0 ELSE vec[2] END AS second FROM plan WHERE action <> 'delete'"
    ),
)
def sync_index(spark, folder):
    """The index after plan, embed, upsert and delete."""
    index = actual(spark, folder)
    plan = indexing.plan_index(desired(spark, folder), index)
    after = indexing.synchronized(plan, index, new_vectors(plan), PAIR)
    return after.select(
        "id", "embedding_fingerprint",
        F.element_at("embedding", 1).alias("first"), F.element_at("embedding", 2).alias("second"),
    )


@query(
    "upsert",
    sql("SELECT id, efp AS embedding_fingerprint FROM actual WHERE id NOT IN (SELECT id FROM desired) UNION ALL SELECT id, efp FROM desired"),
)
def upsert(spark, folder):
    index = actual(spark, folder).select("id", "embedding_fingerprint")
    return indexing.upsert(index, desired(spark, folder))


@query("delete", sql("SELECT id FROM actual WHERE id NOT IN (SELECT id FROM plan WHERE action = 'delete')"))
def delete(spark, folder):
    index = actual(spark, folder)
    return indexing.delete(index, indexing.stale_ids(desired(spark, folder), index)).select("id")


@query("fetch", sql("SELECT d.doc_id AS position, a.id, a.vec[1] AS first FROM desired d JOIN actual a ON a.id = d.id"))
def fetch(spark, folder):
    """All desired ids, in their own order."""
    ids = d.documents(spark, folder).select(F.col("document_id").alias("id"), F.col("doc_id").alias("position"))
    found = indexing.fetch(actual(spark, folder), ids).orderBy("position")
    return found.select("position", "id", F.element_at("embedding", 1).alias("first"))


@query("fetch_states", sql("SELECT a.id, a.efp AS embedding_fingerprint FROM desired d JOIN actual a ON a.id = d.id"))
def fetch_states(spark, folder):
    ids = desired(spark, folder).select("id")
    return indexing.fetch_states(actual(spark, folder), ids).select("id", "embedding_fingerprint")


@query("list_state", sql("SELECT id, efp AS embedding_fingerprint, dfp AS document_fingerprint FROM actual ORDER BY id"))
def list_state(spark, folder):
    return indexing.list_state(actual(spark, folder)).select("id", "embedding_fingerprint", "document_fingerprint")


@query(
    "valid_vectors",
    "SELECT vec_id AS id, CASE label WHEN 0 THEN 'wrong_dimensions' WHEN 1 THEN 'non_finite_value' "
    "WHEN 2 THEN 'other_space' WHEN 3 THEN 'missing_vector' END AS problem FROM embeddings WHERE label < 4",
)
def valid_vectors(spark, folder):
    """Each of four labels gets one kind of defect."""
    label = F.col("label")
    vector = (
        F.when(label == 0, F.slice("embedding", 1, 63))
        .when(label == 1, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .when(label != 3, F.col("embedding"))
    )
    space = F.struct(
        F.lit("tables").alias("provider"),
        F.when(label == 2, "older").otherwise("given").alias("model"),
        F.lit(64).alias("dimensions"),
        F.lit("embedding-text-v1").alias("representation_version"),
    )
    records = d.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), space.alias("spec"), vector.alias("embedding")
    )
    return indexing.vector_problems(records, SPEC)


@query(
    "index_payload",
    d.with_sql(
        "docs",
        "SELECT document_id AS id, title AS meta_document_title, '' AS meta_heading_path, visibility AS meta_visibility, "
        "array_to_string(topics, ',') AS topics, 'tables:sizes:2:embedding-text-v1' AS meta_embedding_space FROM docs WHERE doc_id % 7 <> 0 "
        "UNION ALL SELECT 'doc-' || (doc_id + 1000000), title, '', visibility, array_to_string(topics, ','), "
        "'tables:sizes:2:embedding-text-v1' FROM docs WHERE doc_id % 50 = 0",
    ),
)
def index_payload(spark, folder):
    """A10: flat form and back."""
    flat = index_table.index_payload(actual(spark, folder))
    again = index_table.index_payload(index_table.index_from_payload(flat, PAIR))
    unchanged = actual(spark, folder).filter(F.lit(True)).select("id")
    return again.join(unchanged, "id", "left_semi").select(
        "id", "meta_document_title", "meta_heading_path", "meta_visibility",
        F.regexp_replace(F.array_join("meta_topics", ","), "old-", "").alias("topics"), "meta_embedding_space",
    )


@query(
    "find_document",
    d.with_sql(
        "docs",
        """SELECT k.key, arg_min(o.document_id, p) AS document_id FROM
          (SELECT CASE WHEN doc_id % 2 = 0 THEN document_id ELSE source_path END AS key FROM docs) k
          JOIN (SELECT document_id AS name, 1 AS p, document_id FROM docs UNION ALL SELECT source_path, 2, document_id FROM docs) o
          ON o.name = k.key GROUP BY k.key""",
    ),
)
def find_document(spark, folder):
    docs = d.documents(spark, folder).select("doc_id", "document_id", "source_path")
    key = F.when(F.col("doc_id") % 2 == 0, F.col("document_id")).otherwise(F.col("source_path"))
    return retrieval.find_document(docs, docs.select(key.alias("key"))).select("key", "document_id")


# --- vectors from texts -----------------------------------------------------------------
@query(
    "hash_embedding",
    """SELECT doc_id, n, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value FROM (
      SELECT doc_id, 8 * r + n AS n, ('0x' || substr(h, 1 + 8 * n, 8))::BIGINT / 2147483648.0::DOUBLE - 1.0::DOUBLE AS v FROM (
        SELECT doc_id, r, sha256(text || chr(0) || r) AS h, unnest(generate_series(0, 7)) AS n
        FROM documents, (SELECT unnest(generate_series(0, 31)) AS r)))""",
)
def hash_embedding(spark, folder):
    """U2 with its 256 dimensions, one row per value."""
    docs = d.table(spark, folder, "documents")
    vector = embeddings.hash_embedding()(F.col("text"))
    return docs.select("doc_id", vector.alias("v")).select("doc_id", F.posexplode("v").alias("n", "value"))


from lodestone import constants as k  # noqa: E402

SQL_LEXICAL = """words_{name} AS (
  SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {table}),
counts_{name} AS (
  SELECT key, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS b, sum(n)::DOUBLE AS c
  FROM (SELECT key, w, count(*) AS n FROM words_{name} WHERE length(w) >= 3 AND w NOT IN ({stop}) GROUP BY ALL) GROUP BY ALL),
lexical_{name} AS (
  SELECT key, b, c / sqrt(sum(c * c) OVER (PARTITION BY key)) AS value FROM (
    SELECT key, b, c FROM counts_{name} UNION ALL
    SELECT DISTINCT {key}, 0, 1.0 FROM {table} WHERE {key} NOT IN (SELECT key FROM counts_{name})))"""


def sql_lexical(name: str, table: str, key: str, text: str) -> str:
    return SQL_LEXICAL.format(name=name, table=table, key=key, text=text, stop=d.sql_list(k.LEXICAL_STOPWORDS))


@query(
    "lexical_embedding",
    "WITH " + sql_lexical("d", "documents", "doc_id", "text") + " SELECT key AS doc_id, b AS bucket, value FROM lexical_d",
)
def lexical_embedding(spark, folder):
    """U3, one row per non-zero value."""
    docs = d.table(spark, folder, "documents")
    made = docs.select("doc_id", embeddings.lexical_vector(F.col("text")).alias("v"))
    pairs = made.select("doc_id", F.explode(F.arrays_zip("v.buckets", "v.values")).alias("p"))
    return pairs.select("doc_id", F.col("p.buckets").alias("bucket"), F.col("p.values").alias("value"))


@query(
    "embed",
    "SELECT doc_id, length(text)::DOUBLE AS first, length(lang)::DOUBLE AS second FROM "
    "(SELECT doc_id, text, '12' AS lang FROM documents)",
)
def embed(spark, folder):
    """U1 with a callable that returns text sizes."""
    docs = d.table(spark, folder, "documents")
    made = embeddings.embed(docs, "doc_id", "text", lambda texts: [(len(x), 2) for x in texts])
    return made.select("doc_id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", 2).alias("second"))
