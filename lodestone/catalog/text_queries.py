"""Text, fingerprint and identity queries over documents, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.catalog import derived as d
from lodestone.functions import digests
from lodestone.functions import text as t
from lodestone.operators import identity
from lodestone.plans import answering
from lodestone.policies import ChunkingPolicy, EmbeddingSpec
from lodestone.sources import corpus

SPEC = EmbeddingSpec("tables", "given", 64)
QUERIES, ORACLE = {}, {}

SQL_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


@query(
    "normalize_text",
    "SELECT doc_id, sha256(t) AS sha, length(t) AS chars FROM (SELECT doc_id, "
    "nfc_normalize(regexp_replace(text || 'e' || chr(769), '\\r\\n?', chr(10), 'g')) AS t FROM documents)",
)
def normalize_text(spark, folder):
    """B1 on the texts with a byte-order mark, Windows line ends and a combining accent."""
    dirty = F.concat(
        F.lit("﻿"), F.regexp_replace("text", "\n", "\r\n"), F.lit("é")
    )
    clean = d.table(spark, folder, "documents").select("doc_id", t.normalize_text(dirty).alias("t"))
    return clean.select("doc_id", digests.sha256(F.col("t")).alias("sha"), F.length("t").alias("chars"))


@query(
    "normalize_body",
    "SELECT doc_id, sha256(t) AS sha, length(t) AS chars FROM (SELECT doc_id, "
    f"regexp_replace(ltrim(text, chr(10)), '{SQL_WS}+$', '') AS t FROM documents)",
)
def normalize_body(spark, folder):
    padded = F.concat(F.lit("\n\n"), "text", F.lit(" \t \n"))
    clean = d.table(spark, folder, "documents").select("doc_id", t.normalize_body(padded).alias("t"))
    return clean.select("doc_id", digests.sha256(F.col("t")).alias("sha"), F.length("t").alias("chars"))


@query(
    "split_frontmatter",
    "SELECT doc_id, doc_id % 3 <> 0 AS opened, doc_id % 3 = 1 AS closed, "
    "CASE WHEN doc_id % 3 = 1 THEN 'id: doc-' || doc_id || chr(10) || 'lang: ' || lang END AS block, "
    "CASE WHEN doc_id % 3 = 1 THEN sha256(text) END AS body_sha FROM documents",
)
def split_frontmatter(spark, folder):
    """Every third text has front matter, every third opens one and never closes it."""
    block = F.concat(F.lit("id: doc-"), F.col("doc_id").cast("string"), F.lit("\nlang: "), "lang")
    text = (
        F.when(F.col("doc_id") % 3 == 0, F.col("text"))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("--- \n"), block, F.lit("\n---\n"), "text"))
        .otherwise(F.concat(F.lit("---\n"), block, F.lit("\n"), "text"))
    )
    split = d.table(spark, folder, "documents").select("doc_id", corpus.split_frontmatter(text).alias("f"))
    return split.select(
        "doc_id", "f.opened", F.coalesce("f.closed", F.lit(False)).alias("closed"), "f.block",
        digests.sha256(F.col("f.body")).alias("body_sha"),
    )


@query(
    "normalize_queries",
    f"""SELECT conv_id, turn, sha256(q) AS question_sha, n AS original_length,
      CASE WHEN n > {k.MAX_QUERY_LENGTH} THEN 'too_long'
           WHEN NOT regexp_matches(q, '[^\\p{{Cc}}\\p{{Cf}}\\p{{Z}}]') THEN 'empty' END AS error
    FROM (SELECT conv_id, turn, length(raw) AS n,
            regexp_replace(regexp_replace(nfc_normalize(raw), '{SQL_WS}+', ' ', 'g'), '^ | $', '', 'g') AS q
          FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN chr(8203) || ' '
                  WHEN role = 'assistant' THEN text || chr(9) || text || chr(10) || text
                  ELSE '  ' || replace(text, ' ', chr(160) || chr(10)) || ' ' END AS raw
                FROM conversations))""",
)
def normalize_queries(spark, folder):
    """J1 on all turns, with wide white space, invisible-only texts and some beyond the limit."""
    raw = (
        F.when(F.col("role") == "system", "​ ")
        .when(F.col("role") == "assistant", F.concat("text", F.lit("\t"), "text", F.lit("\n"), "text"))
        .otherwise(F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \n")), F.lit(" ")))
    )
    turns = d.table(spark, folder, "conversations").withColumn("text", raw)
    done = answering.normalize_questions(turns)
    return done.select(
        "conv_id", "turn", digests.sha256(F.col("question")).alias("question_sha"),
        "original_length", "error",
    )


LANGUAGE_SQL = f"""language_of AS (
  SELECT doc_id, CASE WHEN g > e THEN 'de' ELSE 'en' END AS language FROM (
    SELECT doc_id,
      len(list_filter(w, lambda x: x IN ({d.sql_list(k.GERMAN_MARKERS)})))
        + 2 * len(list_filter(w, lambda x: regexp_matches(x, '[{k.GERMAN_LETTERS}]'))) AS g,
      len(list_filter(w, lambda x: x IN ({d.sql_list(k.ENGLISH_MARKERS)}))) AS e
    FROM (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents)))"""


@query("detect_language", f"WITH {LANGUAGE_SQL} SELECT * FROM language_of")
def detect_language(spark, folder):
    docs = d.table(spark, folder, "documents")
    return docs.select("doc_id", t.detect_language(F.col("text")).alias("language"))


@query(
    "refusal_text",
    f"WITH {LANGUAGE_SQL} SELECT language, count(*) AS documents, "
    f"CASE WHEN language = 'de' THEN '{k.REFUSALS['de']}' ELSE '{k.REFUSALS['en'].replace(chr(39), chr(39) * 2)}' END AS refusal "
    "FROM language_of GROUP BY language",
)
def refusal_text(spark, folder):
    found = detect_language(spark, folder).groupBy("language").agg(F.count(F.lit(1)).alias("documents"))
    return found.withColumn("refusal", t.refusal_text(F.col("language")))


@query("estimate_tokens", "SELECT doc_id, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, folder):
    docs = d.table(spark, folder, "documents")
    return docs.select("doc_id", t.estimate_tokens(F.col("text")).alias("tokens"))


def _with_path(docs):
    """A heading path on every second document."""
    path = F.when(F.col("doc_id") % 2 == 0, F.array("source", "language"))
    return docs.withColumn("heading_path", F.coalesce(path, F.array().cast("array<string>")))


PATH_SQL = "pathed AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN [source, language] ELSE CAST([] AS VARCHAR[]) END AS heading_path FROM docs)"


@query(
    "embedding_text",
    d.with_sql(
        "docs",
        "SELECT document_id, sha256(concat_ws(chr(10) || chr(10), title, "
        "nullif(array_to_string(heading_path, ' > '), ''), content)) AS sha FROM pathed",
        PATH_SQL,
    ),
)
def embedding_text(spark, folder):
    docs = _with_path(d.documents(spark, folder))
    text = t.embedding_text(F.col("title"), F.col("heading_path"), F.col("content"))
    return docs.select("document_id", digests.sha256(text).alias("sha"))


@query(
    "citation_projection",
    d.with_sql("docs", "SELECT document_id, title, source, heading_path[-1] AS section FROM pathed", PATH_SQL),
)
def citation_projection(spark, folder):
    docs = _with_path(d.documents(spark, folder))
    cited = t.citation(F.col("document_id"), F.col("title"), F.col("source"), F.col("heading_path"))
    return docs.select(cited.alias("c")).select("c.*")


@query(
    "document_fingerprint",
    d.with_sql(
        "docs",
        """SELECT document_id, sha256(to_json({'document_type': document_type, 'id': document_id,
          'language': language, 'license': NULL::VARCHAR, 'schema_version': 1, 'source': source,
          'source_type': 'authored', 'technologies': CAST([] AS VARCHAR[]), 'title': title,
          'topics': topics, 'trust_level': trust_level, 'updated_at': DATE '2026-01-15',
          'version': 1, 'visibility': visibility})::VARCHAR || chr(0) || content) AS fingerprint FROM docs""",
    ),
)
def document_fingerprint(spark, folder):
    docs = d.documents(spark, folder).select("*", F.col("document_id").alias("id"))
    docs = (
        docs.withColumn("license", F.lit(None).cast("string"))
        .withColumn("schema_version", F.lit(1))
        .withColumn("source_type", F.lit("authored"))
        .withColumn("updated_at", F.lit("2026-01-15").cast("date"))
        .withColumn("version", F.lit(1))
    )
    metadata = F.struct(*digests.METADATA_FIELDS)
    return docs.select(
        "document_id", digests.document_fingerprint(metadata, F.col("content")).alias("fingerprint")
    )


@query(
    "chunk_fingerprint",
    d.with_sql(
        "docs",
        """SELECT document_id, sha256(to_json({'content': content, 'document_id': document_id,
          'heading_path': heading_path,
          'policy': {'max_chars': 1800, 'overlap_chars': 150, 'target_chars': 1200},
          'strategy_version': 'markdown-structure-v1'})::VARCHAR) AS fingerprint FROM pathed""",
        PATH_SQL,
    ),
)
def chunk_fingerprint(spark, folder):
    docs = _with_path(d.documents(spark, folder))
    mark = digests.chunk_fingerprint(
        ChunkingPolicy(), F.col("document_id"), F.col("heading_path"), F.col("content")
    )
    return docs.select("document_id", mark.alias("fingerprint"))


@query(
    "embedding_fingerprint",
    """SELECT doc_id, sha256(to_json({'spec': {'dimensions': 64, 'model': 'given', 'provider': 'tables',
      'representation_version': 'embedding-text-v1'}, 'text': text})::VARCHAR) AS fingerprint FROM documents""",
)
def embedding_fingerprint(spark, folder):
    docs = d.table(spark, folder, "documents")
    return docs.select("doc_id", digests.embedding_fingerprint(F.col("text"), SPEC).alias("fingerprint"))


def sql_set_digest(line: str) -> str:
    sums = [f"coalesce(sum(('0x' || substr(h, {1 + 8 * n}, 8))::BIGINT), 0)::VARCHAR" for n in range(8)]
    return "sha256(concat_ws(':', " + ", ".join(sums) + "))"


@query(
    "corpus_identity",
    "SELECT count(*) AS documents, sum(n)::BIGINT AS chunks, "
    + sql_set_digest("h")
    + " AS sha256 FROM (SELECT count(*) AS n, sha256(source || ':' || max(sha256(text))) AS h FROM documents GROUP BY source)",
)
def corpus_identity(spark, folder):
    """D4 with sources as documents and their texts as chunks."""
    docs = d.table(spark, folder, "documents").select(
        F.col("source").alias("document_id"), digests.sha256(F.col("text")).alias("document_fingerprint")
    )
    return identity.corpus_identity(docs)


@query(
    "files_identity",
    d.with_sql(
        "docs",
        "SELECT count(*) AS files, " + sql_set_digest("h") + " AS sha256 FROM "
        "(SELECT sha256(source_path || chr(0) || sha256(content)) AS h FROM docs)",
    ),
)
def files_identity(spark, folder):
    docs = d.documents(spark, folder)
    return identity.files_identity(docs.select("source_path", F.col("content").cast("binary").alias("content")))


@query(
    "file_digests",
    d.with_sql("docs", "SELECT source_path, sha256(content) AS sha256 FROM docs"),
)
def file_digests(spark, folder):
    docs = d.documents(spark, folder)
    return identity.file_digests(docs.select("source_path", F.col("content").cast("binary").alias("content")))


@query(
    "space_check",
    "SELECT 'tables:older:64:embedding-text-v1' AS space, count(*) AS records FROM embeddings WHERE label = 9 HAVING count(*) > 0",
)
def space_check(spark, folder):
    """Records of one label were made by an older model."""
    index = d.table(spark, folder, "embeddings").select(
        F.struct(
            F.lit("tables").alias("provider"),
            F.when(F.col("label") == 9, "older").otherwise("given").alias("model"),
            F.lit(64).alias("dimensions"),
            F.lit("embedding-text-v1").alias("representation_version"),
        ).alias("spec")
    )
    return identity.foreign_spaces(index, SPEC)


# --- corpus files -------------------------------------------------------------------
ODD_FILE = (
    "fine", "no_block", "never_closed", "broken_yaml", "twice", "version_two", "bad_id", "empty",
    "shared_id", "not_utf8", "extra_field", "draft", "readme", "no_version", "text_version",
    "bad_date", "two_bad", "fine", "defaults", "fine",
)


def corpus_files(spark, folder):
    """Every document as a Markdown file; most kinds of defects occur."""
    docs = d.table(spark, folder, "documents")
    kind = d.pick(F.col("doc_id"), ODD_FILE)
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))

    def when(case, value, other):
        return F.when(F.col("kind") == case, value).otherwise(other)

    identifier = when("shared_id", F.lit("shared-doc"), when("bad_id", F.concat(F.lit("Bad_"), name), name))
    version = (
        F.when(F.col("kind") == "version_two", "schema_version: 2\n")
        .when(F.col("kind") == "no_version", "")
        .when(F.col("kind") == "text_version", "schema_version: one\n")
        .otherwise("schema_version: 1\n")
    )
    block = F.concat(
        version, F.lit("id: "), identifier, F.lit("\ntitle: Document "), F.col("doc_id").cast("string"),
        F.lit("\ndocument_type: "), when("two_bad", F.lit("poem"), d.pick(F.col("doc_id"), k.DOCUMENT_TYPES)),
        F.lit("\nlanguage: "), when("two_bad", F.lit("english"), F.col("lang")),
        F.lit("\ntopics: ["), "source", F.lit(", text]\nsource: "), "source",
        F.lit("\nsource_type: authored\nversion: 3\nupdated_at: "),
        when("bad_date", F.lit("someday"), F.lit("2026-01-15")),
        when("defaults", F.lit(""), F.lit("\nvisibility: public\ntrust_level: verified")),
        when("twice", F.lit("\nversion: 4"), F.lit("")),
        when("extra_field", F.lit("\nmood: good"), F.lit("")),
        when("broken_yaml", F.lit("\nlicense: [open"), F.lit("")),
        F.lit("\n"),
    )
    body = when("empty", F.lit("\n \n"), F.col("text"))
    text = (
        F.when(F.col("kind") == "no_block", F.col("text"))
        .when(F.col("kind") == "never_closed", F.concat(F.lit("---\n"), block, body))
        .otherwise(F.concat(F.lit("---\n"), block, F.lit("---\n\n"), body, F.lit("\n")))
    )
    raw = text.cast("binary")
    folder_name = when("draft", F.concat(F.lit("_drafts/"), "source"), F.col("source"))
    file_name = when("readme", F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit("/README.md")), F.concat(name, F.lit(".md")))
    return docs.withColumn("kind", kind).select(
        F.concat(folder_name, F.lit("/"), file_name).alias("source_path"),
        when("not_utf8", F.concat(raw, F.lit(b"\xc3\x28")), raw).alias("content"),
    )


SQL_FILES = f"""files AS (
  SELECT doc_id, text, source, lang, {d.sql_pick('doc_id', ODD_FILE)} AS kind,
    source || '/doc-' || doc_id || '.md' AS source_path FROM documents),
judged AS (
  SELECT *, CASE kind WHEN 'no_block' THEN 'MISSING_FRONTMATTER'
      WHEN 'never_closed' THEN 'INVALID_FRONTMATTER' WHEN 'broken_yaml' THEN 'INVALID_FRONTMATTER'
      WHEN 'twice' THEN 'INVALID_FRONTMATTER' WHEN 'version_two' THEN 'UNSUPPORTED_SCHEMA_VERSION'
      WHEN 'bad_id' THEN 'INVALID_METADATA' WHEN 'empty' THEN 'EMPTY_DOCUMENT'
      WHEN 'not_utf8' THEN 'INVALID_ENCODING' WHEN 'extra_field' THEN 'INVALID_METADATA'
      WHEN 'no_version' THEN 'INVALID_METADATA' WHEN 'text_version' THEN 'INVALID_METADATA'
      WHEN 'bad_date' THEN 'INVALID_METADATA' WHEN 'two_bad' THEN 'INVALID_METADATA'
      WHEN 'shared_id' THEN CASE WHEN source_path > min(CASE WHEN kind = 'shared_id' THEN source_path END) OVER ()
        THEN 'DUPLICATE_DOCUMENT_ID' END END AS code,
    min(CASE WHEN kind = 'shared_id' THEN source_path END) OVER () AS shared_owner
  FROM files WHERE kind NOT IN ('draft', 'readme'))"""


@query(
    "corpus_documents",
    f"""WITH {SQL_FILES} SELECT CASE WHEN kind = 'shared_id' THEN 'shared-doc' ELSE 'doc-' || doc_id END AS document_id,
      source_path, 'Document ' || doc_id AS title, CASE WHEN kind = 'defaults' THEN 'internal' ELSE 'public' END AS visibility,
      CASE WHEN kind = 'defaults' THEN 'unverified' ELSE 'verified' END AS trust_level,
      sha256(regexp_replace(ltrim(text, chr(10)), '{SQL_WS}+$', '')) AS content_sha
    FROM judged WHERE code IS NULL""",
)
def corpus_documents(spark, folder):
    """Files to documents."""
    read = corpus.read_documents(corpus_files(spark, folder))
    return corpus.documents(read).select(
        "document_id", "source_path", "title", "visibility", "trust_level",
        digests.sha256(F.col("content")).alias("content_sha"),
    )


@query(
    "corpus_issues",
    f"""WITH {SQL_FILES} SELECT source_path, code,
      CASE kind WHEN 'twice' THEN 'version' WHEN 'version_two' THEN 'schema_version' WHEN 'bad_id' THEN 'id'
        WHEN 'extra_field' THEN 'mood' WHEN 'no_version' THEN 'schema_version' WHEN 'text_version' THEN 'schema_version'
        WHEN 'bad_date' THEN 'updated_at' WHEN 'two_bad' THEN 'document_type' WHEN 'shared_id' THEN 'id' END AS field,
      CASE kind WHEN 'two_bad' THEN 'Input should be ''profile'', ''skill'', ''project'', ''experience'', ''education'', ''article'', ''faq'' or ''reference'' (and 1 more invalid field)'
        WHEN 'shared_id' THEN '`shared-doc` first claimed by ' || shared_owner
        WHEN 'bad_id' THEN 'String should match pattern ''{k.SLUG_PATTERN}'''
        WHEN 'twice' THEN 'duplicate key: version' WHEN 'extra_field' THEN 'Extra inputs are not permitted'
        WHEN 'version_two' THEN '2 is not supported; this build reads version 1'
        WHEN 'no_version' THEN 'required; the current version is 1'
        WHEN 'text_version' THEN 'must be a whole number, got str'
        WHEN 'bad_date' THEN 'Input should be a valid date' END AS reason
    FROM judged WHERE code IS NOT NULL""",
)
def corpus_issues(spark, folder):
    found = corpus.issues(corpus.read_documents(corpus_files(spark, folder)))
    yaml_error = F.col("message") == "Frontmatter is not valid YAML."
    return found.select(
        "source_path", "code", "field", F.when(~yaml_error, F.col("reason")).alias("reason")
    )


@query(
    "ingestion_report",
    f"WITH {SQL_FILES} SELECT coalesce(code, 'valid') AS code, count(*) AS files FROM judged GROUP BY 1 "
    "UNION ALL SELECT NULL, count(*) FROM judged",
)
def ingestion_report(spark, folder):
    return corpus.ingestion_report(corpus.read_documents(corpus_files(spark, folder)))
