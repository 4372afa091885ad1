"""Structure and chunking queries over Markdown made from the documents.

The SQL side states the same rules in another way: a heading belongs to a path when no
later heading of its rank or higher stands between, pieces come from list folds, and
every long block is a single line there, so only sentences, words and cuts remain.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import derived as d
from lodestone.catalog.text_queries import SQL_WS
from lodestone.functions import digests
from lodestone.functions import text as t
from lodestone.operators import chunking, structure
from lodestone.policies import ChunkingPolicy

QUERIES, ORACLE = {}, {}
POLICY = ChunkingPolicy()
MAX, TARGET, OVERLAP = POLICY.max_chars, POLICY.target_chars, POLICY.overlap_chars


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def sql_pack(units: str, separator: str, condition: str) -> str:
    """Fold of a list into packed strings; *condition* over a.cur and x.cur says "append"."""
    return (
        "list_reduce(list_transform(" + units + ", lambda u: {'done': CAST([] AS VARCHAR[]), 'cur': u}), "
        f"lambda a, x: CASE WHEN {condition} THEN {{'done': a.done, 'cur': a.cur || {separator} || x.cur}} "
        "ELSE {'done': list_append(a.done, a.cur), 'cur': x.cur} END)"
    )


NL2 = "chr(10) || chr(10)"
CLOSERS = "[.!?…][\"''»”’)\\]]*"
FIT = f"length(a.cur) + 1 + length(x.cur) <= {MAX}"
SQL_LINES = """all_lines AS (
  SELECT document_id, line_no, line, CASE WHEN box <> 'html' THEN box END AS box FROM md_lines
  UNION ALL SELECT document_id, line_no + 1, under, CASE WHEN box <> 'html' THEN box END FROM md_lines),
fence_lines AS (
  SELECT document_id, unnest(list_reduce(list_prepend(
      {'open': '', 'run': '', 'bare': false, 'n': -1::BIGINT, 'at': CAST([] AS BIGINT[])}, list(c ORDER BY c.n)), lambda a, x:
      CASE WHEN a.open = '' THEN {'open': x.run, 'run': '', 'bare': false, 'n': x.n, 'at': list_append(a.at, x.n)}
           WHEN x.bare AND left(x.run, 1) = left(a.open, 1) AND length(x.run) >= length(a.open)
             THEN {'open': '', 'run': '', 'bare': false, 'n': x.n, 'at': list_append(a.at, x.n)}
           ELSE a END).at) AS line_no
  FROM (SELECT document_id, {'open': '', 'run': regexp_extract(line, '^ {0,3}(`{3,}|~{3,})', 1),
          'bare': regexp_matches(line, '^ {0,3}(`{3,}|~{3,})[ \\t]*$'), 'n': line_no::BIGINT, 'at': CAST([] AS BIGINT[])} AS c
        FROM all_lines WHERE regexp_matches(line, '^ {0,3}(`{3,}[^`]*|~{3,}.*)$')) GROUP BY document_id),
fenced AS (
  SELECT *, is_fence OR fence_no % 2 = 1 AS in_code FROM (
    SELECT *, sum(is_fence::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS fence_no FROM (
      SELECT l.*, f.line_no IS NOT NULL AS is_fence FROM all_lines l
      LEFT JOIN fence_lines f ON f.document_id = l.document_id AND f.line_no = l.line_no))),
shaped AS (
  SELECT *, NOT in_code AND box IS NULL AND regexp_matches(line, '^ {0,3}#{1,6}([ \\t]|$)') AS h,
    NOT in_code AND regexp_matches(line, '^ {0,3}(=+|-+)[ \\t]*$') AS shape FROM fenced),
lined AS (
  SELECT *, shape AND coalesce(lag(NOT in_code AND NOT h AND NOT shape AND regexp_matches(line, '[^\\s\\p{Z}]')) OVER w, false) AS u,
    lag(line) OVER w AS above FROM shaped WINDOW w AS (PARTITION BY document_id ORDER BY line_no)),
headed AS (
  SELECT *, count(heading_level) OVER w AS section_no, h OR u OR coalesce(lead(u) OVER w, false) AS in_heading FROM (
    SELECT *, CASE WHEN h THEN length(regexp_extract(line, '^ {0,3}(#{1,6})', 1)) WHEN u THEN if(line LIKE '%=%', 1, 2) END AS heading_level,
      CASE WHEN h THEN trim(regexp_extract(line, '^ {0,3}#{1,6}(?:[ \\t]+(.*?))?(?:[ \\t]+#+)?[ \\t]*$', 1)) WHEN u THEN trim(above) END AS heading_text
    FROM lined) WINDOW w AS (PARTITION BY document_id ORDER BY line_no)),
heads AS (SELECT document_id, section_no AS no, heading_level AS level, heading_text AS text FROM headed WHERE heading_level IS NOT NULL),
closes AS (SELECT h.document_id, h.no, min(g.no) AS until FROM heads h JOIN heads g
  ON g.document_id = h.document_id AND g.no > h.no AND g.level <= h.level GROUP BY ALL),
paths AS (SELECT s.document_id, s.no AS section_no, list(h.text ORDER BY h.no) AS heading_path
  FROM heads s JOIN heads h ON h.document_id = s.document_id AND h.no <= s.no AND h.text <> ''
  LEFT JOIN closes c ON c.document_id = h.document_id AND c.no = h.no
  WHERE c.until IS NULL OR c.until > s.no GROUP BY ALL)"""
SQL_BLOCKS = SQL_LINES + f""",
blocks AS (
  SELECT document_id, section_no, start, kind, text,
    row_number() OVER (PARTITION BY document_id, section_no ORDER BY start) AS block_no FROM (
    SELECT document_id, section_no, min(line_no) AS start, any_value(kind) AS kind,
      regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '{SQL_WS}+$', '') AS text
    FROM (SELECT *, CASE WHEN in_code THEN 'code' WHEN box IS NOT NULL THEN box WHEN shape AND line LIKE '%---%' THEN 'other' ELSE 'paragraph' END AS kind,
            CASE WHEN in_code THEN -((fence_no + 1) // 2) WHEN box IS NOT NULL THEN 1000000000 + line_no // 2 ELSE line_no END AS place
          FROM headed WHERE NOT in_heading AND (in_code OR box IS NOT NULL OR regexp_matches(line, '[^\\s\\p{{Z}}]')))
    GROUP BY document_id, section_no, place) WHERE text <> '')"""
SQL_FRAGMENTS = SQL_BLOCKS + f""",
failed AS (SELECT DISTINCT document_id FROM blocks WHERE kind = 'code' AND length(text) > {MAX}),
sentences AS (
  SELECT document_id, section_no, block_no, unnest(list_append(p.done, p.cur)) AS piece,
    generate_subscripts(list_append(p.done, p.cur), 1) AS n1
  FROM (SELECT *, {sql_pack("list_filter(list_transform(string_split(regexp_replace(text, '(" + CLOSERS + ")" + SQL_WS + "+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')", "' '", FIT)} AS p
        FROM blocks WHERE length(text) > {MAX} AND kind <> 'code')),
worded AS (
  SELECT document_id, section_no, block_no, n1, unnest(list_append(p.done, p.cur)) AS piece,
    generate_subscripts(list_append(p.done, p.cur), 1) AS n2
  FROM (SELECT *, {sql_pack("string_split(piece, ' ')", "' '", FIT)} AS p FROM sentences WHERE length(piece) > {MAX})),
fragments AS (
  SELECT document_id, section_no, block_no, 0 AS n1, 0 AS n2, 0 AS n3, text AS piece FROM blocks WHERE length(text) <= {MAX}
  UNION ALL SELECT document_id, section_no, block_no, n1, 0, 0, piece FROM sentences WHERE length(piece) <= {MAX}
  UNION ALL SELECT document_id, section_no, block_no, n1, n2, 0, piece FROM worded WHERE length(piece) <= {MAX}
  UNION ALL SELECT document_id, section_no, block_no, n1, n2, n, substr(piece, n * {MAX} + 1, {MAX})
    FROM (SELECT *, unnest(generate_series(0, (length(piece) - 1) // {MAX})) AS n FROM worded WHERE length(piece) > {MAX}))"""
SQL_PIECES = SQL_FRAGMENTS + f""",
packed AS (
  SELECT document_id, section_no, list_append(p.done, p.cur) AS pieces FROM (
    SELECT document_id, section_no, {sql_pack("list(piece ORDER BY block_no, n1, n2, n3)", NL2,
      f"length(a.cur) + 2 + length(x.cur) <= {MAX} AND length(a.cur) < {TARGET}")} AS p
    FROM fragments WHERE document_id NOT IN (SELECT document_id FROM failed) GROUP BY document_id, section_no)),
placed AS (
  SELECT document_id, dense_rank() OVER (PARTITION BY document_id ORDER BY section_no) - 1 AS section_ordinal, section_no,
    unnest(pieces) AS body, generate_subscripts(pieces, 1) AS piece_no FROM packed),
tails AS (
  SELECT *, CASE WHEN length(previous) > budget THEN right(previous, budget::BIGINT) ELSE previous END AS tail FROM (
    SELECT *, least({OVERLAP}, {MAX} - length(body) - 2) AS budget,
      lag(body) OVER (PARTITION BY document_id, section_no ORDER BY piece_no) AS previous FROM placed)),
candidates AS (
  SELECT *,
    CASE WHEN instr(tail, {NL2}) > 0 THEN trim(substr(tail, instr(tail, {NL2}) + 2)) END AS c1,
    CASE WHEN instr(tail, chr(10)) > 0 THEN trim(substr(tail, instr(tail, chr(10)) + 1), ' ' || chr(10)) END AS c2,
    trim(regexp_extract(tail, '(?s)^.*?{CLOSERS}{SQL_WS}+(.*)$', 1)) AS c3,
    CASE WHEN length(previous) > budget AND substr(previous, length(previous) - budget::BIGINT, 1) NOT IN (' ', chr(10))
      THEN CASE WHEN instr(tail, ' ') > 0 THEN trim(substr(tail, instr(tail, ' ') + 1)) END ELSE trim(tail) END AS c4
  FROM tails),
chunks AS (
  SELECT document_id, section_ordinal, section_no,
    row_number() OVER (PARTITION BY document_id ORDER BY section_no, piece_no) - 1 AS ordinal,
    CASE WHEN prefix IS NULL THEN body ELSE prefix || {NL2} || body END AS content,
    coalesce(length(prefix), 0) AS overlap_prefix_chars
  FROM (SELECT *, CASE WHEN budget > 0 THEN coalesce(
      {", ".join(f"CASE WHEN {c} <> '' AND len(regexp_extract_all({c}, '(?m)^ {{0,3}}(`{{3,}}|~{{3,}})')) % 2 = 0 THEN {c} END" for c in ("c1", "c2", "c3", "c4"))}) END AS prefix
    FROM candidates))"""
PATH = "coalesce(array_to_string(p.heading_path, ' > '), '')"


def _lines(spark, folder):
    return structure.analyze(d.markdown(spark, folder))


@query(
    "explode_lines",
    d.with_sql("md_lines", "SELECT document_id, line_no, sha256(line) AS sha FROM all_lines", SQL_LINES),
)
def explode_lines(spark, folder):
    lines = structure.explode_lines(d.markdown(spark, folder))
    return lines.select("document_id", "line_no", digests.sha256(F.col("line")).alias("sha"))


@query(
    "mark_fences",
    d.with_sql("md_lines", "SELECT document_id, line_no, is_fence, in_code FROM fenced", SQL_LINES),
)
def mark_fences(spark, folder):
    lines = structure.mark_fences(d.markdown(spark, folder))
    return lines.select("document_id", "line_no", "is_fence", "in_code")


@query(
    "heading_path",
    d.with_sql(
        "md_lines",
        f"SELECT h.document_id, h.section_no, heading_level AS level, sha256({PATH}) AS path_sha "
        "FROM headed h LEFT JOIN paths p USING (document_id, section_no) WHERE heading_level IS NOT NULL",
        SQL_LINES,
    ),
)
def heading_path(spark, folder):
    heads = _lines(spark, folder).filter(F.col("heading_level").isNotNull())
    path = digests.sha256(F.array_join("heading_path", " > "))
    return heads.select("document_id", "section_no", F.col("heading_level").alias("level"), path.alias("path_sha"))


@query(
    "sections",
    d.with_sql(
        "md_lines",
        f"SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY section_no) - 1 AS section_ordinal, "
        f"blocks, chars, sha256({PATH}) AS path_sha FROM (SELECT document_id, section_no, count(*) AS blocks, "
        "sum(length(text))::BIGINT AS chars FROM blocks GROUP BY ALL) LEFT JOIN paths p USING (document_id, section_no)",
        SQL_BLOCKS,
    ),
)
def sections(spark, folder):
    found = structure.sections(d.markdown(spark, folder))
    path = digests.sha256(F.array_join("heading_path", " > "))
    return found.select("document_id", "section_ordinal", "blocks", "chars", path.alias("path_sha"))


@query(
    "blocks",
    d.with_sql(
        "md_lines",
        "SELECT document_id, section_no, block_no, kind, sha256(text) AS sha FROM blocks",
        SQL_BLOCKS,
    ),
)
def blocks(spark, folder):
    found = structure.blocks(_lines(spark, folder))
    return found.select("document_id", "section_no", "block_no", "kind", digests.sha256(F.col("text")).alias("sha"))


@query(
    "html_blocks",
    d.with_sql(
        "md_lines",
        "SELECT document_id, section_no, block_no, CASE kind WHEN 'html' THEN 'other' ELSE kind END AS kind, sha256(text) AS sha FROM blocks",
        SQL_BLOCKS.replace("CASE WHEN box <> 'html' THEN box END", "box"),
    ),
)
def html_blocks(spark, folder):
    """C5 with raw HTML as blocks: no heading inside a comment opens a section."""
    found = structure.blocks(structure.analyze(d.markdown(spark, folder), html=True))
    return found.select("document_id", "section_no", "block_no", "kind", digests.sha256(F.col("text")).alias("sha"))


@query(
    "fit_block",
    d.with_sql(
        "md_lines",
        "SELECT document_id, section_no, block_no, sha256(string_agg(piece, chr(1) ORDER BY n1, n2, n3)) AS sha, "
        "count(*) AS fragments FROM fragments GROUP BY ALL",
        SQL_FRAGMENTS,
    ),
)
def fit_block(spark, folder):
    """C6 on every block; blocks that cannot be divided have no fragments."""
    fitted = chunking.fit_blocks(structure.blocks(_lines(spark, folder)), POLICY)
    return fitted.filter(F.col("fragments").isNotNull()).select(
        "document_id", "section_no", "block_no",
        digests.sha256(F.array_join("fragments", "\x01")).alias("sha"),
        F.size("fragments").alias("fragments"),
    )


@query(
    "pack_blocks",
    d.with_sql(
        "md_lines",
        "SELECT document_id, section_no, len(pieces) AS pieces, sha256(array_to_string(pieces, chr(1))) AS sha "
        "FROM packed",
        SQL_PIECES,
    ),
)
def pack_blocks(spark, folder):
    """C7 per section, for documents that can be chunked."""
    fitted = chunking.fit_blocks(structure.blocks(_lines(spark, folder)), POLICY)
    failed = fitted.filter(F.col("problem").isNotNull()).select("document_id").distinct()
    fragments = F.flatten(
        F.transform(
            F.sort_array(F.collect_list(F.struct("block_no", "fragments"))), lambda b: b["fragments"]
        )
    )
    per_section = (
        fitted.join(failed, "document_id", "left_anti")
        .groupBy("document_id", "section_no")
        .agg(fragments.alias("fragments"))
        .withColumn("pieces", chunking.pack_fragments(F.col("fragments"), POLICY))
    )
    return per_section.select(
        "document_id", "section_no", F.size("pieces").alias("pieces"),
        digests.sha256(F.array_join("pieces", "\x01")).alias("sha"),
    )


@query(
    "chunk_corpus",
    d.with_sql(
        "md_lines",
        f"""SELECT printf('%s--%04d', c.document_id, ordinal) AS id, section_ordinal, overlap_prefix_chars,
          length(content) AS chars, sha256(content) AS content_sha, {PATH.replace("coalesce", "sha256(coalesce")}) AS path_sha,
          sha256(to_json({{'content': content, 'document_id': c.document_id,
            'heading_path': coalesce(p.heading_path, CAST([] AS VARCHAR[])),
            'policy': {{'max_chars': {MAX}, 'overlap_chars': {OVERLAP}, 'target_chars': {TARGET}}},
            'strategy_version': 'markdown-structure-v1'}})::VARCHAR) AS fingerprint
        FROM chunks c LEFT JOIN paths p USING (document_id, section_no)""",
        SQL_PIECES,
    ),
)
def chunk_corpus(spark, folder):
    chunks = chunking.chunk_corpus(d.markdown(spark, folder), POLICY)
    return chunks.select(
        "id", "section_ordinal", "overlap_prefix_chars", F.length("content").alias("chars"),
        digests.sha256(F.col("content")).alias("content_sha"),
        digests.sha256(F.array_join("heading_path", " > ")).alias("path_sha"), "fingerprint",
    )


@query(
    "overlap_prefix",
    d.with_sql(
        "md_lines",
        "SELECT document_id, ordinal, left(content, overlap_prefix_chars) AS prefix FROM chunks WHERE overlap_prefix_chars > 0",
        SQL_PIECES,
    ),
)
def overlap_prefix(spark, folder):
    chunks = chunking.chunk_corpus(d.markdown(spark, folder), POLICY)
    overlapping = chunks.filter(F.col("overlap_prefix_chars") > 0)
    return overlapping.select(
        "document_id", "ordinal", F.substring("content", F.lit(1), F.col("overlap_prefix_chars")).alias("prefix")
    )


@query(
    "chunking_issues",
    d.with_sql(
        "md_lines",
        f"SELECT document_id, section_no, block_no, 'unsplittable_code_block' AS problem, length(text) AS chars "
        f"FROM blocks WHERE kind = 'code' AND length(text) > {MAX}",
        SQL_BLOCKS,
    ),
)
def chunking_issues(spark, folder):
    return chunking.chunking_issues(d.markdown(spark, folder), POLICY)


@query(
    "chunk_invariants",
    d.with_sql(
        "md_lines",
        "SELECT count(*) AS chunks, 0 AS gaps, 0 AS over_max, 0 AS empty, 0 AS repeated_ids FROM chunks",
        SQL_PIECES,
    ),
)
def chunk_invariants(spark, folder):
    return chunking.chunk_invariants(chunking.chunk_corpus(d.markdown(spark, folder), POLICY), POLICY)


SQL_BROKEN = """broken AS (
  SELECT document_id, ordinal, printf('%s--%04d', document_id, CASE WHEN r = 4 AND ordinal = 1 THEN 0 ELSE ordinal END) AS id,
    CASE WHEN r = 2 AND ordinal = 0 THEN repeat(content, 9) WHEN r = 3 AND ordinal = 0 THEN ' ' ELSE content END AS content
  FROM (SELECT *, substr(document_id, 5)::BIGINT % 7 AS r FROM chunks) WHERE NOT (r = 1 AND ordinal = 1))"""


@query(
    "chunk_invariants_broken",
    d.with_sql(
        "md_lines",
        f"""SELECT count(*) AS chunks, count(*) FILTER (length(content) > {MAX}) AS over_max, count(*) FILTER (content = ' ') AS empty,
          (SELECT count(*) FROM (SELECT 1 FROM broken GROUP BY document_id HAVING list(ordinal ORDER BY ordinal) <> range(count(*)))) AS gaps,
          (SELECT count(*) FROM (SELECT 1 FROM broken GROUP BY id HAVING count(*) > 1)) AS repeated_ids FROM broken""",
        SQL_PIECES + ",\n" + SQL_BROKEN,
    ),
)
def chunk_invariants_broken(spark, folder):
    """C10 over chunks of which some are missing, too long, blank or named twice, by document number modulo 7."""
    chunks = chunking.chunk_corpus(d.markdown(spark, folder), POLICY)
    rest = F.substring("document_id", 5, 20).cast("long") % 7
    first, second = F.col("ordinal") == 0, F.col("ordinal") == 1
    content = F.when((rest == 2) & first, F.repeat("content", 9)).when((rest == 3) & first, " ").otherwise(F.col("content"))
    name = F.when((rest == 4) & second, t.chunk_id(F.col("document_id"), F.lit(0))).otherwise(F.col("id"))
    broken = chunks.filter(~((rest == 1) & second)).withColumn("content", content).withColumn("id", name)
    return chunking.chunk_invariants(broken, POLICY)


@query(
    "chunk_statistics",
    d.with_sql(
        "md_lines",
        f"""SELECT count(DISTINCT document_id) AS documents, count(*) AS chunks,
          (SELECT count(*) FROM packed) AS sections, (SELECT count(*) FROM packed WHERE len(pieces) > 1) AS split_sections,
          count(*) FILTER (overlap_prefix_chars > 0) AS chunks_with_overlap,
          round_even(avg(length(content)), 0)::BIGINT AS average_chars, min(length(content)) AS smallest_chars,
          max(length(content)) AS largest_chars, count(*) FILTER (length(content) > {MAX}) AS over_max FROM chunks""",
        SQL_PIECES,
    ),
)
def chunk_statistics(spark, folder):
    return chunking.chunk_statistics(chunking.chunk_corpus(d.markdown(spark, folder), POLICY), POLICY)


@query(
    "chunk_id",
    "SELECT printf('%s--%04d', 'doc-' || doc_id, n_chars) AS id FROM documents",
)
def chunk_id(spark, folder):
    """C11 with ordinals of any width."""
    docs = d.table(spark, folder, "documents")
    return docs.select(
        t.chunk_id(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("n_chars")).alias("id")
    )
