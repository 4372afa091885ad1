"""Contexts, conversations, replies, citations, decisions and answer records.

One question and one reply per document: the reply's shape and labels follow from the
document id, its answer text is the document's text. Four passages stand behind every
question; their documents and sections follow from the id too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.catalog import derived as d
from lodestone.catalog import retrieval_queries as r
from lodestone.catalog.text_queries import SQL_WS
from lodestone.functions import digests, marks, replies
from lodestone.functions import text as t
from lodestone.operators import answers, context, evaluation
from lodestone.policies import CostProfile
from lodestone.session import stage

QUERIES, ORACLE = {}, {}
CATEGORIES = r.CATEGORIES
INSTRUCTIONS = "Answer from the passages only."
SHAPES = (
    "plain", "fenced", "cut", "prose", "list", "number", "bare_label", "odd_label", "maybe", "brackets",
    "nothing", "inferred", "blank", "empty_object", "no_sources", "four",
)


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


#: Label forms in prose that every answer ends with, and what is published of them.
NAMED = "\nLaut Quellen S1 und S2 nutzt er es. Siehe Quelle S3.\n- S2: Teil (S1) hier.\nDies steht in S1, S2.\nEnde"
PUBLISHED = "\nEr nutzt es.\n- Teil hier.\nDies steht in.\nEnde"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\n", "' || chr(10) || '") + "'"


# --- derived inputs -----------------------------------------------------------------------
def replies_table(spark, folder):
    """query_id, reply, finish_reason."""
    docs = d.table(spark, folder, "documents")
    kind = d.pick(F.col("doc_id"), SHAPES)
    answer = F.concat("text", F.lit(NAMED + " [S1], [S2; S9] 【s3】"))

    def reply(sources: str, support: str, field="answer"):
        body = F.to_json(F.struct(answer.alias(field)), {"ignoreNullFields": "false"})
        return F.concat(
            F.substring(body, F.lit(1), F.length(body) - 1), F.lit(f', "sources": {sources}, "support": {support}}}')
        )

    stated = '"stated"'
    text = (
        F.when(kind == "plain", reply('["S1", "S2"]', stated))
        .when(kind == "fenced", F.concat(F.lit("```json\n"), reply('["S2", "S2", "S7"]', stated), F.lit("\n```\n")))
        .when(kind == "cut", F.substring(reply('["S1"]', stated), F.lit(1), F.length("text")))
        .when(kind == "prose", F.concat(F.lit("I cannot say: "), "text"))
        .when(kind == "list", '["S1"]')
        .when(kind == "number", '{"answer": 5, "sources": [], "support": "none"}')
        .when(kind == "bare_label", reply('"S1"', stated))
        .when(kind == "odd_label", reply('["S1", 3]', stated))
        .when(kind == "maybe", reply('["S1"]', '"maybe"'))
        .when(kind == "brackets", reply('["[s2]", " s1 ", "S9", "notes.md"]', '" Stated "'))
        .when(kind == "nothing", '{"answer": null, "sources": null, "support": "none"}')
        .when(kind == "inferred", reply('["S3"]', '"inferred"'))
        .when(kind == "blank", " \n ")
        .when(kind == "empty_object", "{}")
        .when(kind == "no_sources", reply("[]", stated))
        .otherwise(reply('["S4", "S3", "S2", "S1"]', stated))
    )
    finish = F.when(F.col("doc_id") % 32 == 2, "length").when(F.col("doc_id") % 32 != 18, "stop")
    return docs.select(F.col("doc_id").alias("query_id"), text.alias("reply"), finish.alias("finish_reason"))


_ANSWER = f"text || {_sql_text(NAMED)} || ' [S1], [S2; S9] 【s3】'"


def _sql_reply(sources: str, support: str) -> str:
    body = f"to_json({{'answer': {_ANSWER}}})::VARCHAR"
    return f"left({body}, length({body}) - 1) || ', \"sources\": {sources}, \"support\": {support}}}'"


_S = '"stated"'
SQL_REPLIES = f"""replies AS (
  SELECT doc_id AS query_id, CASE kind WHEN 'plain' THEN {_sql_reply('["S1", "S2"]', _S)}
    WHEN 'fenced' THEN '```json' || chr(10) || {_sql_reply('["S2", "S2", "S7"]', _S)} || chr(10) || '```' || chr(10)
    WHEN 'cut' THEN left({_sql_reply('["S1"]', _S)}, length(text)) WHEN 'prose' THEN 'I cannot say: ' || text
    WHEN 'list' THEN '["S1"]' WHEN 'number' THEN '{{"answer": 5, "sources": [], "support": "none"}}'
    WHEN 'bare_label' THEN {_sql_reply('"S1"', _S)} WHEN 'odd_label' THEN {_sql_reply('["S1", 3]', _S)}
    WHEN 'maybe' THEN {_sql_reply('["S1"]', '"maybe"')}
    WHEN 'brackets' THEN {_sql_reply('["[s2]", " s1 ", "S9", "notes.md"]', '" Stated "')}
    WHEN 'nothing' THEN '{{"answer": null, "sources": null, "support": "none"}}'
    WHEN 'inferred' THEN {_sql_reply('["S3"]', '"inferred"')} WHEN 'blank' THEN ' ' || chr(10) || ' '
    WHEN 'empty_object' THEN '{{}}' WHEN 'no_sources' THEN {_sql_reply('[]', _S)}
    ELSE {_sql_reply('["S4", "S3", "S2", "S1"]', _S)} END AS reply,
    CASE WHEN doc_id % 32 = 2 THEN 'length' WHEN doc_id % 32 <> 18 THEN 'stop' END AS finish_reason
  FROM (SELECT *, {d.sql_pick('doc_id', SHAPES)} AS kind FROM documents)),
candidates AS (
  SELECT *, CASE WHEN regexp_matches(reply, '(?s)^\\s*```(?:json)?\\s*.*?\\s*```\\s*$')
    THEN regexp_extract(reply, '(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$', 1)
    ELSE regexp_replace(reply, '^{SQL_WS}+|{SQL_WS}+$', '', 'g') END AS c FROM replies),
typed AS (
  SELECT *, CASE WHEN c <> '' AND json_valid(c) THEN c END AS j FROM candidates),
ruled AS (
  SELECT *, CASE WHEN c = '' THEN 'reply_empty' WHEN j IS NULL THEN 'reply_not_json'
      WHEN json_type(j) <> 'OBJECT' THEN 'reply_not_an_object'
      WHEN json_type(j, '$.answer') NOT IN ('VARCHAR', 'NULL') THEN 'answer_not_text'
      WHEN json_type(j, '$.sources') NOT IN ('ARRAY', 'NULL') THEN 'sources_not_a_list'
      WHEN len(list_filter(json_extract(j, '$.sources[*]'), lambda e: json_type(e) <> 'VARCHAR')) > 0 THEN 'source_not_text'
      WHEN json_type(j, '$.support') NOT IN ('VARCHAR', 'NULL')
        OR lower(trim(json_extract_string(j, '$.support'))) NOT IN ('stated', 'inferred', 'none') THEN 'support_not_recognized' END AS rule
  FROM typed),
parsed AS (
  SELECT query_id, reply, finish_reason, rule,
    CASE WHEN rule IS NULL THEN coalesce(trim(json_extract_string(j, '$.answer')), '') END AS answer,
    CASE WHEN rule IS NULL THEN list_transform(list_transform(json_extract_string(j, '$.sources[*]'), lambda e: trim(trim(trim(e), '[]'))),
      lambda e: CASE WHEN regexp_matches(upper(e), '^S\\d+$') THEN upper(e) ELSE e END) END AS labels,
    CASE WHEN rule IS NULL THEN lower(trim(json_extract_string(j, '$.support'))) END AS support FROM ruled)"""


def passages(spark, folder):
    """Labels S1..S4 of every question with the passages behind them."""
    docs = d.table(spark, folder, "documents")
    four = docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    place = (F.col("doc_id") * 3 + F.col("n") % 3) % 50
    section = F.when(F.col("n") % 2 == 1, F.concat(F.lit("Part "), (F.col("n") % 3).cast("string")))
    return four.select(
        F.col("doc_id").alias("query_id"),
        F.concat(F.lit("S"), F.col("n").cast("string")).alias("label"),
        F.concat(F.lit("doc-"), place.cast("string")).alias("document_id"),
        F.concat(F.lit("Document "), place.cast("string")).alias("title"),
        "source",
        section.alias("section"),
        F.concat(F.lit("[SOURCE S"), F.col("n").cast("string"), F.lit("]\n"), "text").alias("text"),
        (F.col("n") == 1 + F.col("doc_id") % 5).alias("relevant"),
    )


SQL_SOURCES = """sources AS (
  SELECT doc_id AS query_id, 'S' || n AS label, 'doc-' || ((doc_id * 3 + n % 3) % 50) AS document_id,
    'Document ' || ((doc_id * 3 + n % 3) % 50) AS title, source, CASE WHEN n % 2 = 1 THEN 'Part ' || (n % 3) END AS section,
    '[SOURCE S' || n || ']' || chr(10) || text AS text, n = 1 + doc_id % 5 AS relevant
  FROM documents, (SELECT unnest([1, 2, 3, 4]) AS n)),
claims AS (
  SELECT query_id, unnest(labels) AS label, generate_subscripts(labels, 1) - 1 AS claim_pos FROM parsed),
resolved AS (
  SELECT c.query_id, c.claim_pos, c.label, s.document_id, s.title, s.source, s.section, s.text,
    CASE WHEN s.label IS NULL THEN 'unknown'
      WHEN row_number() OVER (PARTITION BY c.query_id, c.label ORDER BY claim_pos) > 1 THEN 'duplicate' ELSE 'cited' END AS status
  FROM claims c LEFT JOIN sources s ON s.query_id = c.query_id AND s.label = c.label),
collapsed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY claim_pos) AS citation_no FROM (
    SELECT * FROM resolved WHERE status = 'cited'
    QUALIFY row_number() OVER (PARTITION BY query_id, document_id, section ORDER BY claim_pos) = 1))"""


def sql(body: str, *extra: str) -> str:
    return "WITH " + ",\n".join((SQL_REPLIES, SQL_SOURCES, *extra)) + "\n" + body


def parsed(spark, folder):
    return answers.parse_replies(replies_table(spark, folder))


def resolved(spark, folder, read=None):
    read = parsed(spark, folder) if read is None else read
    return answers.resolve_citations(read, passages(spark, folder))


def outcome(spark, folder, read=None):
    read = parsed(spark, folder) if read is None else read
    return answers.citation_outcome(read, resolved(spark, folder, read))


# --- replies --------------------------------------------------------------------------------
@query(
    "parse_replies",
    sql("SELECT query_id, rule, sha256(answer) AS answer_sha, array_to_string(labels, ',') AS labels, support FROM parsed"),
)
def parse_replies(spark, folder):
    return parsed(spark, folder).select(
        "query_id", "rule", digests.sha256(F.col("answer")).alias("answer_sha"),
        F.array_join("labels", ",").alias("labels"), "support",
    )


@query(
    "truncated_replies",
    sql(
        """SELECT query_id, CASE WHEN finish_reason = 'length' OR (finish_reason IS NULL AND query_id % 16 = 2 AND left(reply, 1) = '{'
          AND NOT json_valid(reply)) THEN 'output_truncated' ELSE 'unparseable_output' END AS category FROM parsed WHERE rule IS NOT NULL"""
    ),
)
def truncated_replies(spark, folder):
    """Why a reply could not be used; only the cut shape is an open object."""
    return parsed(spark, folder).filter(F.col("rule").isNotNull()).select("query_id", "category")


VERDICTS = (
    '{"verdict": "supported"}', '{"verdict": " NOT_SUPPORTED "}', '{"verdict": null}', '{"verdict": "yes"}',
    '{"verdict": true}', '[]', 'supported', '', '```{"verdict": "supported"}```', '{"reason": "x"}',
)
VERDICT_RULES = (
    ("supported", None), ("not_supported", None), ("unusable", "verdict_missing"), ("unusable", "verdict_not_recognized"),
    ("unusable", "verdict_not_recognized"), ("unusable", "reply_not_an_object"), ("unusable", "reply_not_json"),
    ("unusable", "reply_empty"), ("supported", None), ("unusable", "verdict_missing"),
)


def verdict_table(spark, folder):
    docs = d.table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("query_id"), d.pick(F.col("doc_id"), VERDICTS).alias("reply"))


def _sql_verdicts(number: str) -> str:
    verdicts = "['" + "','".join(v for v, _ in VERDICT_RULES) + "']"
    rules = "[" + ",".join(f"'{rule}'" if rule else "NULL" for _, rule in VERDICT_RULES) + "]"
    return f"({verdicts})[{number} % 10 + 1] AS verdict, ({rules})[{number} % 10 + 1] AS rule"


@query("parse_verdicts", f"SELECT doc_id AS query_id, {_sql_verdicts('doc_id')} FROM documents")
def parse_verdicts(spark, folder):
    return answers.parse_verdicts(verdict_table(spark, folder)).select("query_id", "verdict", "rule")


@query(
    "canonical_marks",
    sql(
        "SELECT query_id, sha256(left(answer, length(answer) - length('[S1], [S2; S9] 【s3】')) || '[S1], [S2] [S9] [S3]') AS sha "
        "FROM parsed WHERE answer <> ''"
    ),
)
def canonical_marks(spark, folder):
    """J9; the documents themselves carry no marks, so only the added ones change."""
    rows = parsed(spark, folder).filter(F.col("answer") != "")
    return rows.select("query_id", digests.sha256(marks.canonical_marks(F.col("answer"))).alias("sha"))


@query(
    "dangling_marks",
    """SELECT doc_id, len(list_filter(regexp_extract_all(t, '\\[(\\d+)\\]', 1), lambda n: n::HUGEINT < 1 OR n::HUGEINT > doc_id % 4)) > 0 AS dangling
    FROM (SELECT doc_id, text || ' [1] and [' || doc_id || ']' AS t FROM documents)""",
)
def dangling_marks(spark, folder):
    docs = d.table(spark, folder, "documents")
    answer = F.concat("text", F.lit(" [1] and ["), F.col("doc_id").cast("string"), F.lit("]"))
    return docs.select("doc_id", marks.has_dangling_mark(answer, F.col("doc_id") % 4).alias("dangling"))


LEAKS = (" [S1]", " (S2, S3)", " Source: S4", " S1 and S2", " plain", " 【S5】", " S3", " AWS S3 bucket", " see S1, S2")
LEAK_FOUND = (True, True, True, True, False, True, False, False, True)


@query(
    "label_leaks",
    "SELECT doc_id, ([" + ",".join(str(v).lower() for v in LEAK_FOUND) + "])[doc_id % 9 + 1] AS leak FROM documents",
)
def label_leaks(spark, folder):
    """Texts without marks, each with one ending that is or is not a leak."""
    docs = d.table(spark, folder, "documents")
    answer = F.concat("text", d.pick(F.col("doc_id"), LEAKS))
    return docs.select("doc_id", marks.has_label_leak(answer).alias("leak"))


# --- citations ------------------------------------------------------------------------------
@query("resolve_citations", sql("SELECT query_id, claim_pos, label, status, document_id, section FROM resolved"))
def resolve_citations(spark, folder):
    return resolved(spark, folder).select("query_id", "claim_pos", "label", "status", "document_id", "section")


@query("collapse_citations", sql("SELECT query_id, citation_no, label, document_id, section FROM collapsed"))
def collapse_citations(spark, folder):
    found = answers.collapse_citations(resolved(spark, folder))
    return found.select("query_id", "citation_no", "label", "document_id", "section")


@query(
    "citation_outcome",
    sql(
        """SELECT p.query_id, (SELECT count(*) FROM collapsed c WHERE c.query_id = p.query_id) AS citations,
          coalesce((SELECT string_agg(label, ',' ORDER BY claim_pos) FROM resolved r WHERE r.query_id = p.query_id AND status = 'unknown'), '') AS unknown,
          (SELECT count(*) FROM resolved r WHERE r.query_id = p.query_id AND status = 'duplicate') AS duplicate_labels FROM parsed p"""
    ),
)
def citation_outcome(spark, folder):
    return outcome(spark, folder).select(
        "query_id", F.size("citations").alias("citations"),
        F.array_join("unknown_labels", ",").alias("unknown"), "duplicate_labels",
    )


SQL_NUMBERED = f"""places AS (
  SELECT c.query_id, c.document_id || '/' || coalesce(c.section, '-') AS place, list(r.label) AS labels,
    row_number() OVER (PARTITION BY c.query_id ORDER BY coalesce(min(list_position(['S1', 'S2', 'S9', 'S3'], r.label)), 99), c.citation_no) AS no
  FROM collapsed c JOIN resolved r ON r.query_id = c.query_id AND r.status = 'cited' AND r.document_id = c.document_id
    AND r.section IS NOT DISTINCT FROM c.section GROUP BY c.query_id, c.citation_no, c.document_id, c.section),
mark_numbers AS (
  SELECT query_id, m, i, (SELECT no FROM places x WHERE x.query_id = a.query_id AND list_contains(x.labels, m)) AS no
  FROM (SELECT query_id, unnest(['S1', 'S2', 'S9', 'S3']) AS m, unnest([1, 2, 3, 4]) AS i FROM parsed WHERE rule IS NULL AND answer <> '') a),
numbered AS (
  SELECT a.query_id, m.removed AS removed_marks,
    ltrim(regexp_replace(left(answer, length(answer) - length({_sql_text(NAMED)} || ' [S1], [S2; S9] 【s3】')) || {_sql_text(PUBLISHED)},
      chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), chr(10)) || m.marks AS presented
  FROM parsed a JOIN (SELECT query_id, count(*) FILTER (no IS NULL) AS removed,
      string_agg(coalesce(' [' || no || ']', '') || CASE WHEN i = 1 THEN ',' ELSE '' END, '' ORDER BY i) AS marks
    FROM mark_numbers GROUP BY query_id) m ON m.query_id = a.query_id)"""


@query(
    "number_citations",
    sql(
        """SELECT n.query_id, removed_marks, sha256(presented) AS presented_sha, count(o.place) AS citations,
          coalesce(string_agg(o.place, ',' ORDER BY no), '') AS ordered
          FROM numbered n LEFT JOIN places o ON o.query_id = n.query_id GROUP BY ALL""",
        SQL_NUMBERED,
    ),
)
def number_citations(spark, folder):
    """The published text, order and number of citations, how many marks were removed."""
    read = parsed(spark, folder)
    rows = read.filter((F.col("answer") != "")).select("query_id", "answer")
    numbered = answers.number_citations(rows.join(outcome(spark, folder, read), "query_id"))
    place = F.transform(
        "ordered_citations", lambda c: F.concat(c["document_id"], F.lit("/"), F.coalesce(c["section"], F.lit("-")))
    )
    return numbered.select(
        "query_id", F.size("ordered_citations").alias("citations"), F.array_join(place, ",").alias("ordered"),
        "removed_marks", digests.sha256(F.col("presented")).alias("presented_sha"),
    )


def decisions(spark, folder):
    docs = d.table(spark, folder, "documents")
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    retrieved = docs.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 9).alias("retrieved"))
    verdicts = answers.parse_verdicts(verdict_table(spark, folder))
    # The labels and the drafts go different ways: replies are parsed once.
    read = stage(parsed(spark, folder).select("query_id", "rule", "answer", "labels", "support"), "parsed")
    return answers.answer_decision(asked, retrieved, read, outcome(spark, folder, read), verdicts)


SQL_DECIDED = f"""decided AS (
  SELECT *, CASE WHEN query_id % 9 = 0 THEN NULL WHEN rule IS NOT NULL THEN rule
      WHEN publishable AND verdict = 'unusable' THEN vrule END AS error,
    CASE WHEN query_id % 9 = 0 THEN 'no_knowledge' WHEN rule IS NOT NULL THEN NULL
      WHEN publishable AND verdict = 'unusable' THEN NULL
      WHEN publishable AND verdict = 'supported' THEN 'answered' ELSE 'not_grounded' END AS outcome
  FROM (SELECT p.query_id, p.rule, p.answer AS draft, v.verdict, v.rule AS vrule, n.citations, n.unknown,
      coalesce(p.support = 'stated', false) AND coalesce(p.answer, '') <> '' AND n.citations > 0 AS publishable
    FROM parsed p JOIN (SELECT doc_id, {_sql_verdicts('doc_id')} FROM documents) v ON v.doc_id = p.query_id
    JOIN (SELECT q.query_id, count(c.query_id) AS citations, (SELECT count(*) FROM resolved r WHERE r.query_id = q.query_id AND r.status = 'unknown') AS unknown
      FROM parsed q LEFT JOIN collapsed c ON c.query_id = q.query_id GROUP BY q.query_id) n ON n.query_id = p.query_id))"""


@query(
    "answer_decision",
    sql(
        """SELECT d.query_id, outcome, error, CASE WHEN outcome = 'answered' THEN citations ELSE 0 END AS citations,
          CASE WHEN outcome = 'answered' THEN sha256(presented) END AS published_sha
          FROM decided d LEFT JOIN numbered n ON n.query_id = d.query_id""",
        SQL_DECIDED, SQL_NUMBERED,
    ),
)
def answer_decision(spark, folder):
    published = F.when(F.col("outcome") == "answered", digests.sha256(F.col("answer")))
    return decisions(spark, folder).select(
        "query_id", "outcome", "error", F.size("citations").alias("citations"), published.alias("published_sha")
    )


@query(
    "evidence_table",
    sql(
        """SELECT p.query_id, sha256('EVIDENCE' || chr(10) || coalesce((SELECT string_agg(text, chr(10) || chr(10) ORDER BY claim_pos)
          FROM resolved r WHERE r.query_id = p.query_id AND status = 'cited'), '') || chr(10) || chr(10) || 'QUESTION' || chr(10) || d.source
          || chr(10) || chr(10) || 'ANSWER' || chr(10) || p.answer) AS sha FROM parsed p JOIN documents d ON d.doc_id = p.query_id WHERE p.rule IS NULL"""
    ),
)
def evidence_table(spark, folder):
    docs = d.table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("question"))
    read = parsed(spark, folder)
    rows = read.filter(F.col("rule").isNull()).select("query_id", "answer").join(docs, "query_id")
    cited = resolved(spark, folder, read).filter(F.col("status") == "cited")
    return context.evidence_table(rows, cited).select("query_id", digests.sha256(F.col("evidence_text")).alias("sha"))


# --- conversations and prompts ----------------------------------------------------------------
SQL_TURNS = f"""clean AS (
  SELECT conv_id, turn, role, text, regexp_replace(regexp_replace(nfc_normalize(text), '{SQL_WS}+', ' ', 'g'), '^ | $', '', 'g') AS q,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
judged_turns AS (
  SELECT *, sum(length(q)) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {k.MAX_CONVERSATION_CHARACTERS} AS keep,
    CASE WHEN role NOT IN ('user', 'assistant') THEN 'role_not_allowed' WHEN length(text) > {k.MAX_TURN_LENGTH} THEN 'turn_too_long' END AS problem FROM clean),
bounded AS (
  SELECT conv_id, CASE WHEN max(n) > {k.MAX_CONVERSATION_TURNS} THEN 'too_many_turns'
      ELSE arg_min(problem, turn) FILTER (problem IS NOT NULL) END AS error,
    count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped,
    string_agg(role || ': ' || q, chr(10) ORDER BY turn) FILTER (keep) AS text FROM judged_turns GROUP BY conv_id)"""


@query(
    "bound_conversation",
    f"WITH {SQL_TURNS} SELECT conv_id, error, CASE WHEN error IS NULL THEN kept END AS kept, "
    "CASE WHEN error IS NULL THEN dropped END AS dropped, CASE WHEN error IS NULL THEN sha256(coalesce(text, '')) END AS text_sha FROM bounded",
)
def bound_conversation(spark, folder):
    bounded = context.bound_conversation(d.table(spark, folder, "conversations"))
    text = F.when(F.col("error").isNull(), F.coalesce(context.conversation_text(F.col("turns")), F.lit("")))
    return bounded.select("conv_id", "error", "kept", "dropped", digests.sha256(text).alias("text_sha"))


@query(
    "context_budgets",
    f"""WITH {SQL_TURNS} SELECT conv_id AS query_id, 5200 - overhead AS available_tokens, overhead AS overhead_tokens FROM (
      SELECT conv_id, CAST(ceil((CASE WHEN text IS NULL OR error IS NOT NULL THEN {len(INSTRUCTIONS)} ELSE {len(INSTRUCTIONS) + 2 + len(INSTRUCTIONS)} END) / 3.0) AS BIGINT)
        + CAST(ceil(length('KNOWLEDGE' || chr(10) || '(no passages were retrieved)' || chr(10) || chr(10)
          || CASE WHEN error IS NULL THEN coalesce('CONVERSATION' || chr(10) || text || chr(10) || chr(10), '') ELSE '' END
          || 'QUESTION' || chr(10) || 'question ' || conv_id) / 3.0) AS BIGINT) AS overhead FROM bounded)""",
)
def context_budgets(spark, folder):
    """What is left for passages after instructions, conversation and question."""
    bounded = context.bound_conversation(d.table(spark, folder, "conversations"))
    asked = bounded.select(
        F.col("conv_id").alias("query_id"),
        F.concat(F.lit("question "), F.col("conv_id").cast("string")).alias("question"), "turns",
    )
    return context.context_budgets(asked, INSTRUCTIONS, INSTRUCTIONS).select("query_id", "available_tokens", "overhead_tokens")


@query(
    "prompt_table",
    f"""WITH {SQL_TURNS} SELECT b.conv_id AS query_id, sha256('KNOWLEDGE' || chr(10) || coalesce(d.text, '(no passages were retrieved)') || chr(10) || chr(10)
      || CASE WHEN b.error IS NULL THEN coalesce('CONVERSATION' || chr(10) || b.text || chr(10) || chr(10), '') ELSE '' END
      || 'QUESTION' || chr(10) || 'question ' || b.conv_id) AS sha FROM bounded b LEFT JOIN documents d ON d.doc_id = b.conv_id""",
)
def prompt_table(spark, folder):
    bounded = context.bound_conversation(d.table(spark, folder, "conversations"))
    asked = bounded.select(
        F.col("conv_id").alias("query_id"),
        F.concat(F.lit("question "), F.col("conv_id").cast("string")).alias("question"), "turns",
    )
    docs = d.table(spark, folder, "documents")
    contexts = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("context"))
    return context.prompt_table(asked, contexts).select("query_id", digests.sha256(F.col("prompt")).alias("sha"))


# --- contexts -----------------------------------------------------------------------------------
def retrieved_passages(spark, folder):
    """Seven documents per document as passages: whole texts, with repeats among them."""
    docs = d.documents(spark, folder).select("doc_id", "document_id", "title", "source", "content")
    seven = docs.select(F.col("doc_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("position"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    # One aggregate row beside the questions.
    placed = seven.join(total, F.lit(True)).withColumn(
        "doc_id", (F.col("query_id") * 5 + F.col("position") % 5 * 7) % F.col("total")
    )
    path = F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("Text")))
    return placed.drop("total").join(docs, "doc_id").select(
        "query_id", "position", F.col("document_id").alias("id"), "document_id", "title", "source",
        F.coalesce(path, F.array().cast("array<string>")).alias("heading_path"), "content",
    )


def budgets(spark, folder):
    docs = d.table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 40 * 100 + 100).alias("available_tokens"))


SQL_CONTEXT = """bodies AS (
  SELECT q.doc_id AS query_id, n AS position, d.document_id AS id, 'Document: ' || d.title || chr(10)
      || CASE WHEN d.doc_id % 2 = 0 THEN 'Section: ' || d.source || ' > Text' || chr(10) ELSE '' END
      || 'Content:' || chr(10) || d.content AS body, q.doc_id % 40 * 100 + 100 AS budget
  FROM docs q, (SELECT unnest(generate_series(1, 7)) AS n), (SELECT count(*) AS total FROM docs) c, docs d
  WHERE d.doc_id = (q.doc_id * 5 + n % 5 * 7) % c.total),
lists AS (SELECT query_id, any_value(budget) AS budget, list({'p': position, 'l': length(body), 'h': sha256(body), 'i': id} ORDER BY position) AS ps FROM bodies GROUP BY query_id),
fold AS (
  WITH RECURSIVE walk AS (
    SELECT query_id, 0 AS step, 0::BIGINT AS chars, 0 AS n, CAST([] AS VARCHAR[]) AS seen, NULL::VARCHAR AS decision FROM lists
    UNION ALL
    SELECT query_id, step + 1, CASE WHEN dec = 'included' THEN total ELSE chars END, CASE WHEN dec = 'included' THEN n + 1 ELSE n END,
      CASE WHEN dec = 'included' THEN list_concat(seen, [h, i]) ELSE seen END, dec
    FROM (SELECT w.*, p.h, p.i, total, CASE WHEN list_contains(seen, p.h) OR list_contains(seen, p.i) THEN 'duplicate'
            WHEN ceil(total / 3.0) <= budget THEN 'included' ELSE 'over_budget' END AS dec
          FROM (SELECT w.*, l.budget, l.ps[step + 1] AS p,
                  chars + CASE WHEN n > 0 THEN 2 ELSE 0 END + length('[SOURCE S' || (n + 1) || ']' || chr(10)) + l.ps[step + 1].l AS total
                FROM walk w JOIN lists l USING (query_id) WHERE step < len(l.ps)) w))
  SELECT * FROM walk WHERE step > 0)"""


@query("pack_context", d.with_sql("docs", "SELECT query_id, step AS position, decision, CASE WHEN decision = 'included' THEN 'S' || n END AS label FROM fold", SQL_CONTEXT))
def pack_context(spark, folder):
    """G4, G5 as rows: what happened to each passage."""
    packed = context.pack_context(retrieved_passages(spark, folder), budgets(spark, folder))
    return packed.select("query_id", "position", "decision", "label")


@query(
    "context_summary",
    d.with_sql(
        "docs",
        """SELECT f.query_id, count(*) FILTER (decision = 'included') AS sources, count(*) FILTER (decision = 'duplicate') AS duplicates_removed,
          count(*) FILTER (decision = 'over_budget') AS skipped_for_budget, count(*) FILTER (decision = 'included') = 0 AS failed,
          sha256(coalesce(string_agg('[SOURCE S' || n || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY step) FILTER (decision = 'included'), '')) AS sha
        FROM fold f JOIN bodies b ON b.query_id = f.query_id AND b.position = f.step GROUP BY f.query_id""",
        SQL_CONTEXT,
    ),
)
def context_summary(spark, folder):
    packed = context.pack_context(retrieved_passages(spark, folder), budgets(spark, folder))
    return context.context_summary(packed).select(
        "query_id", "sources", "duplicates_removed", "skipped_for_budget", "failed",
        digests.sha256(F.col("context")).alias("sha"),
    )


# --- records ------------------------------------------------------------------------------------
def record_scores(spark, folder):
    """Retrieval scores per question, as score_retrieval gives them."""
    docs = d.table(spark, folder, "documents")
    rank = F.when(F.col("doc_id") % 4 != 3, F.col("doc_id") % 7 + 1)
    return docs.select(
        F.col("doc_id").alias("query_id"), d.pick(F.col("doc_id"), CATEGORIES).alias("category"),
        rank.cast("int").alias("first_relevant_rank"), F.lit(7).alias("retrieved"),
        (F.col("doc_id") % 101 == 7).alias("leaked_internal"),
    )


def records(spark, folder):
    """F11 and F12 over the decisions."""
    # Four branches read the decisions: they are computed once.
    made = stage(decisions(spark, folder), "decisions")
    docs = d.table(spark, folder, "documents").select(
        F.col("doc_id").alias("query_id"), (F.col("n_chars") / 1000.0).alias("duration_seconds")
    )
    scored = record_scores(spark, folder)
    done = made.filter(F.col("outcome").isNotNull()).join(docs, "query_id")
    verified = evaluation.verified_citations(done, passages(spark, folder))
    answered = evaluation.score_answers(
        done.select("query_id", "outcome", "answer", "citations", "unknown_labels", "duration_seconds"), scored, verified
    )
    broken = made.filter(F.col("outcome").isNull()).join(docs, "query_id").select(
        "query_id", "duration_seconds",
        F.when(F.col("query_id") % 5 != 0, "unparseable_output").alias("error_category"),
        (F.col("query_id") % 6 != 0).alias("retrieval_observed"),
    )
    errors = evaluation.score_errors(broken, scored)
    return answered.unionByName(errors, allowMissingColumns=True)


_EXP = d.sql_list(k.ANSWERABLE_CATEGORIES)
_REF = d.sql_list(k.MUST_REFUSE_CATEGORIES)
SQL_RECORDS = SQL_DECIDED + f""",
base AS (
  SELECT d.*, {d.sql_pick('d.query_id', CATEGORIES)} AS category, CASE WHEN d.query_id % 4 <> 3 THEN d.query_id % 7 + 1 END AS rank,
    d.query_id % 101 = 7 AS leaked, o.n_chars / 1000.0::DOUBLE AS duration_seconds, (d.query_id * 3) % 50 AS p0,
    CASE WHEN d.outcome = 'answered' THEN d.citations ELSE 0 END AS published,
    d.outcome IS NULL AS errored, d.query_id % 6 <> 0 AS observed
  FROM decided d JOIN documents o ON o.doc_id = d.query_id),
records AS (
  SELECT *, category IN ({_EXP}) AS expects, category IN ({_REF}) AS refuses,
    coalesce(outcome = 'answered' AND EXISTS (SELECT 1 FROM collapsed c JOIN sources s ON s.query_id = c.query_id AND s.document_id = c.document_id
      AND s.section IS NOT DISTINCT FROM c.section WHERE c.query_id = base.query_id AND s.relevant), false) AS cites_expected,
    list_filter([
      CASE WHEN errored THEN 'pipeline_error' END,
      CASE WHEN category IN ({_EXP}) AND (rank IS NULL OR rank > 5) AND (NOT errored OR observed) THEN 'retrieval_miss' END,
      CASE WHEN category IN ({_EXP}) AND outcome <> 'answered' THEN 'not_answered' END,
      CASE WHEN category IN ({_REF}) AND outcome = 'answered' THEN 'answered_unknown' END,
      CASE WHEN NOT errored AND unknown > 0 THEN 'invented_source_label' END,
      CASE WHEN leaked AND (NOT errored OR observed) THEN 'internal_passage_retrieved' END], lambda f: f IS NOT NULL) AS failures
  FROM base)"""


def record_sql(body: str) -> str:
    return sql(body, SQL_RECORDS)


@query(
    "score_answers",
    record_sql("SELECT query_id, outcome, cites_expected, published, array_to_string(list_sort(failures), ',') AS failures FROM records"),
)
def score_answers(spark, folder):
    """One record per question with its failure kinds."""
    return records(spark, folder).select(
        "query_id", "outcome", F.col("cites_expected_source").alias("cites_expected"), F.size("citations").alias("published"),
        F.array_join(F.array_sort("failures"), ",").alias("failures"),
    )


@query(
    "verified_citations",
    record_sql("SELECT query_id, published AS verified_citations, cites_expected AS cites_expected_source FROM records WHERE outcome IS NOT NULL"),
)
def verified_citations(spark, folder):
    done = records(spark, folder).filter(F.col("outcome").isNotNull())
    return done.select("query_id", "verified_citations", "cites_expected_source")


def _sql_gates() -> str:
    rows = [
        f"SELECT '{name}' AS gate, count(*) FILTER (list_has_any(failures, [{d.sql_list(kinds)}])) AS broken_by FROM records"
        for name, kinds in k.GATES.items()
    ]
    return record_sql("SELECT gate, broken_by = 0 AS passed, broken_by FROM (" + " UNION ALL ".join(rows) + ")")


@query("gates", _sql_gates())
def gates(spark, folder):
    return evaluation.gates(records(spark, folder))


@query("failure_counts", record_sql("SELECT failure, count(*) AS questions FROM (SELECT unnest(failures) AS failure FROM records) GROUP BY failure"))
def failure_counts(spark, folder):
    return evaluation.failure_counts(records(spark, folder))


@query("failure_index", record_sql("SELECT unnest(failures) AS failure, query_id FROM records"))
def failure_index(spark, folder):
    return evaluation.failure_index(records(spark, folder))


_CLASS_CASE = "CASE failure " + " ".join(f"WHEN '{f}' THEN '{c}'" for f, c in k.FAILURE_CLASSES.items()) + " END"


@query(
    "failure_classes",
    record_sql(f"SELECT {_CLASS_CASE} AS class, count(*) AS failures, count(DISTINCT query_id) AS questions FROM (SELECT unnest(failures) AS failure, query_id FROM records) GROUP BY 1"),
)
def failure_classes(spark, folder):
    return evaluation.failure_classes(records(spark, folder))


@query(
    "availability_metrics",
    record_sql(
        "SELECT CASE WHEN errored THEN CASE WHEN query_id % 5 <> 0 THEN 'unparseable_output' ELSE 'not_a_generation_failure' END END AS error_category, "
        "count(*) AS questions FROM records GROUP BY 1"
    ),
)
def availability_metrics(spark, folder):
    return evaluation.availability_metrics(records(spark, folder))


@query(
    "answer_metrics",
    record_sql(
        """SELECT count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (outcome = 'no_knowledge') AS no_knowledge,
          count(*) FILTER (outcome = 'not_grounded') AS not_grounded, count(*) FILTER (errored) AS error, count(*) FILTER (expects) AS answerable,
          count(*) FILTER (expects AND outcome = 'answered') AS answerable_answered,
          count(*) FILTER (expects AND outcome = 'answered' AND cites_expected) AS citing_expected FROM records"""
    ),
)
def answer_metrics(spark, folder):
    return evaluation.answer_metrics(records(spark, folder))


@query(
    "citation_metrics",
    record_sql(
        """SELECT sum(published)::BIGINT AS published, sum(published)::BIGINT AS valid, sum(CASE WHEN errored THEN 0 ELSE unknown END)::BIGINT AS invented_labels,
          count(*) FILTER (expects AND published = 0) AS answerable_without_citation FROM records"""
    ),
)
def citation_metrics(spark, folder):
    return evaluation.citation_metrics(records(spark, folder))


@query(
    "refusal_metrics",
    record_sql(
        """SELECT count(*) FILTER (refuses AND outcome IN ('no_knowledge', 'not_grounded')) AS controlled_refusals, count(*) FILTER (refuses) AS expected_refusals,
          count(*) FILTER (refuses AND NOT coalesce(outcome IN ('no_knowledge', 'not_grounded'), false)) AS not_refused FROM records"""
    ),
)
def refusal_metrics(spark, folder):
    return evaluation.refusal_metrics(records(spark, folder))


@query(
    "robustness_metrics",
    record_sql(
        """SELECT count(*) FILTER (errored) AS pipeline_errors, 0 AS empty_answers, 0 AS internal_label_leaks,
          count(*) FILTER (list_contains(failures, 'internal_passage_retrieved')) AS internal_passages_retrieved FROM records"""
    ),
)
def robustness_metrics(spark, folder):
    return evaluation.robustness_metrics(records(spark, folder))


@query(
    "latency_metrics",
    record_sql("SELECT round(median(duration_seconds), 3) AS median_seconds, round(max(duration_seconds), 3) AS max_seconds FROM records WHERE NOT errored"),
)
def latency_metrics(spark, folder):
    return evaluation.latency_metrics(records(spark, folder))


@query(
    "grounding_report",
    record_sql(
        """SELECT count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (outcome = 'no_knowledge') AS no_knowledge,
          count(*) FILTER (outcome = 'not_grounded') AS not_grounded,
          count(*) FILTER (expects AND outcome = 'answered' AND published > 0) AS answerable_correct, count(*) FILTER (expects) AS answerable,
          count(*) FILTER (refuses AND outcome <> 'answered' AND published = 0) AS refusals_correct, count(*) FILTER (refuses) AS must_refuse,
          arg_max(query_id, (duration_seconds, query_id)) AS slowest FROM records WHERE NOT errored"""
    ),
)
def grounding_report(spark, folder):
    return evaluation.grounding_report(records(spark, folder))


# --- failure policy and checker -------------------------------------------------------------------
KINDS = ("timeout", "unreachable", "rate_limited", "http_status", "malformed_response", "invalid_request")


@query(
    "failure_policy",
    """SELECT event_id, category, owner, transport_retry, recovery, category = 'output_truncated' OR coalesce(finish = 'length', false) AS larger_output FROM (
      SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'retryable_provider_error' WHEN 2 THEN 'provider_status' WHEN 3 THEN 'malformed_response'
        WHEN 4 THEN 'output_truncated' WHEN 5 THEN 'unparseable_output' ELSE 'unclassified' END AS category,
        CASE WHEN event_type = 'view' THEN 'length' WHEN event_type <> 'error' THEN 'stop' END AS finish FROM events)
    JOIN (VALUES ('timeout', 'infrastructure_adapter', 'bounded', false), ('retryable_provider_error', 'infrastructure_adapter', 'bounded', false),
      ('provider_status', 'infrastructure_adapter', 'none', false), ('malformed_response', 'infrastructure_adapter', 'none', true),
      ('output_truncated', 'rag_contract', 'none', true), ('unparseable_output', 'rag_contract', 'none', false),
      ('unclassified', 'rag_service_boundary', 'none', false)) p(category, owner, transport_retry, recovery) USING (category)""",
)
def failure_policy(spark, folder):
    events = d.table(spark, folder, "events")
    finish = F.when(F.col("event_type") == "view", "length").when(F.col("event_type") != "error", "stop")
    rows = events.select("event_id", d.pick(F.col("event_id"), tuple(k.FAILURE_POLICY)).alias("category"), finish.alias("finish_reason"))
    return answers.failure_policy(rows).drop("finish_reason")


@query(
    "failure_kinds",
    f"""SELECT event_id, CASE WHEN kind = 'timeout' THEN 'timeout' WHEN kind = 'malformed_response' THEN 'malformed_response'
        WHEN retryable OR kind = 'rate_limited' THEN 'retryable_provider_error' WHEN kind = 'http_status' THEN 'provider_status' ELSE 'unclassified' END AS category,
      retryable OR kind IN ('timeout', 'unreachable', 'rate_limited') OR status IN (408, 425, 429) OR status >= 500 AS transient
    FROM (SELECT event_id, {d.sql_pick('event_id', KINDS)} AS kind, event_type = 'purchase' AS retryable, 400 + user_id % 120 AS status FROM events)""",
)
def failure_kinds(spark, folder):
    """Category of a failed call, and whether a failed search may be repeated."""
    events = d.table(spark, folder, "events")
    rows = events.select(
        "event_id", d.pick(F.col("event_id"), KINDS).alias("kind"), (F.col("event_type") == "purchase").alias("retryable"),
        (F.lit(400) + F.col("user_id") % 120).alias("status"),
    )
    return rows.select(
        "event_id", answers.provider_failure_category(F.col("kind"), F.col("retryable")).alias("category"),
        answers.store_failure_transient(F.col("kind"), F.col("status"), F.col("retryable")).alias("transient"),
    )


CHECK_OUTCOMES = ("supported", "not_supported", "unusable", "error", "rate_limited")
PRICE = CostProfile("model-a", 31818, 68182)


def checker_tables(spark, folder):
    labels = d.table(spark, folder, "labels")
    cases = labels.select(
        F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "supported").otherwise("not_supported").alias("expected"),
        (F.col("toxic") == 0).alias("scored"),
    )
    docs = d.table(spark, folder, "documents").filter(F.col("doc_id") % 10 != 9)
    measured = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars"))
    verdicts = docs.select(
        F.col("doc_id").alias("case_id"), d.pick(F.col("doc_id"), CHECK_OUTCOMES).alias("outcome"),
        measured.alias("input_tokens"), (measured % 100).alias("output_tokens"),
        (F.col("n_chars") / 1000.0).alias("latency_seconds"),
    )
    return cases, verdicts


SQL_CHECKED = f"""checked AS (
  SELECT l.doc_id AS case_id, l.quality = 1 AS good, v.* FROM labels l LEFT JOIN (
    SELECT doc_id, {d.sql_pick('doc_id', CHECK_OUTCOMES)} AS outcome, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS ti,
      CASE WHEN doc_id % 3 <> 0 THEN n_chars % 100 END AS tout, n_chars / 1000.0::DOUBLE AS latency FROM documents WHERE doc_id % 10 <> 9) v
  ON v.doc_id = l.doc_id WHERE l.toxic = 0)"""


@query(
    "checker_score",
    f"""WITH {SQL_CHECKED} SELECT count(*) AS scored_cases, count(outcome) AS ran, count(*) FILTER (outcome = 'supported' AND good) AS correctly_accepted,
      count(*) FILTER (outcome <> 'supported' AND NOT good) AS correctly_rejected, count(*) FILTER (outcome = 'supported' AND NOT good) AS falsely_accepted,
      count(*) FILTER (outcome <> 'supported' AND good) AS falsely_rejected,
      round(count(*) FILTER (outcome IN ('supported', 'not_supported')) / nullif(count(*) FILTER (outcome IN ('supported', 'not_supported', 'unusable')), 0), 3) AS verdict_rate,
      count(*) FILTER (outcome IN ('unusable', 'error', 'rate_limited')) AS unusable_or_error, avg(ti) AS mean_input_tokens, avg(tout) AS mean_output_tokens,
      avg(latency) AS mean_latency_seconds, round(coalesce(sum((ti * 31818 + tout * 68182) / 1000000.0::DOUBLE), 0), 1) AS estimated_cost,
      count(*) FILTER (outcome = 'supported' AND NOT good) = 0 AND count(outcome) = count(*) AS safe FROM checked""",
)
def checker_score(spark, folder):
    return evaluation.checker_score(*checker_tables(spark, folder), profile=PRICE)


@query("false_accepts", f"WITH {SQL_CHECKED} SELECT case_id FROM checked WHERE outcome = 'supported' AND NOT good")
def false_accepts(spark, folder):
    return evaluation.false_accepts(*checker_tables(spark, folder))


@query(
    "variant_summary",
    """SELECT event_type AS variant, count(*) AS calls, count(*) FILTER (event_id % 9 = 0) AS failures, round(count(*) FILTER (event_id % 9 = 0) / count(*), 3) AS failure_rate,
      min(s) AS min_characters, round_even(median(s), 0)::DOUBLE AS median_characters, max(s) AS max_characters,
      round(min(v / s), 3) AS min_visible, round(median(v / s), 3) AS median_visible, round(max(v / s), 3) AS max_visible
    FROM (SELECT event_type, event_id, CASE WHEN event_id % 9 <> 3 THEN 1000 + user_id END AS s, CASE WHEN event_id % 9 <> 3 THEN event_id % 1000 END AS v FROM events) GROUP BY event_type""",
)
def variant_summary(spark, folder):
    return evaluation.variant_summary(variant_calls(spark, folder))


def variant_calls(spark, folder):
    seen = F.col("event_id") % 9 != 3
    return d.table(spark, folder, "events").select(
        F.col("event_type").alias("variant"), F.col("user_id").alias("query_id"),
        F.when(F.col("event_id") % 9 == 0, "unusable_reply").otherwise("parsed").alias("result"),
        F.when(seen, F.col("user_id") + 1000).alias("reply_characters"),
        F.when(seen, F.col("event_id") % 1000).alias("reply_visible_characters"),
    )


@query(
    "variant_failures",
    "SELECT event_type AS variant, user_id AS query_id, count(*) FILTER (event_id % 9 = 0) AS failures FROM events GROUP BY ALL",
)
def variant_failures(spark, folder):
    return evaluation.variant_failures(variant_calls(spark, folder))


@query("reply_characters", sql("SELECT query_id, length(regexp_replace(reply, '" + SQL_WS + "', '', 'g')) AS visible FROM replies"))
def reply_characters(spark, folder):
    rows = replies_table(spark, folder)
    return rows.select("query_id", replies.visible_characters(F.col("reply")).alias("visible"))



