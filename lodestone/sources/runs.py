"""Question sets, run exports and ledgers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import constants as k

CALL = (
    "struct<call_type:string,attempt:int,model:string,response_format:string,"
    "elapsed_seconds:double,result:string,max_output_tokens:bigint,finish_reason:string,"
    "input_tokens:bigint,output_tokens:bigint,http_attempts:int>"
)
SEGMENT = (
    "struct<segment:int,run_id:string,identity_sha256:string,status:string,stop_reason:string,"
    "completed_question_ids:array<string>,interrupted_question_ids:array<string>,"
    "calls:bigint,interrupted_calls:bigint,estimated_cost:double>"
)
RUN_SCHEMA = (
    "format string, passed boolean, "
    "run struct<run_id:string,logical_run_id:string,generated_at:string,project_version:string,"
    "git_revision:string,git_tag:string,git_dirty:boolean,release_source_identity:string,"
    "tier:string,rerun_of:string,selected_question_ids:array<string>,suite:string,"
    "suite_version:int,suite_sha256:string,question_count:int,complete:boolean,aborted:string,"
    "resume_count:int,planned_question_ids:array<string>,vector_store:string,"
    "query_representation_version:string,"
    "dataset:struct<path:string,sha256:string,version:int,question_count:int>,"
    "corpus:struct<sha256:string,documents:int,chunks:int>,"
    "embedding:struct<provider:string,model:string,dimensions:int,"
    "representation_version:string,identity:string>,"
    "retrieval_policy:struct<top_k:int,min_similarity:double,visibility:string>,"
    "generation:struct<provider:string,model:string,grounding_check_provider:string,"
    "grounding_check_model:string,prompt_version:string,grounding_check_version:string,"
    "response_format:string,grounding_check_response_format:string,max_prompt_tokens:int,"
    "output_reserve_tokens:int,max_output_tokens:int,recovery_output_tokens:int,"
    "generation_attempt_limit:int,grounding_check_attempt_limit:int,transport_attempts:int>,"
    f"execution_segments:array<{SEGMENT}>>, "
    "gates map<string,boolean>, failures map<string,array<string>>, "
    "metrics struct<answers:struct<outcomes:map<string,bigint>>,"
    "robustness:struct<pipeline_errors:int>>, "
    f"questions array<struct<id:string,category:string,outcome:string,failures:array<string>,provider_calls:array<{CALL}>>>, "
    "operations struct<observed:struct<calls:bigint,estimated_cost:double>>, "
    "release_acceptance struct<protocol:string,verdict:string>"
)
LEDGER_SCHEMA = (
    "date_utc string, run_id string, tier string, status string, calls bigint, "
    "input_tokens bigint, output_tokens bigint, estimated_cost double, usage_coverage double, "
    "artifact string, abort_reason string, smoke_passed boolean, commit_sha string, "
    "git_dirty boolean, rerun_of string, failed_gates array<string>, "
    "release_source_identity string, logical_run_id string, segment int"
)
QUESTION_SCHEMA = (
    "id string, category string, question string, "
    "expected_sources array<struct<document:string,section:string>>"
)
_BAD = "_bad"
APPENDED_AT, APPENDED_ROW = "appended_at", "appended_row"
LINE_NO = "struct<at:bigint,file:string,block:bigint,row:bigint>"


# --- questions --------------------------------------------------------------------
def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines or Parquet question sets; use yaml_questions for a YAML file."""
    reader = spark.read.schema(QUESTION_SCHEMA)
    return reader.parquet(path) if path.endswith(".parquet") else reader.json(path)


def yaml_questions(spark: SparkSession, path: str) -> DataFrame:
    """An authored YAML question set (a small file) with a top-level `questions` list."""
    import yaml

    from lodestone.sources.corpus import _strict_loader

    with open(path, encoding="utf-8") as handle:
        payload = yaml.load(handle, Loader=_strict_loader())
    if not isinstance(payload, dict) or not payload.get("questions"):
        raise ValueError("the question file must be a mapping with a `questions` list")
    rows = [
        (
            q["id"],
            q["category"],
            q["question"],
            [(s["document"], s.get("section")) for s in q.get("expected_sources") or []],
        )
        for q in payload["questions"]
    ]
    return spark.createDataFrame(rows, QUESTION_SCHEMA)


def question_problems(questions: DataFrame) -> DataFrame:
    """Ids that appear twice, unknown categories, empty questions."""
    categories = [*k.ANSWERABLE_CATEGORIES, *k.MUST_REFUSE_CATEGORIES, *k.OTHER_CATEGORIES]
    per_id = questions.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(~F.coalesce(F.col("category").isin(categories), F.lit(False))).alias("odd"),
        F.bool_or(F.coalesce(F.col("question"), F.lit("")) == "").alias("empty"),
    )
    problem = (
        F.when(F.col("n") > 1, "duplicate_id")
        .when(F.col("odd"), "unknown_category")
        .when(F.col("empty"), "empty_question")
    )
    return per_id.select("id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def expected_sources(questions: DataFrame) -> DataFrame:
    return questions.select(
        F.col("id").alias("query_id"), F.explode("expected_sources").alias("s")
    ).select("query_id", "s.document", "s.section")


# --- run exports --------------------------------------------------------------------
def read_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Run exports, one JSON document per file or, with *lines*, one per line; unreadable or other formats are left out.

    A file each costs the driver a listing and a commit, a line does not: pack many runs as lines.
    """
    runs = (
        spark.read.schema(f"{RUN_SCHEMA}, {_BAD} string")
        .option("multiLine", str(not lines).lower())
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    return runs.filter(F.col(_BAD).isNull() & (F.col("format") == k.RUN_FORMAT)).drop(_BAD)


def parse_runs(texts: DataFrame) -> DataFrame:
    """The same from a column *json* of run documents."""
    parsed = texts.select(F.from_json("json", RUN_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("r.*").filter(F.col("format") == k.RUN_FORMAT)


def run_calls(runs: DataFrame) -> DataFrame:
    """One row per provider call that names its type, attempt, model and result."""
    calls = runs.select(
        F.col("run.run_id").alias("run_id"), F.inline("questions")
    ).select("run_id", F.col("id").alias("query_id"), F.inline("provider_calls"))
    known = (
        F.col("call_type").isin("generation", "grounding_check")
        & F.col("result").isin("parsed", "unusable_reply", "provider_error")
        & F.col("attempt").isNotNull()
        & F.col("model").isNotNull()
        & F.col("elapsed_seconds").isNotNull()
    )
    return calls.filter(known)


# --- ledgers ------------------------------------------------------------------------
def _parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    parsed = lines.filter(F.trim("line") != "").select(
        "line_no", F.from_json("line", f"{schema}, {_BAD} string", options).alias("r")
    )
    required = ("date_utc", "run_id", "tier", "status")
    incomplete = F.lit(False)
    for name in required:
        incomplete = incomplete | F.col(name).isNull()
    rows = parsed.select("line_no", "r.*")
    return rows.withColumn("damaged", F.col(_BAD).isNotNull() | incomplete).drop(_BAD)


def parse_ledger(lines: DataFrame) -> DataFrame:
    """lines(line_no, line) -> ledger rows; *damaged* marks lines that are not an entry."""
    return _parse_lines(lines, LEDGER_SCHEMA)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger folder or file of JSON Lines. A missing ledger is an empty one.

    line_no is a struct that compares in append order: the time and row number that
    append_ledger wrote. Lines of another writer have neither; they follow the time and
    the name of their file and the place in it, which no packing of files into tasks changes.
    """
    try:
        text = spark.read.text(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        empty = spark.createDataFrame([], f"line_no {LINE_NO}, line string")
        return parse_ledger(empty)
    file = F.col("_metadata")
    placed = text.select(
        F.struct(
            F.unix_micros(file["file_modification_time"]).alias("at"),
            file["file_path"].alias("file"),
            file["file_block_start"].alias("block"),
            # Rows of one block are read in order by one task.
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        F.col("value").alias("line"),
    )
    rows = _parse_lines(placed, f"{LEDGER_SCHEMA}, {APPENDED_AT} bigint, {APPENDED_ROW} bigint")
    written = F.struct(
        F.col(APPENDED_AT).alias("at"),
        F.lit("").alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.col(APPENDED_ROW).alias("row"),
    )
    known = F.col(APPENDED_AT).isNotNull() & F.col(APPENDED_ROW).isNotNull()
    order = F.when(known, written).otherwise(F.col("line_no")).cast(LINE_NO)
    return rows.withColumn("line_no", order).drop(APPENDED_AT, APPENDED_ROW)


def append_ledger(entries: DataFrame, path: str) -> None:
    """Append *entries* in the order of the frame; each row carries its place in the ledger.

    The time is the driver's and grows from call to call of one writer.
    """
    now = F.lit(time.time_ns() // 1000).cast("bigint")
    numbered = entries.withColumns({APPENDED_AT: now, APPENDED_ROW: F.monotonically_increasing_id()})
    numbered.write.mode("append").json(path)


def ledger_health(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count_if(~F.col("damaged")).alias("entries"),
        F.count_if("damaged").alias("unreadable_lines"),
    )


# --- exports ------------------------------------------------------------------------
def retrieval_export(questions: DataFrame, scores: DataFrame, hits: DataFrame, outcome: DataFrame) -> DataFrame:
    """One nested row per question: facts, outcome counts and its hits in order.

    hits(query_id, position, id, document_id, heading_path, score, relevant) hold at most
    top_k rows per question.
    """
    from lodestone.functions.text import innermost
    from lodestone.operators.evaluation import expects_answer

    hit = F.struct(
        F.col("position").alias("rank"),
        F.col("id").alias("chunk_id"),
        "document_id",
        innermost(F.col("heading_path")).alias("section"),
        "heading_path",
        F.col("score").alias("similarity"),
        "relevant",
    )
    nested = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    counts = outcome.select(
        "query_id",
        F.struct(*[c for c in outcome.columns if c != "query_id"]).alias("retrieval"),
    )
    return (
        questions.join(scores.select("query_id", "first_relevant_rank"), "query_id", "left")
        .join(counts, "query_id", "left")
        .join(nested, "query_id", "left")
        .withColumn("expects_an_answer", expects_answer(F.col("category")))
    )


def nan_rows(export: DataFrame) -> DataFrame:
    """Questions with a similarity that is not a number; an export with any is refused."""
    return export.filter(F.exists("hits", lambda h: F.isnan(h["similarity"]))).select("query_id")


def write_export(export: DataFrame, path: str) -> None:
    """Write an export as JSON Lines; a NaN anywhere refuses the write."""
    if "hits" in export.columns:
        bad = nan_rows(export).limit(1).collect()
        if bad:
            raise ValueError(f"question {bad[0].query_id} has a similarity that is not a number")
    export.write.mode("overwrite").json(path)


def answer_export(retrieval: DataFrame, records: DataFrame, calls: DataFrame) -> DataFrame:
    """End-to-end rows: the retrieval row plus outcome, answer, citations and calls.

    A question has a handful of provider calls, so its list is short.
    """
    call = F.struct(*[c for c in calls.columns if c not in ("run_id", "query_id")])
    nested = calls.groupBy("query_id").agg(
        F.sort_array(F.collect_list(call)).alias("provider_calls")
    )
    answer = records.select(
        "query_id", F.coalesce("outcome", F.lit("error")).alias("outcome"), "answer",
        F.transform(
            "citations",
            lambda c: F.struct(c["document_id"].alias("document_id"), c["section"].alias("section")),
        ).alias("published"),
        "verified_citations", "cites_expected_source", "unknown_labels", "failures",
    )
    return retrieval.join(answer, "query_id", "left").join(nested, "query_id", "left")
