"""Audit queries: every user of the events table is one evaluation run.

The run's questions are the user's events. What is wrong with a run follows from the
user id: nothing, failures, false gates, a dirty tree, a wrong count, misnumbered
segments, missing provenance, an unfinished run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.catalog import cost_queries
from lodestone.catalog import derived as d
from lodestone.operators import audit, generation, identity
from lodestone.operators import segment_order as segment_order_rules
from lodestone.session import shared_folder
from lodestone.sources import runs
from lodestone.streaming.run_guard import GuardSettings, run_guard

QUERIES, ORACLE = {}, {}
FLAWS = ("none", "failures", "false_gates", "dirty", "count", "numbers", "provenance", "unfinished")
COMMIT = "0123456789abcdef0123456789abcdef01234567"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def run_documents(spark, folder):
    """run_no, json: one export document per user."""
    events = d.table(spark, folder, "events")
    flawed = d.pick(F.col("user_id"), FLAWS).isin("failures", "false_gates")
    error = flawed & (F.col("event_type") == "error")
    loose = flawed & (F.col("event_type") == "purchase") & (F.col("event_id") % 50 == 0)
    outcome = (
        F.when(error, "error").when(F.col("event_type") == "view", "not_grounded")
        .when(F.col("event_type") == "click", "no_knowledge").otherwise("answered")
    )
    failures = F.filter(
        F.array(F.when(error, "pipeline_error"), F.when(loose, "unverified_citation")), lambda f: f.isNotNull()
    )
    call = F.struct(
        F.lit("generation").alias("call_type"), F.lit(1).alias("attempt"), F.lit("model-a").alias("model"),
        F.col("value").alias("elapsed_seconds"), F.lit("parsed").alias("result"),
    )
    question = F.struct(
        F.col("event_id").alias("n"), F.concat(F.lit("q-"), F.col("event_id").cast("string")).alias("id"),
        outcome.alias("outcome"), failures.alias("failures"), F.array(call).alias("provider_calls"),
    )
    grouped = events.groupBy(F.col("user_id").alias("run_no")).agg(
        F.sort_array(F.collect_list(question)).alias("qs")
    )
    flaw = d.pick(F.col("run_no"), FLAWS)
    ids = F.transform("qs", lambda q: q["id"])
    count = F.size("qs")
    half = (count / 2).cast("int")
    done = flaw != "unfinished"
    name = F.concat(F.lit("run-"), F.col("run_no").cast("string"))
    broken = F.flatten(F.transform("qs", lambda q: q["failures"]))

    def segment(number, completed, status, reason):
        return F.struct(
            number.alias("segment"), name.alias("run_id"), F.lit(None).cast("string").alias("identity_sha256"),
            status.alias("status"), reason.alias("stop_reason"), completed.alias("completed_question_ids"),
            F.array().cast("array<string>").alias("interrupted_question_ids"),
            F.size(completed).alias("calls"), F.lit(0).alias("interrupted_calls"), F.lit(1.5).alias("estimated_cost"),
        )

    segments = F.array(
        segment(F.lit(1), F.slice(ids, F.lit(1), half), F.lit("paused"), F.lit("rate_limited")),
        segment(
            F.when(flaw == "numbers", 3).otherwise(2), F.slice(ids, half + 1, count),
            F.when(done, "complete").otherwise("paused"), F.when(~done, "rate_limited"),
        ),
    )

    def text(**values):
        return F.struct(*[(v if not isinstance(v, (str, int, float)) else F.lit(v)).alias(n) for n, v in values.items()])

    run = text(
        run_id=name, logical_run_id=name, generated_at="2026-01-15T10:00:00", project_version="1.2.0",
        git_revision=COMMIT, git_tag="v1.2.0", git_dirty=flaw == "dirty", release_source_identity="source-1",
        tier="acceptance", suite="release", suite_version=1, suite_sha256="5" * 64,
        question_count=count + F.when(flaw == "count", 1).otherwise(0), complete=done,
        aborted=F.when(~done, "rate_limited"), resume_count=1, planned_question_ids=ids, vector_store="table",
        dataset=text(path="questions", sha256="6" * 64, version=1, question_count=count + 1),
        corpus=F.struct(F.when(flaw != "provenance", "7" * 64).alias("sha256"), F.lit(12).alias("documents")),
        embedding=text(provider="tables", model="given", dimensions=64, identity="tables:given:64:embedding-text-v1"),
        retrieval_policy=text(top_k=7, min_similarity=0.25, visibility="public"),
        generation=text(
            provider="local", model="model-a", prompt_version="p1", grounding_check_version="g1", response_format="json_object",
            max_prompt_tokens=6000, output_reserve_tokens=800, max_output_tokens=800, generation_attempt_limit=2,
        ),
        execution_segments=segments,
    )
    truthful = flaw != "false_gates"
    gates = F.struct(
        *[
            (~truthful | ~F.arrays_overlap(broken, F.array(*[F.lit(x) for x in kinds]))).alias(gate)
            for gate, kinds in k.GATES.items()
        ]
    )

    def having(field, value):
        if field == "failures":
            return F.filter("qs", lambda q: F.array_contains(q[field], value))
        return F.filter("qs", lambda q: q[field] == value)

    errors = having("outcome", "error")
    outcomes = F.struct(
        *[
            F.size(having("outcome", o)).alias(o)
            for o in ("answered", "no_knowledge", "not_grounded", "error")
        ]
    )
    index = F.struct(
        *[
            F.transform(having("failures", f), lambda q: q["id"]).alias(f)
            for f in ("pipeline_error", "unverified_citation")
        ]
    )
    document = F.struct(
        F.when(F.col("run_no") % 29 == 28, "other-format").otherwise(k.RUN_FORMAT).alias("format"),
        (done & (~truthful | (F.size(broken) == 0))).alias("passed"),
        run.alias("run"), gates.alias("gates"), index.alias("failures"),
        F.struct(F.struct(outcomes.alias("outcomes")).alias("answers"), F.struct(F.size(errors).alias("pipeline_errors")).alias("robustness")).alias("metrics"),
        F.transform(
            "qs", lambda q: F.struct(*[q[c].alias(c) for c in ("id", "outcome", "failures", "provider_calls")])
        ).alias("questions"),
        F.struct(F.struct(count.alias("calls"), F.lit(3.0).alias("estimated_cost")).alias("observed")).alias("operations"),
    )
    return grouped.select("run_no", F.to_json(document).alias("json"))


def read_runs(spark, folder):
    """A6 over documents; segments then get the identity their run states."""
    read = runs.parse_runs(run_documents(spark, folder))
    named = identity.run_identity(read.withColumn("_planned", F.col("run.planned_question_ids")), "run", "_planned")
    stamped = F.transform(
        "run.execution_segments", lambda s: s.withField("identity_sha256", F.col("identity_sha256"))
    )
    return named.withColumn("run", F.col("run").withField("execution_segments", stamped)).drop(
        "_planned", "identity", "identity_sha256"
    )


SQL_RUNS = f"""flawed AS (
  SELECT user_id AS run_no, 'run-' || user_id AS run_id, {d.sql_pick('user_id', FLAWS)} AS flaw, event_id, event_type FROM events WHERE user_id % 29 <> 28),
facts AS (
  SELECT run_no, run_id, any_value(flaw) AS flaw, count(*) AS n, count(*) FILTER (flaw IN ('failures', 'false_gates') AND event_type = 'error') AS errors,
    count(*) FILTER (flaw IN ('failures', 'false_gates') AND event_type = 'purchase' AND event_id % 50 = 0) AS loose FROM flawed GROUP BY run_no, run_id)"""


def sql(body: str) -> str:
    return "WITH " + SQL_RUNS + "\n" + body


@query("read_runs", sql("SELECT run_id, n AS questions, flaw <> 'unfinished' AS complete FROM facts"))
def read_runs_query(spark, folder):
    return read_runs(spark, folder).select("run.run_id", F.size("questions").alias("questions"), "run.complete")


@query("run_calls", sql("SELECT run_id, 'q-' || event_id AS query_id FROM flawed"))
def run_calls(spark, folder):
    return runs.run_calls(runs.parse_runs(run_documents(spark, folder))).select("run_id", "query_id")


@query(
    "acceptance_verdict",
    sql(
        """SELECT run_id, CASE WHEN flaw = 'none' OR (flaw IN ('failures', 'false_gates') AND errors + loose = 0) THEN 'PASS' ELSE 'FAIL' END AS verdict,
          CASE flaw WHEN 'none' THEN '' WHEN 'dirty' THEN 'the working tree was not clean (or its state is unknown)'
            WHEN 'count' THEN 'the recorded questions do not match the question count'
            WHEN 'numbers' THEN 'the execution segments are missing or contradict the artifact'
            WHEN 'provenance' THEN 'provenance is incomplete; missing provenance: corpus.sha256'
            WHEN 'unfinished' THEN 'the run is not complete; the run was aborted'
            ELSE array_to_string(list_filter([CASE WHEN errors + loose > 0 THEN 'an acceptance gate failed' END, CASE WHEN errors > 0 THEN 'gate no_pipeline_errors FAIL' END,
              CASE WHEN loose > 0 THEN 'gate citations_verified FAIL' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM facts"""
    ),
)
def acceptance_verdict(spark, folder):
    judged = audit.acceptance_verdict(read_runs(spark, folder))
    return judged.select("run.run_id", "verdict", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "artifact_consistency",
    sql(
        """SELECT run_id, CASE WHEN flaw = 'count' THEN 'the question count does not match the recorded questions'
          WHEN flaw = 'false_gates' AND errors + loose > 0 THEN 'the stored gates do not match the questions'' recorded failures; `passed` does not match the gates and the run status'
          ELSE '' END AS problems FROM facts"""
    ),
)
def artifact_consistency(spark, folder):
    checked = audit.artifact_consistency(read_runs(spark, folder))
    return checked.select("run.run_id", F.array_join("problems", "; ").alias("problems"))


@query(
    "segment_audit",
    sql("SELECT run_id, CASE WHEN flaw = 'numbers' THEN 'the execution segments are not numbered 1..n' ELSE '' END AS problems FROM facts"),
)
def segment_audit(spark, folder):
    checked = audit.segment_problems(read_runs(spark, folder))
    return checked.select("run.run_id", F.array_join("segment_problems", "; ").alias("problems"))


@query(
    "identity_mismatches",
    sql("SELECT run_id, CASE flaw WHEN 'dirty' THEN 'git_dirty' WHEN 'provenance' THEN 'corpus.sha256' END AS field FROM facts WHERE flaw IN ('dirty', 'provenance')"),
)
def identity_mismatches(spark, folder):
    """Stored identities against the same runs without their flaws."""
    read = runs.parse_runs(run_documents(spark, folder)).withColumn("run_id", F.col("run.run_id"))
    stored = identity.run_identity(read.withColumn("ids", F.col("run.planned_question_ids")), "run", "ids")
    mended = read.withColumn(
        "run",
        F.col("run").withField("git_dirty", F.lit(False)).withField("corpus.sha256", F.lit("7" * 64)),
    )
    current = identity.run_identity(mended.withColumn("ids", F.col("run.planned_question_ids")), "run", "ids")
    return identity.identity_mismatches(stored, current, "run_id").select("run_id", "field")


@query(
    "comparable_runs",
    sql("SELECT run_id, 2 AS notes FROM facts"),
)
def comparable_runs(spark, folder):
    """Same provider and model; the prompt changed and one version is not recorded."""
    wanted = {
        "generation.provider": "local", "generation.model": "model-a", "generation.prompt_version": "p2",
        "retrieval_policy.top_k": 7, "generation.grounding_check_model": "model-a",
    }
    found = audit.comparable_runs(
        runs.parse_runs(run_documents(spark, folder)), wanted, ("generation.provider", "generation.model"),
        {"generation.prompt_version": "prompt version", "retrieval_policy.top_k": "top_k", "generation.grounding_check_model": "checker"},
    )
    return found.select("run.run_id", F.size("notes").alias("notes"))


@query(
    "comparable_runs_changed",
    sql(
        """SELECT run_id, array_to_string(list_filter([
            CASE n % 3 WHEN 0 THEN run_id || ' ran with prompt version p1, now p2' WHEN 2 THEN run_id || ' does not record its prompt version' END,
            CASE WHEN n % 5 = 0 THEN run_id || ' ran with top_k 9, now 7' END], lambda x: x IS NOT NULL), '; ') AS notes
          FROM (SELECT run_id, substr(run_id, 5)::BIGINT AS n FROM facts) WHERE n % 4 <> 2"""
    ),
)
def comparable_runs_changed(spark, folder):
    """Models, prompts and top_k that differ by run number; the texts of the notes."""
    run, n = F.col("run"), F.substring("run.run_id", 5, 20).cast("long")
    model, top = run["generation"]["model"], run["retrieval_policy"]["top_k"]
    prompt = F.when(n % 3 == 0, "p1").when(n % 3 == 1, "p2")
    read = runs.parse_runs(run_documents(spark, folder)).withColumn(
        "run",
        run.withField("generation.model", F.when(n % 4 == 2, "model-b").otherwise(model))
        .withField("generation.prompt_version", prompt)
        .withField("retrieval_policy.top_k", F.when(n % 5 == 0, F.lit(9).cast("int")).otherwise(top)),
    )
    wanted = {"generation.model": "model-a", "generation.prompt_version": "p2", "retrieval_policy.top_k": 7}
    soft = {"generation.prompt_version": "prompt version", "retrieval_policy.top_k": "top_k"}
    found = audit.comparable_runs(read, wanted, ("generation.model",), soft)
    return found.select("run.run_id", F.array_join("notes", "; ").alias("notes"))


# --- records of runs ------------------------------------------------------------------
SMOKE = ("unclassified", "provider_status", "timeout")


@query(
    "smoke_verdict",
    """SELECT run_id, refused + (errored >= 2)::INT + unsafe = 0 AS passed,
      CASE WHEN refused + (errored >= 2)::INT + unsafe > 0 THEN refused + (errored >= 2)::INT + unsafe ELSE notes END AS reasons FROM (
      SELECT user_id AS run_id, count(*) FILTER (event_id % 40 = 0) AS errored, count(*) FILTER (event_id % 40 = 0 AND event_id % 3 <> 2) AS refused,
        count(*) FILTER (event_id % 40 = 0 AND event_id % 3 = 2) AS notes, (count(*) FILTER (event_id % 211 = 0) > 0)::INT AS unsafe FROM events GROUP BY user_id)""",
)
def smoke_verdict(spark, folder):
    judged = audit.smoke_verdict(smoke_records(spark, folder))
    return judged.select("run_id", "passed", F.size("reasons").alias("reasons"))


def smoke_records(spark, folder):
    events = d.table(spark, folder, "events")
    return events.select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("q-"), F.col("event_id").cast("string")).alias("query_id"),
        F.when(F.col("event_id") % 40 == 0, d.pick(F.col("event_id"), SMOKE)).alias("error_category"),
        F.when(F.col("event_id") % 211 == 0, F.array(F.lit("internal_label_leak"))).otherwise(F.array().cast("array<string>")).alias("failures"),
        F.lit(None).cast("string").alias("aborted"),
    )


@query(
    "smoke_reasons",
    """WITH r AS (SELECT user_id AS run_id, event_id, 'q-' || event_id AS q, event_id % 40 = 0 AS bad FROM events)
    SELECT run_id, 'refused' AS kind, q AS query_id, q || CASE event_id % 3 WHEN 0 THEN ': unclassified provider failure'
      ELSE ': provider refused the request' END AS reason FROM r WHERE bad AND event_id % 3 <> 2
    UNION ALL SELECT run_id, 'note', q, q || ': timeout (classified)' FROM r WHERE bad AND event_id % 3 = 2
    UNION ALL SELECT run_id, 'safety', q, 'safety: ' || q FROM r WHERE event_id % 211 = 0
    UNION ALL SELECT run_id, 'technical', NULL, count(*) FILTER (bad) || ' of ' || count(*) || ' questions failed technically'
      FROM r GROUP BY run_id HAVING count(*) FILTER (bad) >= 2""",
)
def smoke_reasons(spark, folder):
    """F36 as rows, with their texts."""
    return audit.smoke_reasons(smoke_records(spark, folder)).select("run_id", "kind", "query_id", "reason")


@query(
    "segment_order",
    """WITH base AS (SELECT o_custkey AS run_id, 'q-' || o_orderkey AS q, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY o_custkey) AS n
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
      ends AS (SELECT run_id, n, run_id % 8 AS flaw, min(q) FILTER (place = 0) AS head, min(q) FILTER (place = n - 1) AS tail FROM base GROUP BY ALL)
    SELECT run_id, 'recorded_out_of_plan' AS kind, n - n % 2 AS n, 0 AS first_at, tail AS first_question FROM ends WHERE flaw = 1 AND n > 1
    UNION ALL SELECT run_id, 'completed_out_of_order', n - n % 2, 0, head FROM ends WHERE flaw = 1 AND n > 1
    UNION ALL SELECT run_id, 'planned_not_recorded', 1, n - 1, tail FROM ends WHERE flaw = 2
    UNION ALL SELECT run_id, 'completed_twice', 1, 1000, head FROM ends WHERE flaw = 3
    UNION ALL SELECT run_id, 'completed_out_of_order', 1, n, head FROM ends WHERE flaw = 3
    UNION ALL SELECT run_id, 'interrupted_after_completion', 1, 2, head FROM ends WHERE flaw = 4
    UNION ALL SELECT run_id, 'never_asked_again', 1, 1, 'x' || head FROM ends WHERE flaw = 5""",
)
def segment_order(spark, folder):
    """F34 on rows: a customer is a run, orders are its questions, four to a segment; flaws by the customer's key."""
    orders = d.table(spark, folder, "orders")
    keys = Window.partitionBy("o_custkey")
    base = orders.select(
        F.col("o_custkey").alias("run_id"), F.concat(F.lit("q-"), F.col("o_orderkey").cast("string")).alias("question_id"),
        (F.row_number().over(keys.orderBy("o_orderkey")) - 1).alias("place"), F.count(F.lit(1)).over(keys).alias("n"),
    ).withColumn("flaw", F.col("run_id") % 8)
    names = ["run_id", "place", "question_id"]
    lost = F.when(F.col("flaw") == 2, 1).when(F.col("flaw") == 7, 2).otherwise(0)
    asked = base.filter(F.col("place") < F.col("n") - lost)
    turned = F.when(F.col("flaw") == 1, F.col("n") - 1 - F.col("place")).otherwise(F.col("place"))
    in_segment = asked.select(
        "run_id", (F.floor(F.col("place") / 4) + 1).alias("segment"), (F.col("place") % 4).alias("place"), "question_id"
    )
    head = base.filter("place = 0")
    again = head.filter("flaw = 3").select("run_id", F.lit(1000).alias("segment"), "place", "question_id")
    cut = [
        head.filter("flaw = 4").select("run_id", F.lit(2).alias("segment"), "question_id"),
        head.filter("flaw = 5").select("run_id", F.lit(1).alias("segment"), F.concat(F.lit("x"), "question_id").alias("question_id")),
        base.filter("flaw = 6 AND place = n - 1").select("run_id", F.floor(F.col("place") / 4).alias("segment"), "question_id"),
    ]
    found = segment_order_rules.order_findings(
        runs=head.select("run_id", (F.col("flaw") != 7).alias("complete")),
        recorded=asked.withColumn("place", turned).select(names), planned=base.select(names),
        completed=in_segment.unionByName(again), interrupted=cut[0].unionByName(cut[1]).unionByName(cut[2]),
    )
    return segment_order_rules.order_summary(found)


@query(
    "segment_usage",
    """SELECT user_id AS run_id, day(ts) // 10 AS segment, count(*) FILTER (event_type <> 'click') AS calls,
      count(*) FILTER (event_type <> 'click' AND event_id % 13 = 0) AS interrupted_calls,
      coalesce(sum(t) FILTER (event_type NOT IN ('click', 'error')), 0)::BIGINT AS input_tokens, coalesce(sum(2 * t) FILTER (event_type NOT IN ('click', 'error')), 0)::BIGINT AS output_tokens,
      count(*) FILTER (event_type NOT IN ('click', 'error')) AS usage_reported,
      round(count(*) FILTER (event_type NOT IN ('click', 'error')) / nullif(count(*) FILTER (event_type <> 'click'), 0), 3) AS usage_coverage
    FROM (SELECT *, (props->>'$.k')::BIGINT AS t FROM events) GROUP BY ALL""",
)
def segment_usage(spark, folder):
    events = d.table(spark, folder, "events")
    tokens = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("bigint"))
    call = F.struct(tokens.alias("input_tokens"), (tokens * 2).alias("output_tokens"), F.col("value").alias("cost"))
    records = events.select(
        F.col("user_id").alias("run_id"), F.floor(F.dayofmonth("ts") / 10).alias("segment"),
        (F.col("event_id") % 13 == 0).alias("interrupted"),
        F.when(F.col("event_type") != "click", F.array(call)).alias("provider_calls"),
    )
    return audit.segment_usage(records).drop("estimated_cost")


@query(
    "rate_limit_events",
    "SELECT event_id FROM events WHERE event_type = 'error' AND (event_id % 5 = 0 OR event_id % 7 = 0)",
)
def rate_limit_events(spark, folder):
    events = d.table(spark, folder, "events")
    failed = F.col("event_type") == "error"
    records = events.select(
        "event_id", F.when(failed & (F.col("event_id") % 5 == 0), 429).alias("status_code"),
        F.when(failed & (F.col("event_id") % 7 == 0), "rate_limited").alias("failure_detail"),
    )
    return audit.rate_limit_events(records).select("event_id")


# --- ledgers ------------------------------------------------------------------------------
@query(
    "latest_segment",
    """SELECT 'logical-' || user_id AS attempt_id, max(event_id) AS line_no, arg_max(event_type = 'error', event_id) AS aborted
      FROM events WHERE event_id % 97 NOT IN (1, 2, 3) GROUP BY user_id""",
)
def latest_segment(spark, folder):
    rows = cost_queries.read_lines(spark, folder).filter(~F.col("damaged"))
    found = audit.latest_segment(rows)
    return found.select("attempt_id", "line_no", (F.col("status") == "aborted").alias("aborted"))


@query(
    "append_ledger",
    """SELECT 'logical-' || user_id AS attempt_id, 'run-' || max(event_id) AS run_id, arg_max(event_type = 'error', event_id) AS aborted
      FROM events WHERE event_id % 97 NOT IN (1, 2, 3) GROUP BY user_id""",
)
def append_ledger(spark, folder):
    """Events appended in three calls of unequal size, read back, the last line of each run."""
    rows = cost_queries.read_lines(spark, folder).filter(~F.col("damaged")).drop("damaged")
    last = rows.agg(F.max("line_no")).first()[0] or 0
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    bounds = [-1, last * 7 // 10, last * 19 // 20, last]
    for low, high in zip(bounds, bounds[1:]):
        part = rows.filter((F.col("line_no") > low) & (F.col("line_no") <= high))
        runs.append_ledger(part.orderBy("line_no").drop("line_no"), path)
    found = audit.latest_segment(runs.read_ledger(spark, path))
    return found.select("attempt_id", "run_id", (F.col("status") == "aborted").alias("aborted"))


@query(
    "rerun_check",
    """SELECT attempt_id, CASE WHEN n = 1 THEN CASE WHEN rerun_of IS NOT NULL THEN 'no earlier run has that id' END
        WHEN rerun_of IS NULL THEN 'the candidate already has an acceptance run' WHEN n > 2 THEN 'the one permitted rerun is used'
        WHEN rerun_of <> first_id THEN 'no earlier run has that id' WHEN first_ok THEN 'a passing run is not rerun'
        WHEN NOT first_outlier THEN 'that run did not fail on provider availability alone' END AS reason FROM (
      SELECT *, row_number() OVER w AS n, first_value(attempt_id) OVER w AS first_id, first_value(ok) OVER w AS first_ok, first_value(outlier) OVER w AS first_outlier FROM (
        SELECT event_id AS attempt_id, user_id AS candidate, CASE event_type WHEN 'view' THEN first_event WHEN 'error' THEN -1 END AS rerun_of,
          event_id % 4 = 0 AS ok, event_id % 4 = 1 AS outlier FROM (
          SELECT *, min(event_id) FILTER (event_id % 6 <> 0) OVER (PARTITION BY user_id) AS first_event FROM events) WHERE event_id % 6 <> 0)
      WINDOW w AS (PARTITION BY candidate ORDER BY attempt_id))""",
)
def rerun_check(spark, folder):
    """Every event is an attempt of its user's release candidate; every sixth ran on a dirty tree."""
    events = d.table(spark, folder, "events")
    clean = events.filter(F.col("event_id") % 6 != 0)
    first = clean.groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    way = F.col("event_id") % 4
    attempts = events.join(first, "user_id").select(
        F.col("event_id").alias("attempt_id"), F.col("event_id").alias("line_no"), F.col("user_id").alias("candidate"),
        (F.col("event_id") % 6 == 0).alias("git_dirty"), F.lit(COMMIT).alias("commit_sha"),
        F.when(F.col("event_type") == "view", F.col("first_event")).when(F.col("event_type") == "error", -1).alias("rerun_of"),
        F.when(way == 1, "aborted").otherwise("complete").alias("status"),
        F.when(way == 1, "rate_limited").alias("abort_reason"),
        F.when(way == 0, F.array().cast("array<string>")).when(way == 1, F.array(F.lit("no_pipeline_errors")))
        .otherwise(F.array(F.lit("citations_verified"))).alias("failed_gates"),
    )
    return audit.rerun_check(attempts).select("attempt_id", "reason")


@query(
    "stale_checkpoints",
    """SELECT user_id AS logical_run_id, s AS segment, CASE WHEN user_id % 4 = 1 AND s = 3 THEN 'the ledger knows a later segment'
        ELSE 'the ledger recorded this segment closed; the checkpoint is older' END AS problem
      FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([1, 2, 3]) AS s)
      WHERE (user_id % 4 = 1 AND s = 3) OR (user_id % 4 = 2 AND s = 2) OR (user_id % 4 = 3 AND s = 1)""",
)
def stale_checkpoints(spark, folder):
    """Of every fourth run the ledger is ahead, differs, or saw a running segment closed."""
    users = d.table(spark, folder, "events").select(F.col("user_id").alias("logical_run_id")).distinct()
    three = users.select("logical_run_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("segment"))
    kind = F.col("logical_run_id") % 4
    run = F.concat(F.lit("run-"), F.col("segment").cast("string"))
    ledger = three.withColumn("run_id", run)
    stored = three.filter(~((kind == 1) & (F.col("segment") == 3))).select(
        "logical_run_id", "segment",
        F.when((kind == 2) & (F.col("segment") == 2), "another").otherwise(run).alias("run_id"),
        F.when((kind == 3) & (F.col("segment") == 1), "running").otherwise("paused").alias("status"),
    )
    return audit.stale_checkpoints(stored, ledger)


SQL_SHAPED = " OR ".join("regexp_matches(html, '" + p.replace("'", "''") + "')" for p in k.SECRET_SHAPES)


@query(
    "publication_scan",
    f"""SELECT page_id AS artifact_id, f.path AS path, f.problem AS problem FROM (
      SELECT page_id, unnest([
        CASE WHEN page_id % 6 = 0 THEN {{'path': 'run.Token', 'problem': 'forbidden field `Token`'}} END,
        CASE WHEN page_id % 6 = 1 THEN {{'path': 'questions.1.note', 'problem': 'credential-shaped value'}} END,
        CASE WHEN page_id % 6 = 2 THEN {{'path': 'questions.0.answer', 'problem': 'an internal context marker in the answer'}} END,
        CASE WHEN page_id % 6 = 3 THEN {{'path': 'questions.1.note', 'problem': 'a configured credential'}} END,
        CASE WHEN page_id % 6 = 4 THEN {{'path': 'page.html', 'problem': 'a configured credential'}} END,
        CASE WHEN {SQL_SHAPED} THEN {{'path': 'page.html', 'problem': 'credential-shaped value'}} END]) AS f FROM pages)
    WHERE f IS NOT NULL""",
)
def publication_scan(spark, folder):
    """J13 over one artifact per web page with its whole html; the page's address is its note."""
    pages = d.table(spark, folder, "pages")
    kind = F.col("page_id") % 6
    note = (
        F.when(kind == 1, F.concat("url", F.lit(" Bearer abcdefgh12345")))
        .when(kind == 3, F.concat("url", F.lit(" hunter2-hunter2")))
        .otherwise(F.col("url"))
    )
    answer = F.concat("url", F.when(kind == 2, " [S1]").otherwise(""))
    html = F.concat("html", F.when(kind == 4, "hunter2-hunter2").otherwise(""))
    document = F.concat(
        F.lit('{"run": {'), F.when(kind == 0, '"Token": 1, ').otherwise(""), F.lit('"tier": "acceptance"}, "questions": ['),
        F.to_json(F.struct(answer.alias("answer"))), F.lit(", "), F.to_json(F.struct(note.alias("note"))), F.lit('], "page": '),
        F.to_json(F.struct(html.alias("html"))), F.lit("}"),
    )
    artifacts = pages.select(F.col("page_id").alias("artifact_id"), document.alias("json"))
    return audit.publication_scan(artifacts, ("hunter2-hunter2",))


# --- guards and providers -------------------------------------------------------------------
def guard_records(spark, folder):
    events = d.table(spark, folder, "events")
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("position"), F.col("value").alias("cost"),
        F.when(failed, "timeout").alias("error_category"), F.when(failed, "timeout").alias("failure_detail"),
        F.when(failed & (F.col("event_id") % 11 == 0), 429).cast("int").alias("status_code"),
        (F.col("event_id") % 401 == 0).alias("retrieval_transient"),
    )


@query(
    "run_guard",
    """SELECT run_id, min(position) AS position, arg_min(reason, position) AS reason FROM (
      SELECT user_id::VARCHAR AS run_id, event_id AS position, CASE WHEN event_id % 401 = 0 THEN 'retrieval_unavailable' WHEN e AND event_id % 11 = 0 THEN 'rate_limited'
          WHEN e AND prev THEN 'systemic_provider_failure' WHEN seen >= 3 AND projected > 6000 OR spent > 6000 THEN 'budget_guard' END AS reason FROM (
        SELECT *, spent + greatest(400 - seen, 0) * (seen / (seen + 5) * own + (1 - seen / (seen + 5)) * 12.0) AS projected FROM (
          SELECT user_id, event_id, event_type = 'error' AS e, lag(event_type = 'error', 1, false) OVER w AS prev,
            row_number() OVER w AS seen, sum(value) OVER w AS spent, median(value) OVER w AS own
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))))
    WHERE reason IS NOT NULL GROUP BY run_id""",
)
def run_guard_query(spark, folder):
    """S2 as a batch: where each run must stop and why."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stops = run_guard(guard_records(spark, folder), GuardSettings(400, 12.0))
    finally:
        spark.conf.set(key, before)
    return stops.select("run_id", "position", "reason")


def echo(prompt: str, limit: int) -> dict:
    """A provider for checks: long prompts are cut unless the limit is the larger one."""
    if len(prompt) % 7 == 0:
        raise TimeoutError
    if len(prompt) % 5 == 0 and limit < 1500:
        return {"text": '{"answer": "' + prompt[:3], "finish_reason": "length", "input_tokens": len(prompt), "output_tokens": limit}
    return {"text": '{"answer": "yes", "sources": ["S1"], "support": "stated"}', "finish_reason": "stop", "input_tokens": len(prompt), "output_tokens": 9}


@query(
    "generate",
    """SELECT doc_id AS query_id, 1 AS attempt, CASE WHEN n % 7 = 0 THEN 'provider_error' WHEN n % 5 = 0 THEN 'unusable_reply' ELSE 'parsed' END AS result,
      CASE WHEN n % 7 = 0 THEN 'unclassified' WHEN n % 5 = 0 THEN 'output_truncated' END AS failure_category, 800 AS max_output_tokens FROM (SELECT doc_id, length(text) AS n FROM documents)
    UNION ALL SELECT doc_id, 2, 'parsed', NULL, 1500 FROM documents WHERE length(text) % 7 <> 0 AND length(text) % 5 = 0""",
)
def generate(spark, folder):
    """U4: every document is a prompt; cut replies are asked again with the larger limit."""
    prompts = d.table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("prompt"))
    _, calls = generation.generate(prompts, echo, "echo")
    return calls.select("query_id", "attempt", "result", "failure_category", "max_output_tokens")
