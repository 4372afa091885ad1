"""Order checks between a run and its execution segments, on question rows.

`audit.segment_problems` checks a run that is one document. Here questions are rows, so a
run may have any number of them: sequences are compared place by place, the place of a
completed question in the whole run comes from prefix sums over the sizes of segments, and
every aggregate is combined before its shuffle. Joins are keyed by place or question within
a run, so one very long run spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Copies of a segment's offset, so the rows of one long segment meet it in as many tasks.
SALTS = 16
FOUND = ("run_id", "kind", "at", "question_id")


def run_places(completed: DataFrame) -> DataFrame:
    """(run_id, place, question_id): completed questions by their place in the whole run.

    completed(run_id, segment, place, question_id) counts places from 0 in each segment.
    """
    before = Window.partitionBy("run_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = completed.groupBy("run_id", "segment").agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    # Copied only after the sums: in one select the copies would be summed as well.
    offsets = offsets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = completed.withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int"))
    return salted.join(offsets, ["run_id", "segment", "salt"]).select(
        "run_id", (F.col("offset") + F.col("place")).alias("place"), "question_id"
    )


def _differing(left: DataFrame, right: DataFrame, kind: str, how: str) -> DataFrame:
    """Places where two sequences of a run differ; *how* says whose places count."""
    one = left.withColumnRenamed("question_id", "l").withColumn("in_left", F.lit(True))
    two = right.withColumnRenamed("question_id", "r").withColumn("in_right", F.lit(True))
    differs = ~(F.col("in_left").eqNullSafe(F.col("in_right")) & F.col("l").eqNullSafe(F.col("r")))
    return one.join(two, ["run_id", "place"], how).filter(differs).select(
        "run_id", F.lit(kind).alias("kind"), F.col("place").alias("at"), F.coalesce("l", "r").alias("question_id")
    )


def order_findings(
    runs: DataFrame, recorded: DataFrame, planned: DataFrame, completed: DataFrame, interrupted: DataFrame
) -> DataFrame:
    """(run_id, kind, at, question_id): every contradiction, one row each.

    runs(run_id, complete); recorded and planned(run_id, place, question_id), places from 0;
    completed(run_id, segment, place, question_id); interrupted(run_id, segment, question_id).
    Places are unique within a run, or within a segment. A null *complete* counts as false.

    Kinds: completed_twice (at the last such segment), completed_out_of_order (at the place in
    the run where completed and recorded questions differ, or one ends), recorded_out_of_plan
    (at the place), planned_not_recorded (complete runs, at the place),
    interrupted_after_completion and never_asked_again (complete runs), at the interrupted segment.
    """
    finished = runs.filter(F.coalesce("complete", F.lit(False))).select("run_id").distinct()
    places = recorded.select("run_id", "place", "question_id")
    plan = planned.select("run_id", "place", "question_id")
    times = completed.groupBy("run_id", "question_id").agg(
        F.count(F.lit(1)).alias("times"), F.min("segment").alias("earliest"), F.max("segment").alias("latest")
    )
    twice = times.filter("times > 1").select(
        "run_id", F.lit("completed_twice").alias("kind"), F.col("latest").alias("at"), "question_id"
    )
    unordered = _differing(run_places(completed), places, "completed_out_of_order", "full_outer")
    unplanned = _differing(places, plan, "recorded_out_of_plan", "left_outer")
    unrecorded = (
        plan.join(places.select("run_id", "place"), ["run_id", "place"], "left_anti")
        .join(finished, "run_id", "left_semi")
        .select("run_id", F.lit("planned_not_recorded").alias("kind"), F.col("place").alias("at"), "question_id")
    )
    cut = interrupted.select("run_id", "segment", "question_id").distinct()
    known = times.select(F.col("run_id").alias("run"), F.col("question_id").alias("question"), "earliest", "latest")
    cut = cut.join(known, (F.col("run_id") == F.col("run")) & F.col("question_id").eqNullSafe(F.col("question")), "left")
    done = finished.withColumn("finished", F.lit(True))
    kind = F.when(F.col("earliest") <= F.col("segment"), "interrupted_after_completion").when(
        F.col("finished") & F.coalesce(F.col("latest") <= F.col("segment"), F.lit(True)), "never_asked_again"
    )
    cut = cut.join(done, "run_id", "left").withColumn("kind", kind).filter(F.col("kind").isNotNull())
    cut = cut.select("run_id", "kind", F.col("segment").alias("at"), "question_id")
    parts = [x.select("run_id", "kind", F.col("at").cast("long").alias("at"), "question_id") for x in (twice, unordered, unplanned, unrecorded, cut)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order_summary(findings: DataFrame) -> DataFrame:
    """(run_id, kind, n, first_at, first_question): the findings of a kind, counted, and the first."""
    return findings.groupBy("run_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "question_id")).alias("first")
    ).select("run_id", "kind", "n", F.col("first.at").alias("first_at"), F.col("first.question_id").alias("first_question"))


def rows_of_documents(runs: DataFrame) -> dict[str, DataFrame]:
    """The arguments of `order_findings` from run documents, whose run ids must be unique.

    Without planned ids the recorded ones are the plan.
    """
    run_id, run = F.col("run.run_id").alias("run_id"), F.col("run")
    ids = F.transform("questions", lambda q: q["id"])
    plan = F.coalesce(F.nullif(run["planned_question_ids"], F.array().cast("array<string>")), ids)
    segments = runs.select(run_id, F.posexplode(run["execution_segments"]).alias("n", "s"))
    number = (F.col("n") + 1).alias("segment")
    return {
        "runs": runs.select(run_id, run["complete"].alias("complete")),
        "recorded": runs.select(run_id, F.posexplode(ids).alias("place", "question_id")),
        "planned": runs.select(run_id, F.posexplode(plan).alias("place", "question_id")),
        "completed": segments.select("run_id", number, F.posexplode("s.completed_question_ids").alias("place", "question_id")),
        "interrupted": segments.select("run_id", number, F.explode("s.interrupted_question_ids").alias("question_id")),
    }
