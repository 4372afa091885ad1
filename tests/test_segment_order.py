"""Order checks on question rows against plain lists."""

from __future__ import annotations

import random

from lodestone.operators import segment_order as so


def plain(complete, ids, plan, segments):
    """segments: list of (completed ids, interrupted ids)"""
    out = set()
    completed = [q for own, _ in segments for q in own]
    where = {}
    for n, (own, _) in enumerate(segments, 1):
        for q in own:
            where.setdefault(q, []).append(n)
    out |= {("completed_twice", max(n), q) for q, n in where.items() if len(n) > 1}
    for i in range(max(len(completed), len(ids))):
        a, b = (x[i] if i < len(x) else None for x in (completed, ids))
        if a != b:
            out.add(("completed_out_of_order", i, a or b))
    for i, q in enumerate(ids):
        if i >= len(plan) or plan[i] != q:
            out.add(("recorded_out_of_plan", i, q))
    if complete:
        out |= {("planned_not_recorded", i, q) for i, q in enumerate(plan) if i >= len(ids)}
    for n, (_, cut) in enumerate(segments, 1):
        for q in cut:
            if min(where.get(q, [99])) <= n:
                out.add(("interrupted_after_completion", n, q))
            elif complete and max(where.get(q, [0])) <= n:
                out.add(("never_asked_again", n, q))
    return out


def tables(spark, made):
    flat = {"runs": [], "recorded": [], "planned": [], "completed": [], "interrupted": []}
    for run, (complete, ids, plan, segments) in made.items():
        flat["runs"].append((run, complete))
        flat["recorded"] += [(run, i, q) for i, q in enumerate(ids)]
        flat["planned"] += [(run, i, q) for i, q in enumerate(plan)]
        for n, (own, cut) in enumerate(segments, 1):
            flat["completed"] += [(run, n, i, q) for i, q in enumerate(own)]
            flat["interrupted"] += [(run, n, q) for q in cut]
    types = {
        "runs": "run_id string, complete boolean", "recorded": "run_id string, place int, question_id string",
        "planned": "run_id string, place int, question_id string",
        "completed": "run_id string, segment int, place int, question_id string",
        "interrupted": "run_id string, segment int, question_id string",
    }
    return {name: spark.createDataFrame(rows, types[name]) for name, rows in flat.items()}


def test_random_runs(spark):
    r = random.Random(4)
    made = {}
    for n in range(60):
        plan = [f"q{i}" for i in range(r.randint(0, 60))]
        ids = plan[: r.choice([len(plan), r.randint(0, len(plan))])]
        done = list(ids)
        for _ in range(r.choice([0, 0, 1, 2])):
            for own in (ids, done):
                if len(own) > 1 and r.random() < 0.5:
                    i, j = r.sample(range(len(own)), 2)
                    own[i], own[j] = own[j], own[i]
            if done and r.random() < 0.4:
                done.insert(r.randint(0, len(done)), r.choice(done))
        cuts = sorted(r.randint(0, len(done)) for _ in range(r.randint(0, 4)))
        bounds = [0, *cuts, len(done)]
        segments = [
            (done[a:b], r.sample([*plan, "other"], min(len(plan), r.randint(0, 3)))) for a, b in zip(bounds, bounds[1:])
        ]
        made[f"run-{n}"] = (r.choice([True, False, None]), ids, plan, segments)
    want = {(run, *x) for run, parts in made.items() for x in plain(*parts)}
    got = so.order_findings(**tables(spark, made))
    assert {tuple(row) for row in got.select(*so.FOUND).collect()} == want
    assert {kind for _, kind, *_ in want} == {
        "completed_twice", "completed_out_of_order", "recorded_out_of_plan", "planned_not_recorded",
        "interrupted_after_completion", "never_asked_again",
    }
    summed = {(row["run_id"], row["kind"]): row["n"] for row in so.order_summary(got).collect()}
    assert sum(summed.values()) == len(want)


def test_no_runs(spark):
    assert so.order_findings(**tables(spark, {})).collect() == []


def test_rows_of_run_documents(spark):
    from pyspark.sql import functions as F

    from lodestone.catalog import audit_queries

    documents = audit_queries.read_runs(spark, "/root/testdata/sf0.001").cache()
    assert so.order_findings(**so.rows_of_documents(documents)).count() == 0
    turned = documents.withColumn(
        "run", F.col("run").withField("execution_segments", F.reverse(F.col("run.execution_segments")))
    )
    found = so.order_findings(**so.rows_of_documents(turned))
    kinds = {row["kind"] for row in found.select("kind").distinct().collect()}
    assert kinds == {"completed_out_of_order"}
    documents.unpersist()
