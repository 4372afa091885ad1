"""Reasons of small runs, and sparse lexical vectors."""

from collections import Counter
from hashlib import sha256
from math import isclose, sqrt

from pyspark.sql import functions as F

from lodestone.operators import audit, embeddings

RECORDS = "run_id long, query_id string, error_category string, failures array<string>, aborted string"


def verdicts(spark, rows):
    return {r.run_id: r for r in audit.smoke_verdict(spark.createDataFrame(rows, RECORDS)).collect()}


def test_a_run_without_errors_passes(spark):
    got = verdicts(spark, [(1, "a", None, None, None), (1, "b", None, [], None), (2, "c", "timeout", [], None)])
    assert got[1].passed and got[1].reasons == []
    assert got[2].passed and got[2].reasons == ["c: timeout (classified)"]


def test_reasons_come_by_kind(spark):
    rows = [(1, "b", "unclassified", ["internal_label_leak"], "stopped"), (1, "a", "provider_status", ["internal_label_leak"], "stopped")]
    got = verdicts(spark, rows)[1]
    assert not got.passed
    assert got.reasons == [
        "run aborted: stopped", "a: provider refused the request", "b: unclassified provider failure",
        "2 of 2 questions failed technically", "safety: a, b",
    ]


def test_long_lists_say_how_many_more(spark):
    many = audit.SMOKE_LISTED + 7
    rows = [(1, f"q{n:04}", "unclassified", ["internal_label_leak"], None) for n in range(many)]
    got = verdicts(spark, rows)[1].reasons
    assert got[audit.SMOKE_LISTED] == "and 7 more"
    assert got[-1].startswith("safety: q0000, q0001") and got[-1].endswith("and 7 more")
    assert audit.smoke_reasons(spark.createDataFrame(rows, RECORDS)).count() == 2 * many + 1


def test_no_records_give_no_verdict(spark):
    assert verdicts(spark, []) == {}


def test_lexical_vectors(spark):
    texts = {1: None, 2: "", 3: "a of", 4: "storage storage backup", 5: " ".join(f"word{n % 50}" for n in range(3000))}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    made = rows.select("id", embeddings.lexical_vector(F.col("text"), 64).alias("v"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.v for r in made.collect()}
    for n in (1, 2, 3):
        assert got[n].buckets == [0] and got[n]["values"] == [1.0]
    for n in (4, 5):
        counts = Counter(int(sha256(w.encode()).hexdigest()[:8], 16) % 64 for w in texts[n].split())
        length = sqrt(sum(c * c for c in counts.values()))
        assert got[n].buckets == sorted(counts)
        assert all(isclose(v, counts[b] / length) for b, v in zip(got[n].buckets, got[n]["values"]))


def test_dense_vectors_keep_columns(spark):
    rows = spark.createDataFrame([(1, "storage backup", "public"), (2, None, None)], "id long, text string, visibility string")
    made = embeddings.lexical_embedding(rows, "id", "text", 8, keep=("visibility",))
    assert made.columns == ["id", "visibility", "embedding"]
    got = {r.id: r.embedding for r in made.collect()}
    assert got[2] == [1.0] + [0.0] * 7 and len(got[1]) == 8 and isclose(sum(v * v for v in got[1]), 1.0)
