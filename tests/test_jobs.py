"""Whole jobs: index sync, answering, streams."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.catalog import audit_queries
from lodestone.operators import chunking, indexing
from lodestone.operators.embeddings import hash_vectors, lexical_embedding
from lodestone.plans.answering import answer_questions
from lodestone.plans.evaluating import evaluate_retrieval
from lodestone.plans.index_sync import sync_index
from lodestone.policies import EmbeddingSpec, RetrievalPolicy
from lodestone.sources import index_table
from lodestone.streaming import index_stream
from lodestone.streaming.run_guard import GuardSettings, run_guard

SPEC = EmbeddingSpec("local", "hash", 8)
SCHEMA = (
    "document_id string, title string, source string, source_path string, document_type string, language string, "
    "visibility string, trust_level string, topics array<string>, technologies array<string>, "
    "document_fingerprint string, content string"
)


def provider(texts):
    return hash_vectors(texts, 8).tolist()


def documents(spark, *rows):
    made = [
        (name, f"Title {name}", "notes", f"{name}.md", "faq", "en", visibility, "verified", [], [], f"{abs(hash((name, content))):064x}"[:64], content)
        for name, content, visibility in rows
    ]
    return spark.createDataFrame(made, SCHEMA)


def counts(df):
    return {r.action: r.records for r in df.collect()}


def test_sync_is_convergent(spark, folder):
    first = documents(spark, ("a", "# H\n\none", "public"), ("b", "two", "public"), ("c", "two", "internal"))
    assert counts(sync_index(chunking.chunk_corpus(first), folder, SPEC, provider)) == {"create": 3}
    assert counts(sync_index(chunking.chunk_corpus(first), folder, SPEC, provider)) == {"unchanged": 3}
    assert index_table.current_version(spark, folder) == 1
    second = documents(spark, ("a", "# H\n\none changed", "public"), ("b", "two", "internal"))
    assert counts(sync_index(chunking.chunk_corpus(second), folder, SPEC, provider)) == {
        "reembed": 1, "metadata_update": 1, "delete": 1,
    }
    rows = {r.id: r for r in index_table.read_index(spark, folder).collect()}
    assert sorted(rows) == ["a--0000", "b--0000"]
    assert rows["b--0000"].metadata.visibility == "internal"
    with pytest.raises(ValueError, match="index holds"):
        sync_index(chunking.chunk_corpus(second), folder, EmbeddingSpec("local", "other", 8), provider)
    rebuilt = sync_index(chunking.chunk_corpus(second), folder, EmbeddingSpec("local", "other", 8), provider, rebuild=True)
    assert counts(rebuilt) == {"create": 2}


def test_a_short_batch_of_vectors_fails(spark, folder):
    docs = documents(spark, ("a", "one", "public"), ("b", "two", "public"))
    with pytest.raises(Exception, match="vectors for"):
        sync_index(chunking.chunk_corpus(docs), folder, SPEC, lambda texts: provider(texts)[:-1])


def test_stream_equals_batch(spark, folder):
    source, root = folder + "/in", folder + "/out"
    one = documents(spark, ("a", "# H\n\none\n\n# G\n\nmore", "public"), ("b", "two", "public"))
    two = documents(spark, ("a", "# H\n\none changed", "public"), ("c", "three", "internal"))
    one.coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        index_stream.stream_index_sync(stream, root, SPEC, provider, folder + "/checkpoint").awaitTermination()

    run()
    two.coalesce(1).write.mode("append").parquet(source)
    run()
    live = index_stream.live_index(spark, root)
    now = documents(spark, ("a", "# H\n\none changed", "public"), ("b", "two", "public"), ("c", "three", "internal"))
    wanted = indexing.desired_state(chunking.chunk_corpus(now), SPEC)
    assert counts(indexing.plan_counts(indexing.plan_index(wanted, live))) == {"unchanged": 3}
    before = sorted(map(repr, live.collect()))
    version = index_table.current_version(spark, root)
    index_stream.apply_batch(two, 1, root, SPEC, provider, stream=folder + "/checkpoint")
    assert index_table.current_version(spark, root) == version
    index_stream.apply_batch(two, 0, root, SPEC, provider, stream="another")
    assert sorted(map(repr, index_stream.live_index(spark, root).collect())) == before
    index_stream.compact(spark, root, folder + "/table", SPEC)
    assert index_table.read_index(spark, folder + "/table").count() == 3


def record(name, document, size):
    return name, {"visibility": "public", "document_id": document}, [float(size)] * 2


RECORDS = "id string, metadata struct<visibility:string,document_id:string>, embedding array<double>"


def test_a_change_of_one_row_leaves_other_buckets(spark, folder):
    spec = EmbeddingSpec("tables", "given", 2)
    rows = spark.createDataFrame([record(f"d{n}--0", f"d{n}", n) for n in range(60)], RECORDS)
    none = spark.createDataFrame([], "id string, document_id string")
    assert index_table.write_index(rows, folder, spec, buckets=8) == 1
    puts = spark.createDataFrame([record("d7--0", "d7", 100), record("d7--1", "d7", 101)], RECORDS)
    assert index_table.update_index(puts, none, folder, spec, base=1) == 2
    one, two = (index_table.manifest(spark, folder, v).folders for v in (1, 2))
    assert sum(one[b] != two[b] for b in one) == 1 and set(one) == set(two)
    stored = {r.id: r.embedding[0] for r in index_table.read_index(spark, folder).collect()}
    assert len(stored) == 61 and (stored["d7--0"], stored["d7--1"], stored["d8--0"]) == (100.0, 101.0, 8.0)
    gone = rows.select("id", "metadata.document_id")
    assert index_table.update_index(puts.limit(0), gone, folder, spec, base=2) == 3
    assert [r.id for r in index_table.read_index(spark, folder).collect()] == ["d7--1"]
    assert index_table.update_index(puts.limit(0), none, folder, spec, base=3) == 4
    assert index_table.read_index(spark, folder, 1).count() == 60


def test_a_second_writer_is_refused(spark, folder):
    spec = EmbeddingSpec("tables", "given", 2)
    rows = spark.createDataFrame([record("a--0", "a", 1)], RECORDS)
    none = spark.createDataFrame([], "id string, document_id string")
    index_table.write_index(rows, folder, spec)
    assert index_table.update_index(rows, none, folder, spec, base=1) == 2
    with pytest.raises(index_table.ConcurrentWrite, match="version 2"):
        index_table.update_index(rows, none, folder, spec, base=1)
    with pytest.raises(index_table.ConcurrentWrite, match="version 1"):
        index_table.write_index(rows, folder, spec, base=None)
    assert index_table.current_version(spark, folder) == 2
    with pytest.raises(ValueError, match="no committed version 9"):
        index_table.read_index(spark, folder, 9)


def test_guard_stream_equals_batch(spark, folder):
    tables = "/root/testdata/sf0.001"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        records = audit_queries.guard_records(spark, tables)
        settings = GuardSettings(400, 12.0)
        batch = sorted(map(tuple, run_guard(records, settings).select("run_id", "position", "reason").collect()))
        for part in range(3):
            third = records.filter((F.col("position") >= part * 334) & (F.col("position") < (part + 1) * 334))
            third.coalesce(1).write.mode("append").parquet(folder + "/in")
            stream = spark.readStream.schema(records.schema).parquet(folder + "/in")
            query = (
                run_guard(stream, settings).writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", folder + "/checkpoint").trigger(availableNow=True).start(folder + "/stops")
            )
            query.awaitTermination()
        stops = spark.read.parquet(folder + "/stops").select("run_id", "position", "reason")
        assert sorted(map(tuple, stops.collect())) == batch
    finally:
        spark.conf.set(key, before)


def reply(prompt, limit):
    """Cites the first passage; refuses when it speaks of secrets; checks always agree."""
    if prompt.startswith("CHECK"):
        return {"text": '{"verdict": "supported"}', "finish_reason": "stop", "input_tokens": 5, "output_tokens": 2}
    support = "none" if "volcano" in prompt.split("QUESTION")[-1] else "stated"
    text = json.dumps({"answer": "It is so [S1].", "sources": ["S1", "S77"], "support": support})
    return {"text": text, "finish_reason": "stop", "input_tokens": 9, "output_tokens": 4}


def test_answering_a_table_of_questions(spark, folder):
    docs = documents(
        spark,
        ("storage", "# Disks\n\nStorage volumes replicate nightly between regions.", "public"),
        ("billing", "# Invoices\n\nInvoices leave every month by mail.", "public"),
        ("secret", "# Keys\n\nRotation of signing keys happens yearly.", "internal"),
    )
    spec = EmbeddingSpec("local", "lexical", 64)
    chunks = chunking.chunk_corpus(docs)
    desired = indexing.desired_state(chunks, spec)
    vectors = lexical_embedding(desired, "id", "embedding_text")
    index = desired.join(vectors, "id")
    asked = spark.createDataFrame(
        [(1, " When do   storage volumes replicate? "), (2, "Rotation of signing keys yearly?"), (3, "​"), (4, "volcano invoices month mail?")],
        "query_id int, text string",
    )
    query_vectors = lexical_embedding(asked, "query_id", "text")
    out = answer_questions(asked, query_vectors, index, chunks, 64, "ANSWER", "CHECK", reply, "echo")
    assert [tuple(r) for r in out.rejected.collect()] == [(3, "empty")]
    rows = {r.query_id: r for r in out.decisions.collect()}
    assert rows[1].outcome == "answered" and rows[1].answer == "It is so [1]."
    assert [c.document_id for c in rows[1].citations] == ["storage"]
    assert rows[1].unknown_labels == ["S77"]
    assert rows[2].outcome == "no_knowledge" and rows[2].citations == []
    assert rows[4].outcome == "not_grounded"
    kinds = sorted((r.query_id, r.call_type) for r in out.calls.collect())
    assert kinds == [(1, "generation"), (1, "grounding_check"), (4, "generation")]

    questions = spark.createDataFrame([(1, "direct"), (2, "internal"), (4, "section")], "query_id int, category string")
    expected = spark.createDataFrame([(1, "storage", "Disks"), (4, "billing", None)], "query_id int, document string, section string")
    report = evaluate_retrieval(questions, expected, query_vectors.filter("query_id <> 3"), index, chunks, 64, RetrievalPolicy(5, 0.25))
    assert {(r.cutoff, r.correct, r.total) for r in report.hit_rates.collect()} == {(1, 2, 2), (3, 2, 2), (5, 2, 2)}
    assert report.mrr.first().mrr == 1.0
    assert report.leaks.first().internal_leaks == 0
    assert [tuple(r) for r in report.rejections.collect()] == [("internal", 1, 1)]
