"""Reading a folder of Markdown files."""

import os
from pathlib import Path

import pytest

from lodestone.sources import corpus, runs

GOOD = """---
schema_version: 1
id: {id}
title: A title
document_type: faq
language: en
topics: [storage, "backup: nightly"]
source: notes
source_type: authored
version: 2
updated_at: 2026-01-15
{more}---

{body}
"""


def write(folder, name, text):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def good(identifier, body="Some text.", more=""):
    return GOOD.format(id=identifier, body=body, more=more)


@pytest.fixture
def root(folder):
    write(folder, "alpha.md", good("alpha", "﻿# Head\r\n\r\nBody é  \n\n"))
    write(folder, "sub/beta.md", good("beta", more="visibility: public\nlicense: null\n"))
    for name in ("README.md", "_template.md", "_drafts/x.md", ".git/y.md", "old~/z.md", "notes.txt"):
        write(folder, name, good("skipped"))
    return folder


def test_scan_leaves_out_what_is_not_knowledge(spark, root):
    paths = [r.source_path for r in corpus.scan_corpus(spark, root).collect()]
    assert sorted(paths) == ["alpha.md", "sub/beta.md"]


def test_valid_documents(spark, root):
    rows = {r.document_id: r for r in corpus.load_corpus(spark, root, "strict").collect()}
    assert rows["alpha"].content == "﻿# Head\n\nBody é".replace("é", "é")
    assert rows["alpha"].metadata.visibility == "internal"
    assert rows["alpha"].metadata.topics == ["storage", "backup: nightly"]
    assert rows["beta"].metadata.visibility == "public"
    assert len(rows["beta"].document_fingerprint) == 64


def test_a_moved_file_keeps_its_fingerprint(spark, folder):
    write(folder, "a/one.md", good("one"))
    write(folder, "b/two/renamed.md", good("two").replace("id: two", "id: one"))
    prints = {r.document_fingerprint for r in corpus.load_corpus(spark, folder).collect()}
    assert len(prints) == 1


@pytest.mark.parametrize(
    ("text", "code", "field"),
    [
        ("no block", "MISSING_FRONTMATTER", None),
        ("---\nid: x\n", "INVALID_FRONTMATTER", None),
        ("---\nid: [x\n---\nbody", "INVALID_FRONTMATTER", None),
        ("---\n- a\n- b\n---\nbody", "INVALID_FRONTMATTER", None),
        ("---\n1: a\n---\nbody", "INVALID_FRONTMATTER", None),
        ("---\n\n---\nbody", "INVALID_FRONTMATTER", None),
        (good("x", more="version: 3\n"), "INVALID_FRONTMATTER", "version"),
        (good("x").replace("schema_version: 1", "schema_version: true"), "INVALID_METADATA", "schema_version"),
        (good("x").replace("schema_version: 1", "schema_version: 7"), "UNSUPPORTED_SCHEMA_VERSION", "schema_version"),
        (good("X y"), "INVALID_METADATA", "id"),
        (good("xx").replace("topics: [storage,", "topics: [1,"), "INVALID_METADATA", "topics.0"),
        (good("xx").replace("version: 2", "version: 0"), "INVALID_METADATA", "version"),
        (good("xx").replace("title: A title", "title: 5"), "INVALID_METADATA", "title"),
        (good("xx", "  \n"), "EMPTY_DOCUMENT", None),
        (b"---\nid: \xff\n---\nx", "INVALID_ENCODING", None),
    ],
)
def test_one_issue_per_bad_file(spark, folder, text, code, field):
    write(folder, "bad.md", text)
    write(folder, "fine.md", good("fine"))
    read = corpus.load_corpus(spark, folder)
    found = corpus.issues(read).collect()
    assert [(i.source_path, i.code, i.field) for i in found] == [("bad.md", code, field)]
    assert [r.document_id for r in corpus.documents(read).collect()] == ["fine"]
    with pytest.raises(ValueError, match=code):
        corpus.load_corpus(spark, folder, "strict")


def test_the_first_path_keeps_a_shared_id(spark, folder):
    for name in ("c.md", "a.md", "b.md"):
        write(folder, name, good("same"))
    read = corpus.load_corpus(spark, folder)
    assert [r.source_path for r in corpus.documents(read).collect()] == ["a.md"]
    reasons = sorted((i.source_path, i.reason) for i in corpus.issues(read).collect())
    assert reasons == [("b.md", "`same` first claimed by a.md"), ("c.md", "`same` first claimed by a.md")]


def test_a_missing_root_is_an_error(spark, folder):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.load_corpus(spark, folder + "/none").collect()


def test_question_file(spark, folder):
    path = Path(folder) / "questions.yaml"
    path.write_text(
        "version: 1\nquestions:\n- id: a\n  category: direct\n  question: What?\n"
        "  expected_sources: [{document: alpha, section: Head}, {document: beta}]\n"
        "- id: a\n  category: odd\n  question: Why?\n"
    )
    questions = runs.yaml_questions(spark, str(path))
    assert runs.expected_sources(questions).count() == 2
    assert [r.problem for r in runs.question_problems(questions).collect()] == ["duplicate_id"]


def test_ledger_round_trip(spark, folder):
    path = folder + "/ledger"
    assert runs.read_ledger(spark, path).count() == 0
    entry = "named_struct('date_utc', '2026-01-01', 'run_id', 'r1', 'tier', 'smoke', 'status', 'complete') as e"
    runs.append_ledger(spark.range(1).selectExpr(entry).select("e.*"), path)
    runs.append_ledger(spark.range(1).selectExpr(entry).select("e.*"), path)
    spark.createDataFrame([("{damaged",)], "value string").write.mode("append").text(path)
    health = runs.ledger_health(runs.read_ledger(spark, path)).first()
    assert (health.entries, health.unreadable_lines) == (2, 1)


def test_ledger_lines_keep_the_order_of_appends(spark, folder):
    path = folder + "/ordered"
    entry = "struct('2026-01-01' as date_utc, concat('r', id) as run_id, 'smoke' as tier, 'complete' as status) as e"
    sizes = [3, 500, 1, 40]
    start = 0
    for parts, size in zip((1, 4, 1, 3), sizes):
        runs.append_ledger(spark.range(start, start + size, 1, parts).selectExpr(entry).select("e.*"), path)
        start += size
    rows = runs.read_ledger(spark, path).orderBy("line_no").collect()
    assert [r.run_id for r in rows] == [f"r{n}" for n in range(start)]
    assert not any(r.damaged for r in rows)


def test_foreign_ledger_lines_follow_their_files(spark, folder):
    path = Path(folder) / "foreign"
    path.mkdir()
    line = '{"date_utc": "2026-01-01", "run_id": "%s", "tier": "smoke", "status": "complete"}\n'
    for n, (name, size) in enumerate((("b", 1), ("a", 300), ("c", 2))):
        file = path / f"{name}.json"
        file.write_text("".join(line % f"{n}-{i:03}" for i in range(size)))
        os.utime(file, (1000 + n, 1000 + n))
    rows = runs.read_ledger(spark, str(path)).orderBy("line_no").collect()
    assert [r.run_id for r in rows] == sorted(r.run_id for r in rows)


def test_odd_blocks_become_issues(spark):
    from pyspark.sql import functions as F

    from lodestone.sources.corpus import parse_metadata

    blocks = ["? [a, b]\n: 1", "updated_at: 2026-13-45", "a: 1\na: 2", "base: &b {x: 1}\nown:\n  <<: *b\n  x: 2", "1: x", "- a", "", "a: ["]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "n int, block string").select("n", parse_metadata(F.col("block")).alias("p"))
    found = {r["n"]: r["p"] for r in rows.collect()}
    assert [found[n]["message"] is None for n in range(8)] == [False, False, False, True, False, False, False, False]
    assert found[2]["field"] == "a" and found[4]["reason"] == "offending keys: 1" and found[5]["reason"] == "parsed as list"


def test_sentences_part_behind_many_closing_marks(spark):
    from pyspark.sql import functions as F

    from lodestone.operators.chunking import split_sentences

    text = "One." + '"' * 40 + " Two. Three"
    found = spark.range(1).select(split_sentences(F.lit(text)).alias("s")).first()["s"]
    assert [len(x) for x in found] == [44, 4, 5]
