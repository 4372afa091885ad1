"""Run documents as lines of few files are read like those in files of their own."""

from pathlib import Path

from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.catalog import file_queries
from lodestone.session import shared_folder
from lodestone.sources import runs


def test_lines_and_files_of_their_own(spark, tmp_path):
    text = '{"format": "%s", "run": {"run_id": "run-%d"}, "questions": [{"id": "q-1", "outcome": "answered"}]}'
    documents = [text % (k.RUN_FORMAT, n) for n in range(30)] + [text % ("other", 30), "{", "[]", ""]
    for n, document in enumerate(documents):
        (tmp_path / f"{n}.json").write_text(document.replace(", ", ",\n"))
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "all.json").write_text("\n".join(documents))

    def read(path, **how):
        found = runs.read_runs(spark, str(path), **how).select("run.run_id", F.size("questions")).collect()
        return sorted(map(tuple, found))

    assert read(tmp_path / "packed", lines=True) == read(tmp_path) == sorted((f"run-{n}", 1) for n in range(30))


def test_the_files_do_not_grow_with_the_runs(spark, tmp_path):
    events = spark.range(2000).select(
        F.col("id").alias("event_id"), (F.col("id") % 400).alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"), F.current_timestamp().alias("ts"), F.lit("{}").alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    root = Path(shared_folder(spark).removeprefix("file://"))
    before = set(root.glob("runs-*/*.json"))
    found = file_queries.QUERIES["read_run_files"](spark, str(tmp_path)).collect()
    assert sorted(r.run_id for r in found) == sorted(f"run-{n}" for n in range(400) if n % 29 != 28)
    assert all(r.questions == r.not_grounded == 5 for r in found)
    assert 0 < len(set(root.glob("runs-*/*.json")) - before) <= 16
