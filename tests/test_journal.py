"""The journal stream: keys as state, batches that run again, keys that are forgotten."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import journal

SCHEMA = "mode string, index int, seconds double, at timestamp"


def put(at, name, rows):
    pathlib.Path(at).mkdir(exist_ok=True)
    (pathlib.Path(at) / name).write_text("\n".join(json.dumps(dict(zip(("mode", "index", "seconds", "at"), r, strict=False))) for r in rows) + "\n")


@pytest.fixture
def run(spark, tmp_path):
    def go(checkpoint="c", **options):
        q = journal.follow(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "j"), str(tmp_path / checkpoint), ["mode", "index"], **options)
        q.awaitTermination()
        return q

    return go


def keys(spark, tmp_path):
    return sorted((r.mode, r["index"]) for r in spark.read.parquet(str(tmp_path / "j")).collect())


def test_rows_that_come_again_add_nothing(spark, tmp_path, run):
    put(tmp_path / "in", "1.json", [("greedy", i, 1.0) for i in range(50)] + [("greedy", 0, 2.0)])
    run()
    put(tmp_path / "in", "again.json", [("greedy", i, 9.0) for i in range(50)])
    put(tmp_path / "in", "2.json", [("voted", 0, 1.0), ("voted", 0, 3.0)])
    q = run()
    assert keys(spark, tmp_path) == [("greedy", i) for i in range(50)] + [("voted", 0)]
    assert q.lastProgress["numInputRows"] == 52 and q.lastProgress["stateOperators"][0]["numRowsUpdated"] == 1  # not the journal's rows
    plan = journal.first_of_each(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), ["mode", "index"])
    assert "Deduplicate" in plan._jdf.queryExecution().analyzed().toString()


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path, run):
    put(tmp_path / "in", "1.json", [("greedy", i, 1.0) for i in range(20)])
    run()
    put(tmp_path / "in", "2.json", [("greedy", i, 1.0) for i in range(10, 40)])
    run()
    before = keys(spark, tmp_path)
    commits = tmp_path / "c" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()  # as if the driver had ended after the write
    run()
    assert keys(spark, tmp_path) == before == [("greedy", i) for i in range(40)]


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path, run):
    put(tmp_path / "in", "1.json", [("a", 0, 1.0, "2024-01-01 00:00:00"), ("a", 0, 1.0, "2024-01-01 00:05:00")])
    run(ts="at", late="10 minutes")
    put(tmp_path / "in", "2.json", [("a", 1, 1.0, "2024-01-01 09:00:00")])
    run(ts="at", late="10 minutes")
    put(tmp_path / "in", "3.json", [("a", 0, 1.0, "2024-01-01 09:30:00"), ("a", 1, 1.0, "2024-01-01 09:01:00")])
    run(ts="at", late="10 minutes")
    assert keys(spark, tmp_path) == [("a", 0), ("a", 0), ("a", 1)]


def test_a_lost_checkpoint_learns_the_journal(spark, tmp_path, run):
    put(tmp_path / "in", "1.json", [("a", i, 1.0) for i in range(10)])
    run()
    (tmp_path / "in" / "1.json").unlink()  # what the journal has may be nowhere else
    put(tmp_path / "in", "2.json", [("a", i, 1.0) for i in range(5, 15)])
    run("other")
    run("other")
    assert keys(spark, tmp_path) == [("a", i) for i in range(15)]
    assert spark.read.parquet(str(tmp_path / "j")).agg(F.count_distinct("run_")).first()[0] == 2
