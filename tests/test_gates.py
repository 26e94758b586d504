"""Gates over run records, seeded slices, resumed results, empty files."""

import random

import pytest

from tallyloom.operators import gates, splits
from tallyloom.sources import readers


def runs(spark, rows):
    return spark.createDataFrame([(r, 10, s, a, e, d, "fp32", m) for r, s, a, e, d, m in rows], "rung string, k int, seed int, arm string, error string, device string, dtype string, mean double")


def test_receipts_gate_lists_blocked_seeds(spark):
    plan = spark.createDataFrame([(r, k, s) for r in "abc" for k in (10, 30) for s in (1, 2, 3)], "rung string, k int, seed int")
    rows = [(r, s, arm, None, "cpu", {"t": 0.5 + 0.1 * s, "c": 0.5}[arm]) for r in "abc" for s in (1, 2, 3) for arm in "tc"]
    rows = [(r, s, a, "oom" if (r, s, a) == ("b", 1, "t") else e, "gpu" if r == "b" and s > 1 and a == "t" else d, 0.5 + 0.004 * s if r == "c" else m) for r, s, a, e, d, m in rows]
    got = {x.rung: x for x in gates.receipts(plan, runs(spark, rows), "t", "c").collect()}
    assert (got["a"].designed, got["a"].complete, got["a"].blocked, got["a"].verdict, got["a"].status) == (3, 3, [], "PASS", None)
    assert got["a"].mean_delta == pytest.approx(0.2) and got["c"].verdict == "FAIL"
    assert (got["b"].complete, got["b"].blocked, got["b"].mean_delta, got["b"].verdict) == (0, [2, 3], None, "UNDECIDABLE")
    assert got["b"].status == "undecidable: 0/3 gating pairs complete"


def test_difficulty_law(spark):
    cells = [(i / 10, 0.5 - i / 25) for i in range(11)]
    got = gates.difficulty(spark.createDataFrame(cells, "base double, delta double").repartition(3)).first()
    assert (got.cells, got.verdict) == (11, "PASS") and got.rho == pytest.approx(-1) and got.gap == pytest.approx(7 / 25) and got.spread == pytest.approx(1)
    few = gates.difficulty(spark.createDataFrame(cells[:3], "base double, delta double")).first()
    assert few.verdict == "UNINFORMATIVE" and few.gap == pytest.approx(0)


def test_rehearsal_of_groups(spark):
    rows = [("win", 0.5, 0.1)] * 6 + [("even", 0.5, 0.3), ("even", 0.5, -0.1)] + [("full", 0.99, 0.0)] * 3
    got = {x.g: x for x in gates.rehearsal(spark.createDataFrame(rows, "g string, control double, delta double"), ["g"]).collect()}
    assert (got["win"].verdict, got["win"].advice) == ("PASS", "helps") and got["win"].p == pytest.approx(1 / 64)
    assert (got["even"].verdict, got["full"].verdict, got["full"].advice) == ("FAIL", "FAIL", "saturated baseline")


def test_shuffled_slices_follow_the_generator(spark):
    rows = spark.createDataFrame([(f"r{i:03d}",) for i in range(60)], "id string").repartition(4)
    want = [f"r{i:03d}" for i in range(60)]
    random.Random(11).shuffle(want)
    got = {(x.split, x["index"]): x.id for x in splits.shuffled_slices(rows, "id", 20, 15, 11).collect()}
    assert got == {("train", i): want[i] for i in range(20)} | {("eval", i): want[20 + i] for i in range(15)}
    with pytest.raises(ValueError, match="35 to"):
        splits.shuffled_slices(rows.limit(30), "id", 20, 15, 11)


def test_resumed_results_and_subsets(spark):
    done = spark.createDataFrame([(1, 5, "d"), (0, 9, "d")], "seed int, index int, by string")
    fresh = spark.createDataFrame([(0, 1, "f"), (0, 9, "f"), (1, 0, "f")], "seed int, index int, by string")
    got = sorted(splits.resumed(done, fresh, ["seed", "index"]).collect(), key=lambda x: x.place)
    assert [(x.seed, x["index"], x.by, x.place) for x in got] == [(0, 1, "f", 0), (0, 9, "d", 1), (1, 0, "f", 2), (1, 5, "d", 3)]
    assert [x["index"] for x in readers.subset(fresh, fresh.where("index = 9").union(fresh.where("index = 9")), "index").collect()] == [9]


def test_an_empty_file_of_tasks_is_an_error(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text('{"task_id": "x", "train": [{"input": "i", "output": "o"}], "test": [{"input": "i", "output": "o"}]}\n')
    (tmp_path / "t" / "b.jsonl").write_text("")
    (tmp_path / "t" / "c.jsonl").write_text("\n  \n")
    got = {x.file: x["_errors"] for x in readers.text_task_lines(spark, str(tmp_path / "t")).collect()}
    assert got == {"a.jsonl": [], "b.jsonl": ["empty file"], "c.jsonl": ["empty file"]}
    with pytest.raises(Exception, match="empty file"):
        readers.strict(readers.text_task_lines(spark, str(tmp_path / "t")), "tasks").collect()


def test_plans_and_frozen_seeds(spark):
    plan = splits.arm_plan(spark.createDataFrame([(1,), (2,)], "seed int"), [10, 30], ["a", "b"])
    assert sorted(map(tuple, plan.collect())) == [(k, s, a) for k in (10, 30) for s in (1, 2) for a in "ab"]
    assert [x.seed for x in gates.frozen_plan(spark, 30).collect()] == list(gates.FROZEN_SEEDS)


def test_cells_of_the_law_are_computed_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def cells(frames):
        for pdf in frames:
            ran.add(len(pdf))
            yield pdf.assign(base=pdf["id"] / 20.0, delta=1.0 - pdf["id"] / 20.0)[["base", "delta"]]

    r = gates.difficulty(spark.range(20).mapInPandas(cells, "base double, delta double")).first()
    assert (r.cells, r.rho, r.verdict) == (20, pytest.approx(-1.0), "PASS")
    assert ran.value == 20
