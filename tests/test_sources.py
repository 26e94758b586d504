import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import readers, sinks
from tallyloom.streaming import journal


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


GOOD = {"train": [{"input": [[1, 2]], "output": [[2, 1]]}], "test": [{"input": [[0]]}]}


def test_grid_tasks_and_their_errors(spark, tmp_path):
    bad = {"no_test": {"train": GOOD["train"]}, "ragged": {"train": [{"input": [[1], [1, 2]], "output": [[1]]}], "test": GOOD["test"]}, "colour": {"train": [{"input": [[11]], "output": [[1]]}], "test": GOOD["test"]},
           "no_output": {"train": [{"input": [[1]]}], "test": GOOD["test"]}, "wide": {"train": [{"input": [[1] * 31], "output": [[1]]}], "test": GOOD["test"]}, "empty": {"train": [], "test": GOOD["test"]}}
    for name, task in {"good": GOOD, **bad}.items():
        write(tmp_path / f"{name}.json", json.dumps(task))
    got = {x.task_id: x._errors for x in readers.grid_tasks(spark, str(tmp_path)).collect()}
    assert got.pop("good") == [] and set(got) == set(bad) and all(got.values())
    assert {(x["split"], x["index"]) for x in readers.pairs(readers.grid_tasks(spark, str(tmp_path / "good.json"))).collect()} == {("train", 0), ("test", 0)}
    with pytest.raises(Exception, match="bad train input"):
        readers.strict(readers.grid_tasks(spark, str(tmp_path / "ragged.json")), "task").collect()


def test_text_tasks(spark, tmp_path):
    one = {"train": [{"input": "a", "output": "b"}], "test": [{"input": "c"}]}
    write(tmp_path / "f" / "stem.json", json.dumps(one))
    assert readers.text_tasks(spark, str(tmp_path / "f")).first().task_id == "stem"
    lines = [json.dumps(one | {"task_id": i}) for i in ("x", "y", "y")] + ["", json.dumps(one), json.dumps({"task_id": "z", "train": [{"input": " ", "output": "b"}], "test": one["test"]})]
    got = readers.text_task_lines(spark, write(tmp_path / "t.jsonl", "\n".join(lines))).collect()
    assert sorted((x.task_id or "", tuple(x._errors)) for x in got) == [("", ("no id",)), ("x", ()), ("y", ("duplicate id",)), ("y", ("duplicate id",)), ("z", ("bad train input",))]


def test_task_map_with_solutions(spark, tmp_path):
    tasks = write(tmp_path / "a.json", json.dumps({"p": GOOD, "q": GOOD}))
    answers = write(tmp_path / "b.json", json.dumps({"q": [[[5]]]}))
    got = readers.task_map(spark, tasks, answers).collect()
    assert [(x.task_id, x.test[0].output) for x in got] == [("q", [[5]])] and readers.task_map(spark, tasks).count() == 2


def test_receipts(spark):
    rows = spark.createDataFrame([('{"total":{"x":"1"},"menu":[{"nm":"A"}],"other":1}', [([("a",), ("b",)],), ([("  ",)],), ([("c",)],)]), ('{"other":1}', [])], "gt_parse string, valid_line array<struct<words:array<struct<text:string>>>>")
    a, b = readers.receipts(rows).collect()
    assert a.text == "a b\nc" and json.loads(a.gold) == {"menu": [{"nm": "A"}], "total": {"x": "1"}} and a._errors == []
    assert b._errors == ["no lines", "no allowed label"]


def test_labelled_and_predictions(spark, tmp_path):
    rows = [{"id": "a", "text": "t", "gold": {"x": 1}}, {"id": "b", "text": "t", "gold": [1]}, {"id": "b", "gold": {}}]
    got = readers.labelled(spark, write(tmp_path / "l.jsonl", "\n".join(map(json.dumps, rows)))).collect()
    assert sorted((x.id, tuple(x._errors)) for x in got) == [("a", ()), ("b", ("gold is not an object", "duplicate id")), ("b", ("no text", "duplicate id"))]
    p = readers.predictions(spark, write(tmp_path / "p.jsonl", '{"id":"a","prediction":{"x":1}}\n{"id":"a","prediction":null}\n'))
    assert [(x.line_no, x.prediction) for x in p.orderBy("line_no").collect()] == [(1, '{"x":1}'), (2, None)]
    assert readers.latest_per_id(p.where("prediction is not null"), "id", "prediction").first().prediction == '{"x":1}'


def test_arms_and_others(spark, tmp_path):
    base = {"rung": "0.5b", "k": 30, "seed": 1, "device": "cpu", "results": [{"index": 0, "micro_f1": 0.5, "valid_json": True}, {"index": 1, "error": "no completion"}]}
    write(tmp_path / "fam_0.5b_a.json", json.dumps(base | {"arm": "adapted"}))
    write(tmp_path / "fam_1.5b_a.json", json.dumps(base | {"arm": "adapted", "rung": "1.5b", "device": None}))
    write(tmp_path / "fam_0.5b_err.json", json.dumps({k: base[k] for k in ("rung", "k", "seed")} | {"arm": "kshot", "error": "oom"}))
    write(tmp_path / "note.json", json.dumps({"note": "incident"}))
    found, others = readers.arms(spark, str(tmp_path))
    assert {(x.rung, x.arm, x.env) for x in found.collect()} == {("0.5b", "adapted", "kernel"), ("1.5b", "adapted", "local"), ("0.5b", "kshot", "local")}
    assert [x.file for x in others.collect()] == ["note.json"]
    assert readers.receipt_rows(found).where("micro_f1 is null").count() == 2


def test_challenge_files_never_leak_gold(spark, tmp_path):
    rows = spark.createDataFrame([("1", "t", "{}", "train"), ("2", "u", "{}", "holdout")], "id string, text string, gold string, split string")
    sinks.challenge(rows, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c/holdout")).columns == ["id", "text"]
    assert all(len(x.sha256) == 64 for x in sinks.file_hashes(spark, str(tmp_path / "c")).collect())
    entries = {x.name: json.loads(x.value) for x in sinks.manifest(spark, str(tmp_path / "c"), commit="x").collect()}
    assert entries.pop("commit") == "x" and {len(x["sha256"]) for x in entries.values()} == {64} and all(n.startswith(("files/train/", "files/holdout/", "files/gold_holdout/")) for n in entries)
    with pytest.raises(ValueError, match="unpinned: model"):
        sinks.guarded(rows, {"model": None, "commit": "x"})


def test_journal_stream_survives_a_restart(spark, tmp_path):
    schema = "mode string, index int, seconds double"
    go = lambda name, rows: write(tmp_path / "in" / name, "\n".join(json.dumps(dict(zip(("mode", "index", "seconds"), r, strict=True))) for r in rows))
    run = lambda check: journal.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "j"), str(tmp_path / check), ["mode", "index"]).awaitTermination()
    go("1.json", [("greedy", 0, 1.0), ("greedy", 0, 2.0), ("voted", 0, 3.0)])
    run("c1")
    go("2.json", [("greedy", 0, 9.0), ("greedy", 1, 1.0)])
    run("c1")
    run("c2")  # a lost checkpoint reads everything again and adds nothing
    rows = spark.read.parquet(str(tmp_path / "j"))
    assert rows.count() == rows.select("mode", "index").distinct().count() == 3


def test_windows_and_sweep(spark, tmp_path):
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1, 1.0), ("2024-01-01 00:50:00", "a", 1, 2.0), ("2024-01-01 02:00:00", "a", 1, 3.0)], "ts string, event_type string, user_id int, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(x.n for x in journal.windowed_counts(ev).collect()) == [1, 2] and journal.sessions(ev).count() == 3
    write(tmp_path / "d" / "a.md", "190 tests pass")
    write(tmp_path / "d" / "x" / "b.md", "SUPERSEDED\n1 tests")
    assert readers.sweep(spark, str(tmp_path / "d")).count() == 1


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"{i:05d} {'x' * (i % 90)}" if i % 7 else "  " for i in range(3000)]
    write(tmp_path / "n" / "a.txt", "\n".join(lines))
    write(tmp_path / "n" / "b.txt", "\n".join(["one", "", "three"]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        numbered = readers.numbered_lines(spark, str(tmp_path / "n"))
        assert spark.read.text(str(tmp_path / "n")).rdd.getNumPartitions() > 5
        got = sorted((x.file, x.line_no, x.text) for x in numbered.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [("a.txt", i + 1, x) for i, x in enumerate(lines) if i % 7] + [("b.txt", 1, "one"), ("b.txt", 3, "three")]


def test_an_error_names_its_line(spark, tmp_path):
    one = {"train": [{"input": "a", "output": "b"}], "test": [{"input": "c"}]}
    path = write(tmp_path / "t.jsonl", "\n".join([json.dumps(one | {"task_id": "x"}), "", json.dumps(one)]))
    with pytest.raises(Exception, match="tasks: line 3: no id"):
        readers.strict(readers.text_task_lines(spark, path), "tasks").collect()
    with pytest.raises(ValueError, match="2 rows, at least 3"):
        readers.at_least(readers.text_task_lines(spark, path), 3, "kit")


def test_asserted_arms_cells_and_positions(spark, tmp_path):
    arm = {"k": 30, "seed": 1, "arm": "kshot", "device": "cpu", "dtype": "fp32", "results": [{"index": 0, "micro_f1": 0.5}, {"index": 1, "error": "none"}]}
    path = write(tmp_path / "r" / "e_1.json", json.dumps(arm))
    one = readers.one_arm(spark, path, rows=2, k=30, arm="kshot", device="cpu")
    assert [tuple(x) for x in readers.scores_by_index(one, dtype="fp32").collect()] == [(0, 0.5)]
    for facts in ({"device": "gpu"}, {"rows": 60}):
        with pytest.raises(Exception, match="device is not gpu but cpu|results_n is not 60 but 2"):
            readers.one_arm(spark, path, **facts).collect()
    assert readers.arms(spark, str(tmp_path / "r"), identity=("k", "seed", "arm"))[0].count() == 1 and readers.arms(spark, str(tmp_path / "r"))[0].count() == 0
    write(tmp_path / "c" / "x.json", json.dumps({"addendum": "G-b", "seed": 1, "j": 2, "device": "cpu"}))
    assert readers.cells(spark, str(tmp_path / "c"), "G-b", device="cpu").first().j == 2
    with pytest.raises(Exception, match="device is not gpu"):
        readers.cells(spark, str(tmp_path / "c"), "G-b", device="gpu").collect()
    lists = spark.createDataFrame([(1, ["a", "b"], ["x", "y"])], "id int, left array<string>, right array<string>")
    assert [tuple(x) for x in readers.positional(lists, "left", "right").collect()] == [(1, 0, "a", "x"), (1, 1, "b", "y")]
    with pytest.raises(Exception, match="different lengths"):
        readers.positional(lists.withColumn("right", F.array(F.lit("z"))), "left", "right").collect()


def test_prompts_and_summaries(spark, tmp_path):
    rows = spark.createDataFrame([("1", "t", "{}"), ("2", "u", "{}")], "id string, text string, gold string")
    sinks.prompts(rows, str(tmp_path / "apart"))
    assert spark.read.json(str(tmp_path / "apart/prompts")).columns == ["id", "text"] and spark.read.json(str(tmp_path / "apart/gold")).columns == ["gold", "id"]
    sinks.prompts(rows, str(tmp_path / "inline"), inline=True)
    assert spark.read.json(str(tmp_path / "inline")).columns == ["gold", "id", "text"]
    sinks.summary(rows.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "s"), ["id"])
    files = list((tmp_path / "s").glob("*.json"))
    assert len(files) == 1 and [json.loads(x)["id"] for x in files[0].read_text().splitlines()] == ["1", "2"] and '"none":null' in files[0].read_text()


def test_enough_rows_are_known_from_the_first_tasks(spark):
    many, ran = spark.range(0, 64, 1, 64).select("id"), spark.sparkContext.accumulator(0)

    def noted(frames):
        ran.add(1)
        yield from frames

    assert readers.at_least(many.mapInPandas(noted, "id long"), 1, "rows").count() == 64
    assert ran.value < 64 + 8  # one task more tells that there is a row, not each of 64
