"""Data sources of whole files: digests in chunks, one object from all tasks."""

import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import votes
from tallyloom.sources import files, readers, sinks


def test_digests_of_files_in_chunks(spark, tmp_path):
    contents = {"a.bin": bytes(range(256)) * 20, "x/b.bin": b"", "x/c.bin": b"q" * 1000, "x/.hidden": b"no", "_part/d": b"no"}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for at in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        got = {r.file.rpartition(str(tmp_path))[2][1:]: r for r in files.digests(spark, at, chunk=2048, together=4000).collect()}
        assert set(got) == {"a.bin", "x/b.bin", "x/c.bin"}
        for name, r in got.items():
            assert (r.bytes, r.chunks, r.sha256) == (len(contents[name]), -(-len(contents[name]) // 2048), hashlib.sha256(contents[name]).hexdigest())
    assert got["a.bin"].chunks == 3
    assert files.digests(spark, str(tmp_path), together=4000).rdd.getNumPartitions() == 2
    assert files.digests(spark, str(tmp_path / "a.bin")).first().bytes == 5120
    (tmp_path / "none").mkdir()
    assert files.digests(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="missing"):
        files.digests(spark, str(tmp_path / "missing")).collect()
    assert files.readable(str(tmp_path)) and not files.readable("viewfs://store/in")


def test_manifest_as_one_object(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    files.json_object(sinks.manifest(spark, str(tmp_path / "t"), commit="é", model="m"), str(tmp_path / "manifest.json"), "name", "value")
    found = json.loads((tmp_path / "manifest.json").read_text())
    assert found.pop("commit") == "é" and found.pop("model") == "m" and len(found) == 3
    for name, x in found.items():
        data = (tmp_path / "t" / name.removeprefix("files/")).read_bytes()
        assert x == {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def test_an_object_from_all_tasks(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit('k"é'), "id").alias("k"), F.when(F.col("id") % 7 > 0, F.to_json(F.struct("id"))).alias("v")).repartition(7)
    at = tmp_path / "o.json"
    files.json_object(rows, str(at), "k", "v")
    found = json.loads(at.read_text())
    assert found == {f'k"é{i}': {"id": i} if i % 7 else None for i in range(5000)} and list(found) == sorted(found)
    assert [p.name for p in tmp_path.iterdir()] == ["o.json"]
    assert {r.key: r.value for r in files.object_entries(spark, str(at)).collect()}['k"é3'] == '{"id":3}'
    with pytest.raises(Exception, match=r"o\.json"):
        files.json_object(rows, str(at), "k", "v")
    files.json_object(rows.limit(1), str(at), "k", "v", overwrite=True)
    assert len(json.loads(at.read_text())) == 1
    files.json_object(rows.limit(0), str(tmp_path / "none.json"), "k", "v")
    assert json.loads((tmp_path / "none.json").read_text()) == {} and files.object_entries(spark, str(tmp_path / "none.json")).count() == 0


@pytest.mark.parametrize("bad", ["x", None])
def test_repeated_or_null_keys_leave_no_file(spark, tmp_path, bad):
    rows = spark.createDataFrame([("x", "1"), ("y", "2"), (bad, "3")], "k string, v string")
    with pytest.raises(Exception, match="sorted and differ"):
        files.json_object(rows, str(tmp_path / "o.json"), "k", "v")
    assert not list(tmp_path.iterdir())


def test_submission_file(spark, tmp_path):
    a = [("t1", 0, 1, [[1, 2]]), ("t1", 0, 2, [[3, 4]]), ("t1", 1, 1, [[5]]), ("t2", 0, 2, [[6], [7]]), ("t3", 0, 1, None)]
    rows = spark.createDataFrame(a, "task_id string, test_index int, attempt int, grid array<array<int>>")
    sinks.submission(rows, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {
        "t1": [{"attempt_1": [[1, 2]], "attempt_2": [[3, 4]]}, {"attempt_1": [[5]], "attempt_2": [[5]]}],
        "t2": [{"attempt_1": [[0]], "attempt_2": [[6], [7]]}],
        "t3": [{"attempt_1": [[0]], "attempt_2": [[0]]}],
    }
    assert votes.submission_entries(rows.limit(0)).count() == 0
    sinks.summary_object(spark.createDataFrame([("b", 1, None), ("a", 2, 0.5)], "arm string, n int, mean double"), str(tmp_path / "m.json"), "arm")
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": {"n": 2, "mean": 0.5}, "b": {"n": 1, "mean": None}}


OBJECTS = [{}, {"a": 1}, {"a": [1, {"b": "}"}], 'k"é\\n': "x,:{", "n": None, "e": {}, "f": -1.5e3, "t": True, "long": "y" * 5000}, {f"t{i}": {"train": [[i] * 20]} for i in range(300)}]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_entries_of_objects_in_pieces(chunk, indent):
    for x in OBJECTS:
        for ascii_ in (True, False):
            text = json.dumps(x, indent=indent, ensure_ascii=ascii_)
            found = list(files.entries_of(io.BytesIO(text.encode()), chunk))
            assert {k: json.loads(v) for k, v in found} == x and len(found) == len(x)
    for bad in ("", "[]", "{", '{"a"', '{"a":', '{"a":1', '{"a":1,}', '{"a":1 "b":2}', "{1:2}", '{"a":}', '{"a":tru'):
        with pytest.raises(ValueError):
            list(files.entries_of(io.BytesIO(bad.encode()), chunk))


def test_task_maps_are_read_entry_by_entry(spark, tmp_path):
    from tallyloom.sources import readers

    tasks = {f"t{i}": {"train": [{"input": [[i % 10]], "output": [[1]]}], "test": [{"input": [[2]]}]} for i in range(50)}
    (tmp_path / "tasks.json").write_text(json.dumps(tasks, indent=1))
    (tmp_path / "solutions.json").write_text(json.dumps({f"t{i}": [[[i % 7]]] for i in range(0, 50, 2)}))
    got = {r.task_id: r for r in readers.task_map(spark, str(tmp_path / "tasks.json"), str(tmp_path / "solutions.json")).collect()}
    assert set(got) == {f"t{i}" for i in range(0, 50, 2)} and all(got[f"t{i}"].test[0].output == [[i % 7]] and got[f"t{i}"].train[0].input == [[i % 10]] for i in range(0, 50, 2))
    assert readers.task_map(spark, str(tmp_path / "tas*.json")).count() == 50
    (tmp_path / "two").mkdir()
    for name in "ab":
        (tmp_path / "two" / f"{name}.json").write_text(json.dumps({name: 1}))
    assert sorted(map(tuple, files.entries(spark, str(tmp_path / "two"), chunk=2).collect())) == [("a", "1"), ("b", "1")]


def test_a_file_for_each_row_in_bounded_folders(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('t', id) as name", "concat('é', id, '\n') as text").union(spark.createDataFrame([("t7", "again"), ("t7", "again"), ("t8", None)], "name string, text string"))
    files.file_each(rows, str(tmp_path / "each"), "name", "text", together=20)
    folders = list((tmp_path / "each").iterdir())
    assert len(folders) > 10 and max(len(list(f.iterdir())) for f in folders) < 60  # tasks grow in number, not in size
    want = sorted([f"é{i}\n" for i in range(300)] + ["again", "again", ""])
    assert sorted(p.read_text() for f in folders for p in f.iterdir()) == want
    assert {p.name for f in folders for p in f.iterdir()} >= {f"t{i}.txt" for i in range(300)}
    assert sorted(r.text for r in readers.whole_files(spark, str(tmp_path / "each"), "*.txt").collect()) == want[1:]  # Spark skips a file of no bytes
