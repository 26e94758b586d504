"""Audits of nested summaries and of claimed counts."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audits


def flat(x, path=""):
    if isinstance(x, dict) and x:
        return {k: v for n, y in x.items() for k, v in flat(y, f"{path}.{n}" if path else n).items()}
    if isinstance(x, list) and x:
        return {k: v for i, y in enumerate(x) for k, v in flat(y, f"{path}[{i}]").items()}
    return {path: x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))}


DOCUMENTS = [{"a": {"b": [1, 2.5, {"c": None}], "d": "x y"}, "e": True, "f": {}, "g": []}, [], {}, 5, "text", [[["deep"]]], {"a.b": {"c d": -0.25}}]


def test_leaves_of_nested_json(spark):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(DOCUMENTS)] + [(99, None)], "id int, json string")
    got = {}
    for r in audits.leaves(rows, ["id"], "json").collect():
        got.setdefault(r.id, {})[r.path] = r.value
    assert got == {i: flat(x) for i, x in enumerate(DOCUMENTS)}
    with pytest.raises(Exception, match="nested deeper than 2"):
        audits.leaves(rows, ["id"], "json", depth=2).collect()


BASE = {"gate": {"n": 158, "mean_delta": 0.1234, "ci95": [0.1, 0.2], "p": 1e-9, "wins": 3}, "verdict": "GO"}
FAULTS = {
    "same": ({}, set()),
    "within": ({"mean_delta": 0.1238, "ci95": [0.1009, 0.2]}, set()),
    "mean": ({"mean_delta": 0.1240}, {("gate.mean_delta", "differs")}),
    "count": ({"n": 159}, {("gate.n", "differs")}),
    "p": ({"p": 1e-5}, {("gate.p", "differs")}),
    "interval": ({"ci95": [0.1, 0.2011]}, {("gate.ci95[1]", "differs")}),
    "null": ({"wins": None}, {("gate.wins", "differs")}),
    "shorter": ({"ci95": [0.1]}, {("gate.ci95[1]", "not published")}),
    "more": ({"losses": 0}, {("gate.losses", "not recomputed")}),
}


def test_every_seeded_fault_is_found(spark):
    published = spark.createDataFrame([(n, json.dumps(BASE | {"gate": BASE["gate"] | f})) for n, (f, _) in FAULTS.items()] + [("verdict", json.dumps(BASE | {"verdict": "NOT GO"})), ("gone", None)], "name string, json string")
    recomputed = spark.createDataFrame([(n, json.dumps(BASE)) for n in [*FAULTS, "verdict", "gone"]], "name string, json string")
    got = {}
    for r in audits.audit(published, recomputed, ["name"]).collect():
        got.setdefault(r.name, set()).add((r.path, r.reason))
    want = {n: f for n, (_, f) in FAULTS.items() if f} | {"verdict": {("verdict", "differs")}, "gone": {(p, "not published") for p in flat(BASE)}}
    assert got == want


def test_gate_summary_of_plain_numbers(spark):
    rows = [("x", s, 0.4, d) for s, ds in enumerate([(0.2, 0.1, 0.0), (0.3, 0.1), (0.15, 0.25)]) for d in ds] + [("y", 0, 0.99, 0.1), ("y", 1, 0.99, -0.1)]
    found = {r.g: json.loads(r.json) for r in audits.gate_summary(spark.createDataFrame(rows, "g string, seed int, control double, delta double"), ["g"], "seed").collect()}
    gate = found["x"]["gate"]
    assert found["x"]["verdict"] == "GO" and gate["pairs_complete"] == 3 and gate["validity"] == "clear"
    assert gate["mean_delta"] == pytest.approx((0.1 + 0.2 + 0.2) / 3) and gate["receipt_level"]["n"] == 7
    assert gate["receipt_level"]["sign_test"] == {"wins": 6, "losses": 0, "ties": 1, "p": pytest.approx(1 / 64)}
    assert gate["cluster_level"]["ci95"][0] == pytest.approx(1 / 6 - 4.302653 * 0.057735 / 3**0.5, abs=1e-5)
    assert found["y"]["verdict"] == "NOT GO" and found["y"]["gate"]["validity"] == "tripped"


TEXTS = [
    "12 offline tests\n", "a\n7\n offline tests 8 test\ngreen", "Test suite:\n\n 190 green, 190-tests and 5-test\nsuite", "3-testy 4-test 5-tests.", "12 12 tests green 12-test suite",
    "", "\n" * 50 + "1 tests green" + "\n" * 50 + "2 tests green\r\n3  test  green", "x" * 5000 + "9 offline tests" + "y" * 5000, "1 offline tests2 offline tests\n3 offline tests",
]


def plain_claims(text):
    out = []
    for i, p in enumerate(audits.CLAIMS):
        out += [(i, text[: m.start()].count("\n") + 1, m[1]) for m in re.finditer(p, text)]
    return out


def test_claims_of_all_patterns_in_one_scan(spark, tmp_path):
    spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id int, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = audits.claims(docs)
    assert sorted(map(tuple, found.collect())) == sorted((i, *c) for i, t in enumerate(TEXTS) for c in plain_claims(t))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan
    stale = audits.stale_claims(docs, 190).collect()
    assert sorted(map(tuple, stale)) == sorted((i, *c) for i, t in enumerate(TEXTS) for c in plain_claims(t) if c[2] != "190")
    by_column = audits.stale_claims(docs.where("doc_id = 4"), F.col("doc_id") * 3).count()
    assert by_column == 0

    def plain(text):
        for p in audits.CLAIMS:
            text = re.sub(p, lambda m: m[0].replace(m[1], "190", 1), text)
        return text

    right = {r.doc_id: r.text for r in audits.corrected(docs, 190).collect()}
    assert right == {i: plain(t) for i, t in enumerate(TEXTS)} | {99: None}
    assert audits.stale_claims(audits.corrected(docs, 190), 190).count() == 0


def test_a_long_text_takes_time_in_proportion(spark):
    import time

    docs = spark.createDataFrame([(1, "lorem 17 ipsum\n" * 100_000 + "5 tests green")], "doc_id int, text string")
    began = time.time()
    assert [tuple(r) for r in audits.claims(docs).collect()] == [(1, 1, 100_001, "5")]
    assert time.time() - began < 30
