"""Banking into a table with versions: what is in place, what was, and who is refused."""

import pytest

from tallyloom.operators import merges
from tallyloom.sources.versions import Refused, Versions

SCHEMA = "k int, seed int, arm string, error string, device string, dtype string, mean double"


def records(spark, *rows):
    return spark.createDataFrame([(30, *r) for r in rows], SCHEMA)


def state(df):
    return {(r.seed, r.arm): (r.error, r.device, r["mean"]) for r in df.collect()}


@pytest.fixture
def versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"), ["k", "seed", "arm"], buckets=4)
    assert v.current() == 0
    assert v.bank(records(spark, (1, "adapted", None, "cpu", "fp32", 0.5), (2, "adapted", "oom", "cpu", "fp32", None), (3, "adapted", None, "gpu", "fp16", 0.7), (4, "adapted", None, "cpu", "fp32", 0.1))).version == 1
    return v


def test_banking_supersedes_refuses_and_keeps(spark, versions):
    found = versions.bank(records(spark, (1, "adapted", None, "cpu", "fp32", 0.9), (2, "adapted", None, "cpu", "fp32", 0.6), (3, "adapted", None, "cpu", "fp32", 0.8), (4, "adapted", "oom", "cpu", "fp32", None), (5, "adapted", None, None, None, 0.2)))
    assert found.version == 2
    assert {r.seed: r.action for r in found.actions.collect()} == {1: "conflict", 2: "supersede error", 3: "supersede environment", 4: "skip", 5: "add"}
    assert [r.seed for r in found.conflicts.collect()] == [1]
    now = state(versions.read())
    assert now == {(1, "adapted"): (None, "cpu", 0.5), (2, "adapted"): (None, "cpu", 0.6), (3, "adapted"): (None, "cpu", 0.8), (4, "adapted"): (None, "cpu", 0.1), (5, "adapted"): (None, None, 0.2)}
    assert state(versions.superseded(2)) == {(2, "adapted"): ("oom", "cpu", None), (3, "adapted"): (None, "gpu", 0.7)}
    assert len(state(versions.read(1))) == 4 and versions.superseded(1).count() == 0
    again = versions.bank(records(spark, (2, "adapted", None, "cpu", "fp32", 0.6)))
    assert again.version == versions.current() == 2  # nothing to bank, no version


def test_only_changed_buckets_are_written(spark, versions):
    before = versions.manifest(1)["buckets"]
    versions.bank(records(spark, (2, "adapted", None, "cpu", "fp32", 0.6)))
    after = versions.manifest(2)["buckets"]
    assert set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1


def test_the_second_of_two_writers_is_refused(spark, versions, tmp_path):
    read = versions.current()
    assert versions.bank(records(spark, (6, "adapted", None, "cpu", "fp32", 0.6)), based_on=read).version == 2
    data = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    with pytest.raises(Refused):
        versions.bank(records(spark, (7, "adapted", None, "cpu", "fp32", 0.7)), based_on=read)
    assert versions.current() == 2 and (6, "adapted") in state(versions.read()) and (7, "adapted") not in state(versions.read())
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == data
    assert not [p for p in (tmp_path / "t" / "versions").iterdir() if not p.name.endswith((".json", ".crc"))]
    assert versions.bank(records(spark, (7, "adapted", None, "cpu", "fp32", 0.7))).version == 3


def test_a_record_that_matches_its_partner_is_not_superseded(spark):
    old = records(spark, (1, "adapted", None, "cpu", "fp32", 0.5), (1, "kshot", None, "cpu", "fp32", 0.4), (2, "adapted", None, "cpu", "fp16", 0.5), (2, "kshot", None, "cpu", "fp32", 0.4), (3, "adapted", None, "cpu", "fp16", 0.5), (3, "kshot", "oom", "cpu", "fp16", None), (4, "adapted", None, "cpu", "fp16", 0.5))
    new = records(spark, *[(s, "adapted", None, "gpu", "fp32", 0.6) for s in (1, 2, 3, 4)])
    actions = merges.bank(old, new, ["k", "seed", "arm"], ["k", "seed"])
    assert {r.seed: r.action for r in actions.collect()} == {1: "conflict", 2: "supersede environment", 3: "supersede environment", 4: "supersede environment"}
    assert {r.action for r in merges.bank(old, new, ["k", "seed", "arm"]).collect()} == {"supersede environment"}
    assert sorted(actions.columns) == sorted([*new.columns, "action"])


def test_a_table_without_versions_and_an_empty_commit(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"), ["k", "seed", "arm"])
    with pytest.raises(ValueError, match="no version"):
        v.read()
    none = records(spark, (1, "adapted", "oom", "cpu", "fp32", None)).limit(0)
    assert v.bank(none).version == 0 and v.commit(none, 0) == 1 and v.read().count() == 0
