import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import grids
from tallyloom.operators import corpora, merges, scoring, search, splits, votes


def grid_ops(g, rotations, flip):
    for _ in range(rotations % 4):
        g = [list(r) for r in zip(*g[::-1], strict=True)]
    return [r[::-1] for r in g] if flip else g


@pytest.fixture(scope="module")
def grid_frame(spark):
    r = random.Random(1)
    rows = []
    for i in range(20):
        h, w = r.randint(1, 6), r.randint(1, 6)
        g = [[r.randint(0, 9) for _ in range(w)] for _ in range(h)]
        palette = list(range(10))
        r.shuffle(palette)
        rows += [(i, g, k, f, palette) for k in range(5) for f in (False, True)]
    return rows, spark.createDataFrame(rows, "i int, g array<array<int>>, k int, f boolean, p array<int>")


def test_dihedral_elements_and_round_trips(grid_frame):
    rows, df = grid_frame
    k, f, p, g = (F.col(c) for c in "kfpg")
    got = df.select("i", "k", "f", grids.dihedral(g, k, f).alias("d"), grids.undo_dihedral(grids.dihedral(g, k, f), k, f).alias("u"), grids.restored(grids.augmented(g, k, f, p), k, f, p).alias("a"), "g", grids.from_text(grids.text(g)).alias("t"), grids.cells(g).alias("n")).collect()
    want = {(i, k, f): grid_ops(g, k, f) for i, g, k, f, _ in rows}
    for x in got:
        assert x.d == want[x.i, x.k, x.f] and x.u == x.a == x.t == x.g and x.n == len(x.g) * len(x.g[0])


def test_known_turn_and_validity(spark):
    cases = [([[1, 2], [3, 4]], True), ([[1], [1, 2]], False), ([[11]], False), ([], False), ([[]], False), ([[None]], False), (None, False), ([[1] * 31], False)]
    df = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(cases)], "i int, g array<array<int>>")
    assert [x.v for x in df.orderBy("i").select(grids.valid(F.col("g")).alias("v")).collect()] == [v for _, v in cases]
    assert df.where("i = 0").select(grids.turned(F.col("g")).alias("t")).first().t == [[3, 1], [4, 2]]
    texts = spark.createDataFrame([(" 12 \n\n34",), ("1x",), ("",)], "t string").select(grids.from_text(F.col("t")).alias("g")).collect()
    assert [x.g for x in texts] == [[[1, 2], [3, 4]], None, None]


POOL = "q int, ordinal int, key string, text string, lp double"


def test_vote_rules(spark):
    rows = [(1, 0, "a", "a1", -1.0), (1, 1, "b", "b1", -0.1), (1, 2, "a", "a2", -0.5), (2, 0, "a", "a", -2.0), (2, 1, "b", "b", -1.0), (3, 0, "a", "a", -1.0), (3, 1, "b", "b", -1.0), (4, 0, "a", "a", -900.0), (4, 1, "b", "b", -800.0)]
    pooled = votes.pool(spark.createDataFrame(rows, POOL), ["q"], "key")
    top = {x.q: (x.key, x.text) for x in votes.ranked_by_count_then_lp(pooled, ["q"], 1).collect()}
    added = {x.q: x.key for x in votes.ranked_by_sum(pooled, ["q"]).collect()}
    assert top == {1: ("a", "a2"), 2: ("b", "b"), 3: ("a", "a"), 4: ("b", "b")}
    assert added == {1: "a", 2: "b", 3: "a", 4: "a"}  # exp underflows: the earlier wins


def test_union_fallback_and_submission(spark):
    s = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "q int, key string, ordinal int")
    g = spark.createDataFrame([(1, "y", 0), (1, "z", 0)], "q int, key string, ordinal int")
    assert [x.key for x in votes.union_of_pools(s, g, ["q"], "key").orderBy("first").collect()] == ["x", "y", "z"]
    a = spark.createDataFrame([("t", 1, "A"), ("u", 1, "B"), ("u", 2, "C")], "task_id string, attempt int, output string")
    got = {x.task_id: x.json for x in votes.submission(a).collect()}
    assert '"attempt_2":"A"' in got["t"] and '"attempt_2":"C"' in got["u"]
    rows, parts = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "f"), (2, "f")], [(1, "p"), (2, None)]))
    assert {x.k: x.v for x in votes.with_fallback(rows, parts, "k", "v").collect()} == {1: "p", 2: "f"}


def test_corpora(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e"), (2, 0, "user", "z")], "conv_id int, turn int, role string, text string")
    assert {x.conv_id: x.chat for x in corpora.chat_raw(turns, open_turn=True).collect()}[2] == "<|user|>z<|assistant|>"
    merged = corpora.merge_roles(turns)
    assert [(x.turn, x.role, x.text) for x in merged.where("conv_id = 1").orderBy("turn").collect()] == [(0, "user", "a\nb"), (1, "assistant", "c"), (2, "user", "d"), (3, "assistant", "e")]
    p = corpora.exchanges(merged)
    assert corpora.leave_one_out(p).count() == 2
    demo = corpora.demonstration_turns(p).where("held = 0").orderBy("turn").collect()
    assert [(x.turn, x.role, x.text) for x in demo] == [(0, "user", "d"), (1, "assistant", "e"), (2, "user", "a\nb")]
    assert corpora.demonstration_turns(p, include_demos=False).count() == 2
    assert corpora.document_pairs(p).count() == 4


def test_splits(spark):
    rows = spark.createDataFrame([(i, f"d{i}") for i in range(50)], "n int, id string")
    order = list(range(50))
    random.Random(11).shuffle(order)
    got = {x.n for x in splits.seeded_split(rows, "n", 12, 11).where("split = 'train'").collect()}
    assert got == set(order[:12])
    with pytest.raises(ValueError, match="between 1 and 49"):
        splits.seeded_split(rows, "n", 50, 1)
    h = splits.hash_split(rows, "id", 10)
    assert h.where("split = 'train'").count() == 10 and sorted(h.columns) == ["id", "n", "split"]
    dealt = splits.shards(rows.withColumn("size", F.col("n") % 7), "size", "n", 4).groupBy("shard").count().collect()
    assert sorted(x["count"] for x in dealt) == [12, 12, 13, 13]
    assert splits.remaining(rows, rows.where("n < 45"), ["id"]).count() == 5


def test_claimed_counts_name_the_line(spark):
    df = spark.createDataFrame([("a", "190 tests\nx 12 tests\n190 tests and 7 tests")], "doc_id string, text string")
    assert {(x.line, x.claimed) for x in merges.claimed_counts(df, "([0-9]+) tests", 190).collect()} == {(2, "12"), (3, "7")}


def test_bounded_paths_equal_brute_force(spark):
    r = random.Random(2)
    logits = [(q, s, [r.gauss(0, 2) for _ in range(5)]) for q in range(6) for s in range(3)]
    df = spark.createDataFrame(logits, "q int, step int, logits array<double>")
    got = {(x.q, tuple(x.path)) for x in search.bounded_paths(search.expansions(df, ["q", "step"], 5.0), ["q"], 5.0, 3).collect()}
    nll = {}
    for q, s, v in logits:
        z = math.log(sum(map(math.exp, v)))
        nll[q, s] = [z - x for x in v]
    want = {(q, p) for q in range(6) for n in (1, 2, 3) for p in itertools.product(range(5), repeat=n) if sum(nll[q, s][t] for s, t in enumerate(p)) < 5.0}
    assert got == want and want


def test_a_seeded_shuffle_refuses_large_tables(spark, monkeypatch):
    monkeypatch.setattr(splits, "MOST_SHUFFLED", 5)
    with pytest.raises(ValueError, match="use hash_split"):
        splits.seeded_split(spark.range(6), "id", 2, 1)


def test_requests_and_conflicts(spark):
    plan = spark.createDataFrame([(30, 1, "a"), (10, 2, "b")], "k int, seed int, arm string")
    assert merges.requested(plan, "").count() == 2 and merges.requested(plan, "30:1:a").count() == 1
    with pytest.raises(ValueError, match="k:seed:arm"):
        merges.requested(plan, "30:1")
    old = spark.createDataFrame([(1, None, "cpu", "fp32", 0.5)], "id int, error string, device string, dtype string, mean double")
    with pytest.raises(Exception, match="conflicting results"):
        merges.refuse_conflicts(merges.bank(old, old.withColumn("mean", F.lit(0.6)), ["id"])).collect()


def test_a_score_of_an_unknown_text_raises(spark):
    texts, gold = spark.createDataFrame([("h-1", "t")], "id string, text string"), spark.createDataFrame([("h-1", "{}")], "id string, gold string")
    known = spark.createDataFrame([("h-1", 0.5)], "id string, sp double")
    assert scoring.field_audit(texts, gold, {}, known).first().tier == "hard"
    with pytest.raises(Exception, match="isn't in the holdout"):
        scoring.field_audit(texts, gold, {}, known.union(spark.createDataFrame([("x", 1.0)], "id string, sp double"))).collect()


def test_what_lambdas_share_is_computed_once(spark):
    from tallyloom.functions import grids

    df = spark.createDataFrame([("12\n34", [1.0, 2.0]), ("12\n3", [0.0]), ("1a", []), ("", None), (None, [5.0])], "t string, x array<double>")
    out = df.select(grids.valid(grids.from_text(F.col("t"))).alias("v"), search.log_softmax(F.col("x")).alias("p"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(t") == 1 and plan.count("array_max(") == 1 and plan.count("aggregate(") == 1
    rows = out.collect()
    assert [r.v for r in rows] == [True, False, False, False, False]
    assert [None if r.p is None else [round(z, 6) for z in r.p] for r in rows] == [[-1.313262, -0.313262], [0.0], [], None, [0.0]]


def test_completed_paths_join_the_last_step_with_the_stop_alone(spark):
    rows = [(q, s, t, 1.0 + ((q * 7 + s * 5 + t * 3) % 11) / 10) for q in range(3) for s in range(3) for t in range(4)]
    steps = spark.createDataFrame(rows, "q int, step int, token int, nll double")
    cost = {r[:3]: r[3] for r in rows}
    want = {}
    for q in range(3):
        for path in [(), *[(a,) for a in range(3)], *[(a, b) for a in range(3) for b in range(3)]]:
            total = sum(cost[q, i, t] for i, t in enumerate((*path, 3)))
            if total < 4.25:
                want[q, path] = round(total, 9)
    found = search.completed_paths(steps, ["q"], 4.25, 3, 3)
    assert {(r.q, tuple(r.path)): round(r.nll, 9) for r in found.collect()} == want and len(want) > 5
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3  # two for what ends, one for what goes on
