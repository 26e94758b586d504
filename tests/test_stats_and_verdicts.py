import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.stats import student_quantile, t_exact, t_table, tail_at_least
from tallyloom.operators import merges, pairing, verdicts


def test_student_quantiles():
    pins = {1: 12.7062, 2: 4.3027, 5: 2.5706, 10: 2.2281, 30: 2.0423, 60: 2.0003, 157: 1.9752}
    assert {n: round(student_quantile(0.975, n), 4) for n in pins} == pins
    assert math.isnan(student_quantile(0.975, 0))


def test_quantile_columns(spark):
    row = spark.createDataFrame([(45,)], "n int").select(t_exact("n").alias("a"), t_table("n").alias("b")).first()
    assert row.a == 2.0141 and row.b == 2.021


def test_binomial_tail():
    assert tail_at_least(0, 5) == 1.0 and tail_at_least(5, 5) == 1 / 32
    assert tail_at_least(600, 600) == pytest.approx(2.0**-600)


def deltas(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, delta double")


def test_sign_variants_differ(spark):
    df = deltas(spark, [0.5] * 20 + [0.005] * 3 + [-0.5])
    two = pairing.sign_test(df, [], "sign2_tol01").first()
    one = pairing.sign_test(df, [], "sign1_eps").first()
    assert (two.wins, two.losses, two.ties) == (20, 1, 3) and (one.wins, one.losses, one.ties) == (23, 1, 0)
    assert two.p == pytest.approx(2 * 22 / 2**21) and one.p == pytest.approx(25 / 2**24)
    assert pairing.sign_test(df, [], "sign2_tol01_r4").first().p == 0.0
    none = deltas(spark, [0.0])
    assert pairing.sign_test(none, [], "sign2_tol01").first().p is None and pairing.sign_test(none, [], "sign1_eps").first().p == 1.0


def test_single_value_has_no_spread(spark):
    row = pairing.pooled(deltas(spark, [0.3]), [], "z196").first()
    assert row.se == 0 and row.excludes_zero


def test_jackknife_of_too_few_is_null(spark):
    assert pairing.without_largest(deltas(spark, [1, 2]), [], 2, ["i"]).first().jackknife_mean is None


def test_spearman_against_ranks(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 9), r.randint(0, 4)) for _ in range(80)]
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    a, b = rank([x for x, _ in rows]), rank([y for _, y in rows])
    ma, mb = sum(a) / 80, sum(b) / 80
    want = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert pairing.spearman(spark.createDataFrame(rows, "x int, y int"), "x", "y").first().rho == pytest.approx(want)
    assert pairing.spearman(spark.createDataFrame([(1, 2), (1, 3)], "x int, y int"), "x", "y").first().rho == 0.0


ARM = "seed int, arm string, error string, device string, dtype string, mean double"


def test_pair_status_order(spark):
    plan = spark.createDataFrame([(i,) for i in range(6)], "seed int")
    arms = [(0, "a", None, "cpu", "fp32", 0.9), (0, "b", None, "cpu", "fp32", 0.5), (1, "a", None, "cpu", "fp32", 0.9), (2, "a", "oom", "gpu", "fp16", None), (2, "b", None, "cpu", "fp32", 0.5),
            (3, "a", None, "cpu", "fp16", 0.9), (3, "b", None, "cpu", "fp32", 0.5), (4, "a", None, None, None, 0.9), (4, "b", None, None, None, 0.5), (5, "a", None, "cpu", "fp32", 0.9), (5, "b", None, None, "fp32", 0.5)]
    got = {x.seed: (x.status, x.delta) for x in pairing.pair_status(plan, spark.createDataFrame(arms, ARM), ["seed"], "a", "b").collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "paired", 1: "missing", 2: "errored", 3: "heterogeneous", 4: "paired", 5: "heterogeneous"}
    assert got[0][1] == pytest.approx(0.4) and got[1][1] is None


def test_lopsided_attrition(spark):
    rows = [(1, i, a, None if (a == "a" and i == 2) else 1.0) for i in range(4) for a in "ab"]
    x = pairing.attrition(spark.createDataFrame(rows, "seed int, index int, arm string, micro_f1 double"), ["seed"], "index", "a", "b").first()
    assert (x.designed, x.scored, x.excluded, x.symmetric) == (4, 3, 1, False)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_gate_priority(spark):
    lit = F.lit
    g = lambda **k: one(spark, verdicts.gate(*[lit(k.get(n, v)) for n, v in (("trips", 0), ("blocked", 0), ("mean", 0.4), ("low", 0.3), ("p", 0.01), ("wins", 9), ("losses", 1))]))
    assert g() == "GO" and g(trips=1, blocked=1) == "UNINFORMATIVE" and g(blocked=1) == "UNDECIDABLE"
    assert g(mean=0.04) == g(low=-0.1) == g(p=0.05) == g(wins=1, losses=1) == "PIVOT"


def test_other_verdicts(spark):
    lit = F.lit
    assert [one(spark, verdicts.validity(lit(x))) for x in (0.1, 0.15, 0.95, 0.96)] == ["floor", "ok", "ok", "ceiling"]
    d = lambda *x: one(spark, verdicts.difficulty(*map(lit, x)))
    assert [d(9, 0.5, -0.9, 0.5), d(10, 0.5, -0.9, 0.5), d(10, 0.5, -0.9, 0.0), d(10, 0.5, 0.0, 0.0)] == ["UNINFORMATIVE", "PASS", "PARTIAL", "REFUTED"]
    assert one(spark, verdicts.receipts_gate(lit(1), lit(0.9))) == "UNDECIDABLE"
    assert one(spark, verdicts.retention(lit(-0.05), lit(3), lit(3))) == "PASS"
    assert one(spark, verdicts.unified(lit(None).cast("double"), lit(0.1), lit(3), lit(1))) == "REFUSED"
    assert one(spark, verdicts.rehearsal(lit(0.0997), lit(0.2905), lit(8), lit(5))) == "FAIL"
    assert [one(spark, verdicts.p_text(lit(x).cast("double"))) for x in (None, 1e-20, 0.25)] == ["n/a", "< 1e-15", "0.2500"]
    assert [one(spark, verdicts.role(lit(k))) for k in (10, 30)] == ["secondary", "decision"]


def test_banking(spark):
    old = [(1, "a", "oom", "cpu", "fp32", None), (2, "a", None, "cpu", "fp16", 0.5), (3, "a", None, "cpu", "fp32", 0.5), (4, "a", None, "cpu", "fp32", 0.5), (5, "a", None, "cpu", "fp32", 0.5)]
    new = [(1, "a", None, "cpu", "fp32", 0.7), (2, "a", None, "cpu", "fp32", 0.6), (3, "a", None, "cpu", "fp32", 0.6), (4, "a", None, "cpu", "fp32", 0.5), (5, "a", "oom", "cpu", "fp32", None), (6, "a", None, "cpu", "fp32", 0.1)]
    old, new = (spark.createDataFrame(x, ARM) for x in (old, new))
    actions = merges.bank(old, new, ["seed", "arm"])
    assert {x.seed: x.action for x in actions.collect()} == {1: "supersede error", 2: "supersede environment", 3: "conflict", 4: "skip", 5: "skip", 6: "add"}
    kept = {(x.seed, x.superseded): x["mean"] for x in merges.banked(old, new, ["seed", "arm"]).collect()}
    assert kept == {(1, True): None, (1, False): 0.7, (2, True): 0.5, (2, False): 0.6, (3, False): 0.5, (4, False): 0.5, (5, False): 0.5, (6, False): 0.1}
    with pytest.raises(Exception, match="conflicting"):
        merges.refuse_conflicts(actions).collect()


def test_audit_tolerance(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "seed int, mean double")
    b = spark.createDataFrame([(1, 0.5004), (2, 0.51), (4, 0.5)], "seed int, mean double")
    assert {x.seed for x in merges.mismatches(a, b, ["seed"], "mean").collect()} == {2, 3, 4}
