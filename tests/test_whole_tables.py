"""Catalogue queries against brute force on tables larger than the smallest ones: no row is left out."""

import math
import statistics
from fractions import Fraction

import pytest

from tallyloom.functions.stats import student_cdf, student_quantile, tail_at_least
from tallyloom.plans import arms, scores, tables_runs, tables_text

ORDERS, TENANTS = 4000, 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, i % TENANTS, "BUILDING") for i in range(10)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    rows = [(k, k % 10, "O", "2-HIGH", 1000.5 + k) for k in range(ORDERS)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(f"{at}/orders.parquet")
    return at


def pairs():
    """tenant, k, control, delta of all orders that both arms have, from the arms' closed form."""
    for k in range(ORDERS):
        if k % 97:
            control = 0.0 if k % 41 == 0 else sum((k * (j + 3) + j * j * 7) % 5 != 0 for j in range(5)) / 5
            yield k % 10 % TENANTS, k, control, sum((k * 29 + j * 13) % 23 != 0 for j in range(5)) / 5 - control


def by_tenant():
    return {t: [(c, x) for u, _, c, x in pairs() if u == t] for t in range(TENANTS)}


def counted(rows):
    return sum(x > 0.01 for _, x in rows), sum(x < -0.01 for _, x in rows), sum(abs(x) <= 0.01 for _, x in rows)


def tail(wins, n):
    return Fraction(sum(math.comb(n, k) for k in range(wins, n + 1)), 2**n)


def collected(df):
    return {r["tenant"]: r for r in df.collect()}


def test_sign_tests_count_every_pair(spark, folder):
    rows = by_tenant()
    got = collected(scores.sign_counts(spark, folder))
    assert {t: (r.wins, r.losses, r.ties) for t, r in got.items()} == {t: counted(x) for t, x in rows.items()}
    assert sum(map(sum, map(counted, rows.values()))) == sum(k % 97 != 0 for k in range(ORDERS)) and counted(rows[0])[0] + counted(rows[0])[1] > 1000
    two, one = collected(scores.sign_two_sided(spark, folder)), collected(scores.sign_one_sided(spark, folder))
    for t, x in rows.items():
        w, n = counted(x)[0], sum(counted(x)[:2])
        assert two[t].p == round(float(min(1, 2 * tail(max(w, n - w), n))), 6) and one[t].p == round(float(tail(w, n)), 6)


def test_verdicts_read_every_pair(spark, folder):
    g = collected(scores._gate_rows(spark, folder))
    for t, x in by_tenant().items():
        d = [y for _, y in x]
        assert (g[t].n, g[t].wins, g[t].losses) == (len(d), *counted(x)[:2])
        assert g[t]["mean"] == pytest.approx(statistics.fmean(d)) and g[t].control == pytest.approx(statistics.fmean(c for c, _ in x))
        assert g[t].low == pytest.approx(statistics.fmean(d) - 1.96 * statistics.stdev(d) / math.sqrt(len(d)))
    for query in (scores.gate_verdict, scores.gate_verdict_priority, scores.retention_reads):
        assert set(collected(query(spark, folder))) == set(range(TENANTS))


@pytest.mark.parametrize("n", [1001, 1500, 4001])
def test_tail_of_many_trials_equals_the_sum(n):
    for wins in (0, 1, n // 3, n // 2 - 1, n // 2, n // 2 + 1, n // 2 + 20, n // 2 + 150, n - 3, n, n + 1):
        assert tail_at_least(wins, n) == pytest.approx(float(tail(wins, n)), rel=1e-11)


def test_tail_of_very_many_trials_is_cheap():
    n = 10**9  # two standard deviations above the middle, by the normal law with a continuity correction
    wins = n // 2 + round(math.sqrt(n))
    assert tail_at_least(wins, n) == pytest.approx(math.erfc((wins - 0.5 - n / 2) / math.sqrt(n / 2)) / 2, rel=1e-6)


def test_pooled_t_takes_every_pair(spark, folder):
    d = [x for *_, x in pairs()]
    r = scores.pooled_ci_t(spark, folder).first()
    mean, se = statistics.fmean(d), statistics.stdev(d) / math.sqrt(len(d))
    low, high = 0.0, 3.0
    while high - low > 1e-10:
        low, high = ((low + high) / 2, high) if student_cdf((low + high) / 2, len(d) - 1) < 0.975 else (low, (low + high) / 2)
    q = round(low, 4)
    assert r.n == len(d) == sum(k % 97 != 0 for k in range(ORDERS))
    assert (r["mean"], r.se, r.low, r.high) == pytest.approx((mean, se, mean - q * se, mean + q * se), abs=1.1e-6)
    assert r.excludes_zero


@pytest.mark.parametrize("df", [1001, 3000, 40000])
def test_quantile_of_many_degrees_inverts_the_sums(df):
    for p in (0.9, 0.975, 0.995):
        assert student_cdf(student_quantile(p, df), df) == pytest.approx(p, abs=1e-11)


def test_quantile_of_very_many_degrees_is_normal():
    assert student_quantile(0.975, 10**9) == pytest.approx(statistics.NormalDist().inv_cdf(0.975), abs=1e-8)


def test_bag_overlap_of_every_order(spark, folder):
    want = {("tuned", k, sum((k * 29 + j * 13) % 23 != 0 for j in range(5))) for k in range(ORDERS)}
    want |= {("base", k, sum((k * (j + 3) + j * j * 7) % 5 != 0 for j in range(5))) for k in range(ORDERS) if k % 97 and k % 41}
    got = [tuple(r) for r in scores.bag_overlap(spark, folder).select("arm", "k", "shared").collect()]
    assert len(got) == len(want) and set(got) == want


def test_field_status_of_every_order(spark, folder):
    want = {(k, "more", "extra") for k in range(ORDERS)}
    want |= {(k, "status", "wrong" if k * 3 % 5 == 0 else "hit") for k in range(ORDERS)}
    want |= {(k, "priority", "miss" if k % 20 == 0 else "wrong" if (k * 4 + 7) % 5 == 0 else "hit") for k in range(ORDERS)}
    got = [tuple(r) for r in scores.field_diff_status(spark, folder).select("k", "path", "status").collect()]
    assert len(got) == len(want) and set(got) == want


def test_numbers_of_every_line(spark, tmp_path):
    rows = [(k, n, 1000.25 * k + n) for k in range(1, 40) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in tables_text.numeric_token_norm(spark, str(tmp_path)).select("k", "n", "plain", "grouped", "numeric").collect())
    assert got == [(k, n, str(int(v)), str(int(v)), True) for k, n, v in rows]


def test_running_total_of_every_event(spark, tmp_path):
    rows = [(i, "ab"[i % 3 == 0], i, i * 0.25) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in tables_text.running_totals(spark, str(tmp_path)).select("event_id", "event_type", "running").collect())
    assert got == [(i, t, sum(v for j, u, _, v in rows if u == t and j <= i)) for i, t, _, _ in rows]


def test_scoring_gets_more_tasks_not_larger_ones(spark, folder, monkeypatch):
    monkeypatch.setattr("tallyloom.tables.ROWS_A_TASK", 100)
    assert arms.gold(spark, folder).rdd.getNumPartitions() == ORDERS // 100
    monkeypatch.setattr("tallyloom.tables.ROWS_A_TASK", 10 * ORDERS)
    assert arms.gold(spark, folder).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert scores.wide_scores(spark, folder).count() == ORDERS


def test_three_arms_score_a_row_once(spark, folder):
    rows = tables_runs.three_arms(spark, folder)
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = {k: (c, c + x, 1 - c, c if k % 4 == 0 else None) for _, k, c, x in pairs() if k % 3}
    got = {r.k: (r.base, r.tuned, r.served, r.extra) for r in rows.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
