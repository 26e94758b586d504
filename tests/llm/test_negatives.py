import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.negatives import mine, planes, qualifying

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score double, window int"


def brute(rows, positives=5, negatives=10):
    ok = [(i, y, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, x, y in rows if i is not None and y is not None and x is not None and None not in x and np.isfinite(np.array(x, float)).all()]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))  # noqa: B905, E731
    anchors = {}
    for i, y, x in ok:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (y, x)), (y, x))
    out = []
    for i, (y, x) in anchors.items():
        other = sorted((-dot(x, b), j, z == y) for j, z, b in ok if j != i)
        for minus, p, _ in [o for o in other if o[2]][:positives]:
            fit = [(j, -s) for s, j, same in other if not same and 30 * -minus <= 100 * -s <= 90 * -minus][:negatives]
            out += [(i, p, r, j, -minus, s) for r, (j, s) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, x, y, "clash", 0.0, 1) for i, x, y in rows], SCHEMA)
    return sorted(map(tuple, mine(df, F.col("vec_id") % 100 == 0, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"block": 2, "first_shell": 20}])
def test_equals_a_plain_search(spark, options):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist(), int(r.integers(0, 4))) for i in range(700)]
    got = run(spark, rows, **options)
    assert got == brute(rows) and len(got) > 100


def test_ties_copies_and_rows_that_take_no_part(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-2, 3, 3).astype(float).tolist(), i % 3) for i in range(250)]
    rows += [(i, [1.0, 1.0, 0.0], i % 2) for i in range(300, 520)] + [(7, [1.0, 2.0, 0.0], 1)] * 3 + [(100, [1.0, 0.0, 2.0], 2), (100, [1.0, 0.0, 2.0], 2)]
    rows += [(600, None, 1), (700, [1.0, 1.0, 1.0], None), (800, [1.0, None, 1.0], 1), (900, [float("nan"), 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(1000, [], 1), (1001, [2.0], 1), (1100, [2.0, 2.0, 2.0, 2.0], 2)]
    assert run(spark, rows, first_shell=30) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(100 * i, [1.0, 2.0], 0) for i in range(n)]
    assert run(spark, rows) == brute(rows) == []


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=4) * 50_000).tolist(), i % 2) for i in range(220)]
    got = run(spark, rows)
    assert got == brute(rows) and max(g[4] for g in got) > 1 << 45


def test_planes_add_up_and_intervals_drop_pairs_early():
    r = np.random.default_rng(4)
    x = r.integers(-300, 300, (500, 16))
    assert (sum(w * b for w, b in planes(x)) == x).all()
    anchors = r.integers(-300, 300, (6, 16))
    score = x @ anchors.T
    low, high = np.sort(score, 0)[-20][:, None], np.sort(score, 0)[-5][:, None]
    row, anchor, found, taken = qualifying(x, planes(x), anchors, np.ones(score.shape, bool), low, high)
    inside = (score >= low.T) & (score <= high.T)
    assert {*zip(row.tolist(), anchor.tolist(), strict=True)} == {*zip(*map(list, np.nonzero(inside)), strict=True)}
    assert (found == score[row, anchor]).all() and taken < 0.75 * score.size * len(planes(x))
