import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.neighbours import search

SCHEMA = "vec_id long, embedding array<float>, v string, score double"


def brute(rows, k=10):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for i, v in ok:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i)[:k]
            out[i] = near
    return out


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, "clash", 0.0) for i, v in rows], SCHEMA)
    got = {}
    for x in search(df, F.col("vec_id") % 100 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
        assert len(got[x.query_id]) == x["rank"]
    return got


def test_copies_ties_and_rows_that_take_no_part(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-3, 4, 4).astype(float).tolist()) for i in range(150)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 420)]
    rows += [(500, None), (501, []), (600, [0.0, 0.0, 0.0, 0.0]), (700, [1.0, None, 2.0, 3.0]), (800, [float("nan"), 1.0, 1.0, 1.0]), (900, [float("inf"), 1.0, 1.0, 1.0])]
    want, got = brute(rows), run(spark, rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for _, v in got[q]] == [v for _, v in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-12)


def test_recall_on_clusters(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(10, 32))
    x = centres[r.integers(0, 10, 3000)] + 0.5 * r.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute(rows), run(spark, rows)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(100 * i, [1.0 + i, 0.0]) for i in range(n)]
    got = run(spark, rows)
    assert all(len(x) == n - 1 for x in got.values())


def recall(spark, rows):
    want, got = brute(rows), run(spark, rows)
    return sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want) / sum(map(len, want.values()))


def test_one_huge_vector_spoils_no_other_row(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(10, 16))
    x = centres[r.integers(0, 10, 2000)] + 0.5 * r.normal(size=(2000, 16))
    x[1234] = 1e8
    assert recall(spark, [(i, v.tolist()) for i, v in enumerate(x)]) >= 0.95


def test_recall_in_a_dense_cluster_of_a_third(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(6000, 16))
    x[::3] = x[0] + 1e-5 * r.normal(size=(2000, 16))
    assert recall(spark, [(i, v.tolist()) for i, v in enumerate(x)]) >= 0.95


@pytest.mark.parametrize("kind", ["offset", "scales"])
def test_recall_far_from_the_origin_and_on_mixed_scales(spark, kind):
    r = np.random.default_rng(13)
    x = r.normal(size=(10, 16))[r.integers(0, 10, 2000)] + 0.5 * r.normal(size=(2000, 16))
    x = x + 1000 if kind == "offset" else x * 10.0 ** r.integers(-6, 7, (2000, 1))
    assert recall(spark, [(i, v.tolist()) for i, v in enumerate(x)]) >= 0.9
