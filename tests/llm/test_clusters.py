import hashlib

import numpy as np
import pytest

from tallyloom.llm.clusters import clustered, nearest_centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v double, distance long"


def brute(rows, clusters, rounds, size):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, x in rows if x is not None and len(x) == size and None not in x and np.isfinite(x).all()]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [list(x) for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for k in range(len(centroids)):
            own = [x for (_, x), c in zip(kept, of, strict=True) if c == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted((-1 if i is None else i, nearest(x)[1], nearest(x)[0]) for i, x in kept), centroids


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "clash", 0.0, 1) for i, x in rows], SCHEMA)


def check(spark, rows, clusters=7, rounds=4, size=4):
    found, described = clustered(frame(spark, rows), clusters, rounds, size)
    want, centroids = brute(rows, clusters, rounds, size)
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in found.collect())
    assert got == want
    by = {r.cluster: r for r in described.collect()}
    assert [by[k].centroid for k in range(len(centroids))] == centroids
    for k, r in by.items():
        assert r.cluster_inertia == sum(d for _, c, d in want if c == k) and r.inertia == sum(d for *_, d in want)
        assert r.n_vectors == sum(c == k for _, c, _ in want)
    return by


def test_rounds_equal_a_plain_loop(spark):
    r = np.random.default_rng(1)
    check(spark, [(i, (r.normal(size=4) * r.choice([0.01, 1, 30])).tolist()) for i in range(300)])


def test_ties_copies_and_vectors_that_are_left_out(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.integers(-2, 3, 4) / 256).tolist()) for i in range(120)]
    rows += [(i, [0.0, 1 / 256, 0.0, 0.0]) for i in range(200, 320)] + [(5, [0.5] * 4), (5, [0.5] * 4), (None, [-3.0, 0.0, 0.0, 1.0])]
    rows += [(400, None), (401, []), (402, [1.0, 2.0, 3.0]), (403, [1.0, None, 0.0, 0.0]), (404, [float("nan")] * 4), (405, [float("inf")] * 4)]
    by = check(spark, rows, clusters=60)
    assert any(c.n_vectors == 0 and c.cluster_inertia == 0 for c in by.values())


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_clusters(spark, n):
    check(spark, [(i, [float(i), 0.0, 1.0, -1.0]) for i in range(n)])


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(3)
    check(spark, [(i, (r.normal(size=4) * 100_000).tolist()) for i in range(80)])


def test_the_annulus_saves_comparisons():
    r = np.random.default_rng(4)
    centroids = r.integers(-100, 100, (200, 8)) * (1 + np.arange(200))[:, None]
    x = centroids[r.integers(0, 200, 1000)] + r.integers(-3, 4, (1000, 8))
    cluster, distance, compared = nearest_centroids(x, centroids)
    d = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (distance == d.min(1)).all() and (cluster == d.argmin(1)).all()
    assert compared < 0.2 * d.size
