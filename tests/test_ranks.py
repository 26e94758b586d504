"""Places, ranks and running sums against plain Python, on ties and skew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ranks, splits


def single(df):
    return df._jdf.queryExecution().toString().count("SinglePartition")


@pytest.fixture
def rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(3)
    data = [(i, r.choice([None, 7, 7, 7, 7, r.randint(0, 50)]), r.randint(0, 3)) for i in range(3000)]
    yield data, spark.createDataFrame(data, "id long, v int, w int").repartition(6)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_and_running_sums(spark, tmp_path, rows):
    data, df = rows
    placed = ranks.places(df, ["v", "id"], str(tmp_path / "a"))
    order = sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert {r.id: r.place for r in placed.collect()} == {x[0]: i for i, x in enumerate(order)}
    assert single(placed) == 0
    sums = {r.id: r.before for r in ranks.prefix_sums(df, ["v", "id"], "w", str(tmp_path / "b")).collect()}
    total = 0
    for i, _, w in order:
        assert sums[i] == total
        total += w
    spread = spark.read.parquet(str(tmp_path / "a")).groupBy(F.shiftright("id_", 33)).count().agg(F.max("count"), F.count("count")).first()
    assert spread[0] < 1500 and spread[1] > 2  # the value of two thirds of the rows is in several ranges
    assert ranks.places(df.limit(0), ["v", "id"], str(tmp_path / "c")).count() == 0


def test_shards_go_by_size_then_key(spark, tmp_path, rows):
    data, df = rows
    sharded = splits.shards(df, "v", "id", 4, str(tmp_path / "s"))
    order = sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert {r.id: r.shard for r in sharded.collect()} == {x[0]: i % 4 for i, x in enumerate(order)}
    assert sorted(sharded.columns) == ["id", "shard", "v", "w"] and single(sharded) == 0


def average(values):
    key = [(v is not None, v or 0) for v in values]
    order = sorted(range(len(values)), key=key.__getitem__)
    out = [0.0] * len(values)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and key[order[j]] == key[order[i]]:
            j += 1
        for x in order[i:j]:
            out[x] = (i + 1 + j) / 2
        i = j
    return out


def test_average_ranks_and_their_correlation(spark, tmp_path, rows):
    data, df = rows
    ranked = {r.v: (r.m, r["rank"]) for r in ranks.average_ranks(df, "v", str(tmp_path / "a")).collect()}
    want = average([x[1] for x in data])
    assert all(ranked[x[1]][1] == w for x, w in zip(data, want, strict=True))
    found = ranks.rank_correlation(df.withColumn("u", F.col("v") * 2 - F.col("w")), "v", "u", str(tmp_path / "b"))
    u = [None if x[1] is None else 2 * x[1] - x[2] for x in data]
    got = found.first()
    assert got.n == 3000 and got.rho == pytest.approx(np.corrcoef(want, average(u))[0, 1], abs=1e-12)
    constant = ranks.rank_correlation(df.withColumn("c", F.lit(1)), "v", "c", str(tmp_path / "c")).first()
    assert (constant.n, constant.rho) == (3000, 0.0)
    assert tuple(ranks.rank_correlation(df.limit(0), "v", "w", str(tmp_path / "d")).first()) == (0, 0.0)
