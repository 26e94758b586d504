"""Deterministic splits, shards and resumption."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

#: Rows of a seeded shuffle, whose positions one process lists.
MOST_SHUFFLED = 1_000_000


def hash_split(rows: DataFrame, key: str, k: int, seed: str = "split") -> DataFrame:
    """``rows`` with split: train for the ``k`` smallest SHA-256 of seed and key, else holdout."""
    order = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    train = rows.select(F.col(key).alias("k_"), order.alias("h_")).orderBy("h_", "k_").limit(k).select("k_", F.lit("train").alias("split_"))
    return rows.join(train, rows[key] == train["k_"], "left").withColumn("split", F.coalesce("split_", F.lit("holdout"))).drop("k_", "split_")


def seeded_split(rows: DataFrame, order: str, k: int, seed: int) -> DataFrame:
    """``rows`` with split, as a shuffle of the positions 0..n-1 by Python's
    Mersenne Twister gives it: the first ``k`` are train. One source draws for
    all positions in turn, so the draw can't be split; it is meant for challenge
    kits and refuses tables of over ``MOST_SHUFFLED`` rows."""
    n = rows.count()
    if n > MOST_SHUFFLED:
        raise ValueError(f"{n} rows; a seeded shuffle takes {MOST_SHUFFLED} at most: use hash_split")
    if not 1 <= k <= n - 1:
        raise ValueError(f"k must lie between 1 and {n - 1}, not {k}")
    positions = list(range(n))
    random.Random(seed).shuffle(positions)
    train = rows.sparkSession.createDataFrame(pd.DataFrame({"p_": sorted(positions[:k])}), "p_ long")
    numbered = rows.withColumn("n_", F.row_number().over(Window.orderBy(order)) - 1)
    chosen = train.withColumn("t_", F.lit(True))
    return numbered.join(chosen, numbered["n_"] == chosen["p_"], "left").withColumn("split", F.when(F.col("t_"), "train").otherwise("holdout")).drop("n_", "p_", "t_")


def shuffled_slices(rows: DataFrame, order: str, k: int, n: int, seed: int) -> DataFrame:
    """The first ``k`` rows of a shuffle (split train) and the next ``n`` (split
    eval), index from 0 within each: as Python's Mersenne Twister shuffles the rows
    in ``order``. Fewer than ``k + n`` rows are an error, as are over ``MOST_SHUFFLED``."""
    size = rows.count()
    if not k + n <= size <= MOST_SHUFFLED:
        raise ValueError(f"{size} rows; {k + n} to {MOST_SHUFFLED} are needed")
    positions = list(range(size))
    random.Random(seed).shuffle(positions)
    chosen = [(p, "train" if i < k else "eval", i if i < k else i - k) for i, p in enumerate(positions[: k + n])]
    slices = rows.sparkSession.createDataFrame(chosen, "place_ long, split string, index int")
    return ranks.places(rows, [order], into="place_").join(slices, "place_").drop("place_")


def arm_plan(seeds: DataFrame, ks: list[int], arms: list[str]) -> DataFrame:
    """k, seed, arm: everything that is to be run, for every row of ``seeds`` (seed)."""
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    return seeds.select("seed").withColumn("k", each(ks)).withColumn("arm", each(arms)).select("k", "seed", "arm")


def resumed(done: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``done`` and what ``fresh`` has beyond it, with place: the order by ``key``
    of all results, as an uninterrupted run would have given them."""
    return ranks.places(done.unionByName(fresh.join(done.select(*key), key, "left_anti")), key)


def remaining(plan: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned work that the journal doesn't have."""
    return plan.join(done.select(*key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value of the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def shards(rows: DataFrame, size: str, key: str, workers: int, at: str | None = None) -> DataFrame:
    """``rows`` with shard: dealt in turn, smallest first, equal sizes by ``key``.
    Written (see ``ranks``) in ranges of (size, key), so no size is too frequent."""
    return ranks.places(rows, [size, key], at, "place_").withColumn("shard", (F.col("place_") % workers).cast("int")).drop("place_")


def binned_running_sums(rows: DataFrame, by: str, order: str, value: str, width: int, into: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` per ``by`` along an integer
    ``order``. Bins of ``width`` are summed first and their sums prefix-summed,
    so that a task orders one bin, however many rows a group has."""
    binned = rows.withColumn("bin_", F.floor(F.col(order) / width))
    sums = binned.groupBy(by, "bin_").agg(F.sum(value).alias("s_"))
    before = sums.withColumn("b_", F.coalesce(F.sum("s_").over(Window.partitionBy(by).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("s_")
    inside = Window.partitionBy(by, "bin_").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return binned.withColumn("i_", F.sum(value).over(inside)).join(before, [by, "bin_"]).withColumn(into, F.col("b_") + F.col("i_")).drop("bin_", "i_", "b_")


def counts_before(rows: DataFrame, by: str, value: str, *sums: tuple[str, str]) -> DataFrame:
    """by, value, m (rows of the value), before (rows of smaller ones), n (rows of
    the group) and (name, column) sums: a histogram, from which ranks and quantiles
    are read without ordering rows."""
    h = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("m"), *[F.sum(c).alias(name) for name, c in sums])
    w = Window.partitionBy(by)
    return h.withColumn("before", F.coalesce(F.sum("m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("m").over(w))
