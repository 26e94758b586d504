"""Voting over pools of candidates. Every order ends in ``ordinal``, so ties fall to the earlier candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool(candidates: DataFrame, by: list[str], key: str, text: str = "text") -> DataFrame:
    """by, key, found_count, mean_lp, first (smallest ordinal), text of the
    member with the largest lp (of equals the earliest)."""
    best = F.min_by(text, F.struct((-F.col("lp")).alias("a"), F.col("ordinal").alias("b")))
    return candidates.groupBy(*by, key).agg(F.count(F.lit(1)).alias("found_count"), F.avg("lp").alias("mean_lp"), F.min("ordinal").alias("first"), best.alias(text))


def ranked_by_count_then_lp(pooled: DataFrame, by: list[str], n: int = 2) -> DataFrame:
    """Count, then mean log-probability, lexicographically."""
    order = Window.partitionBy(*by).orderBy(F.desc("found_count"), F.desc("mean_lp"), "first")
    return pooled.withColumn("attempt", F.row_number().over(order)).where(F.col("attempt") <= n)


def ranked_by_sum(pooled: DataFrame, by: list[str], n: int = 1) -> DataFrame:
    """Count plus mean probability, added: where exp underflows, pools of equal count tie."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("found_count") + F.exp("mean_lp")), "first")
    return pooled.withColumn("attempt", F.row_number().over(order)).where(F.col("attempt") <= n)


def first_seen(rows: DataFrame, by: list[str], key: str, ordinal: str = "ordinal") -> DataFrame:
    """Distinct keys with the ordinal at which each was first seen."""
    return rows.groupBy(*by, key).agg(F.min(ordinal).alias("first"))


def union_of_pools(searched: DataFrame, greedy: DataFrame, by: list[str], key: str) -> DataFrame:
    """Search results, and the greedy one last if it is new."""
    late = greedy.withColumn("ordinal", F.lit(1 << 30))
    return first_seen(searched.select(*by, key, "ordinal").unionByName(late.select(*by, key, "ordinal")), by, key)


def with_fallback(rows: DataFrame, parts: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` (key, value) with the value of ``parts`` where it has one."""
    return rows.join(parts.select(key, F.col(value).alias("part_")), key, "left").withColumn(value, F.coalesce("part_", value)).drop("part_")


def submission(attempts: DataFrame, task: str = "task_id", output: str = "output", fallback: str = "[[0]]") -> DataFrame:
    """One row, json: every task with its two attempts; the second copies the first where there is none."""
    two = attempts.groupBy(task).agg(F.max(F.when(F.col("attempt") == 1, F.col(output))).alias("a"), F.max(F.when(F.col("attempt") == 2, F.col(output))).alias("b"))
    entry = F.array(F.struct(F.coalesce("a", F.lit(fallback)).alias("attempt_1"), F.coalesce("b", "a", F.lit(fallback)).alias("attempt_2")))
    return two.select(F.col(task), F.to_json(F.struct(entry.alias("v"))).alias("json"))


def submission_entries(attempts: DataFrame, task: str = "task_id", test: str = "test_index", grid: str = "grid") -> DataFrame:
    """task, entries (JSON text): of every task a list with an object for each test,
    in order of ``test``: the grids of attempt 1 and 2. The first is [[0]] where
    there is none, the second copies the first. ``attempts``: task, test, attempt
    (1, 2; of repeated ones the smallest grid), grid."""
    at = lambda n: F.min(F.when(F.col("attempt") == n, F.col(grid)))
    two = attempts.groupBy(task, test).agg(F.coalesce(at(1), F.array(F.array(F.lit(0)))).alias("a"), at(2).alias("b"))
    entry = F.struct(F.col("a").alias("attempt_1"), F.coalesce("b", "a").alias("attempt_2"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(F.col(test).alias("t"), entry.alias("e")))), lambda x: x["e"])
    return two.groupBy(task).agg(F.to_json(in_order).alias("entries"))
