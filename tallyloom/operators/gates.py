"""Decisions over run records: receipts by rung, the difficulty law, rehearsals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import pairing, ranks, verdicts

#: The seeds that were frozen for the environment gate, and how many cells stand at each end of the law.
FROZEN_SEEDS, ENDS = (203, 204, 206, 207, 208, 209), 4


def frozen_plan(spark: SparkSession, k: int, seeds: Sequence[int] = FROZEN_SEEDS) -> DataFrame:
    """k, seed: what a gate of frozen seeds designs; no other seed decides, and one that is missing is missed."""
    return spark.createDataFrame([(k, s) for s in seeds], "k int, seed int")


def receipts(plan: DataFrame, runs: DataFrame, treated: str, control: str, gate_k: int = 10, by: str = "rung") -> DataFrame:
    """``by``, designed, complete, blocked (the seeds whose arms were measured in
    different environments), mean_delta, verdict, status of the receipts gate:
    undecidable unless every designed pair of ``gate_k`` is complete. ``plan``:
    by, k, seed; ``runs``: also arm, error, device, dtype, mean."""
    pairs = pairing.pair_status(plan.where(F.col("k") == gate_k), runs, [by, "k", "seed"], treated, control)
    paired = F.col("status") == "paired"
    blocked = F.array_sort(F.collect_list(F.when(F.col("status") == "heterogeneous", F.col("seed"))))  # of the designed seeds, few
    out = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("designed"), F.count_if(paired).alias("complete"), blocked.alias("blocked"), F.avg(F.round("delta", 4)).alias("mean_delta"))
    open_ = F.col("designed") - F.col("complete")
    status = F.when(open_ > 0, F.format_string("undecidable: %d/%d gating pairs complete", "complete", "designed"))
    return out.withColumn("mean_delta", F.when(open_ == 0, F.col("mean_delta"))).withColumn("verdict", verdicts.receipts_gate(open_, F.col("mean_delta"))).withColumn("status", status)


def ends_gap(cells: DataFrame, base: str, delta: str, n: int = ENDS) -> DataFrame:
    """gap: the mean of ``delta`` over the ``n`` cells of the smallest (base, delta)
    less that over the ``n`` of the largest; fewer cells stand on both sides."""
    mean = lambda order, name: cells.orderBy(*order).limit(n).agg(F.avg(delta).alias(name))
    ends = mean([F.asc(base), F.asc(delta)], "low_").join(F.broadcast(mean([F.desc(base), F.desc(delta)], "high_")))  # a row each
    return ends.select((F.col("low_") - F.col("high_")).alias("gap"))


def difficulty(cells: DataFrame, base: str = "base", delta: str = "delta") -> DataFrame:
    """cells, spread, rho, gap, verdict of the law that harder cells gain more.
    Cells are read several times, so they are computed and written once."""
    at = scratch.folder(cells.sparkSession, "cells")
    cells.select(base, delta).write.parquet(at)
    cells = cells.sparkSession.read.parquet(at)
    size = cells.agg(F.count(F.lit(1)).alias("cells"), (F.max(base) - F.min(base)).alias("spread"))
    one = size.join(F.broadcast(ranks.rank_correlation(cells, base, delta).select("rho"))).join(F.broadcast(ends_gap(cells, base, delta)))  # a row each
    return one.withColumn("verdict", verdicts.difficulty(F.col("cells"), F.col("spread"), F.col("rho"), F.col("gap")))


def rehearsal(deltas: DataFrame, by: list[str], k: str | None = None) -> DataFrame:
    """by, n, mean, p, verdict, advice and, with a column ``k`` among ``by``, role:
    a rehearsal passes on its mean and a one-sided sign test; the interval is
    reported. ``deltas``: by, treated, control, delta."""
    out = pairing.summary(deltas, by, "t_exact", "sign1_eps")
    out = out.withColumn("verdict", verdicts.rehearsal(F.col("mean"), F.col("p"), F.col("wins"), F.col("losses"))).withColumn("advice", verdicts.advice(F.col("control"), F.col("mean")))
    return out if k is None else out.withColumn("role", verdicts.role(F.col(k)))
