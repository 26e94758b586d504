"""Bounded search over a table of log-probabilities that depend on the step alone.
``frontier`` searches with a predictor in the loop, and has the capped search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grids import once


def log_softmax(logits: Column) -> Column:
    """x - max - log(sum(exp(x - max)))."""
    log_total = lambda y: F.ln(F.aggregate(y, F.lit(0.0), lambda s, x: s + F.exp(x)))
    shifted = lambda v: once(F.array_max(v), lambda top: F.transform(v, lambda x: x - top))
    return once(once(logits, shifted), lambda y: once(log_total(y), lambda t: F.transform(y, lambda x: x - t)))


def expansions(logits: DataFrame, by: list[str], cutoff: float, column: str = "logits") -> DataFrame:
    """by, token, nll of the tokens whose negative log-probability is strictly below ``cutoff``."""
    return logits.select(*by, F.posexplode(log_softmax(F.col(column))).alias("token", "lp")).select(*by, "token", (-F.col("lp")).alias("nll")).where(F.col("nll") < cutoff)


def completed_paths(steps: DataFrame, by: list[str], cutoff: float, depth: int, stop: int) -> DataFrame:
    """by, path, nll: what ``stop`` completes within ``depth`` steps (the stop
    itself left out of the path) below the summed ``cutoff``. A path ends where
    it first stops; one that hasn't stopped by then is no candidate, so the last
    step is joined with the stop alone."""
    at = lambda k, token: steps.where((F.col("step") == k) & token).select(*by, "token", F.col("nll").alias("more"))
    stops, goes = F.col("token") == stop, F.col("token") != stop
    first = lambda token, path: at(0, token).select(*by, path.cast("array<int>").alias("path"), F.col("more").alias("nll")).where(F.col("nll") < cutoff)
    further = lambda k, token, path: frontier.join(at(k, token), by).where(F.col("nll") + F.col("more") < cutoff).select(*by, path.alias("path"), (F.col("nll") + F.col("more")).alias("nll"))
    out, frontier = first(stops, F.array()), first(goes, F.array("token"))
    for k in range(1, depth):
        out = out.union(further(k, stops, F.col("path")))
        if k < depth - 1:
            frontier = further(k, goes, F.concat("path", F.array("token")))
    return out


def stop_reasons(frames: DataFrame, candidates: DataFrame, by: list[str], cap: int) -> DataFrame:
    """by, candidates, reason of each frame: candidate_cap if it has ``cap``
    candidates or more, else exhausted. A deadline depends on the clock and isn't derived."""
    counts = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"))
    out = frames.select(*by).join(counts, by, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn("reason", F.when(F.col("candidates") >= cap, "candidate_cap").otherwise("exhausted"))


def cheapest(rows: DataFrame, by: list[str], cap: int) -> DataFrame:
    """The ``cap`` rows of the smallest nll of each frame; ties go to the smaller token."""
    order = Window.partitionBy(*by).orderBy("nll", "token")
    return rows.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= cap).drop("r_")


def bounded_paths(steps: DataFrame, by: list[str], cutoff: float, depth: int) -> DataFrame:
    """by, path, nll: all token sequences of up to ``depth`` steps whose summed
    nll is strictly below ``cutoff``. ``steps``: by, step, token, nll. Each step
    is one join of the frontier with the next step's tokens, on ``by``."""
    frontier = steps.where(F.col("step") == 0).select(*by, F.array("token").alias("path"), "nll").where(F.col("nll") < cutoff)
    out = frontier
    for k in range(1, depth):
        nxt = steps.where(F.col("step") == k).select(*by, "token", F.col("nll").alias("more"))
        frontier = frontier.join(nxt, by).where(F.col("nll") + F.col("more") < cutoff).select(*by, F.concat("path", F.array("token")).alias("path"), (F.col("nll") + F.col("more")).alias("nll"))
        out = out.union(frontier)
    return out
