"""Bounded search with the predictor in the loop: every completion of a frame
whose negative log-probability stays below a cutoff.

Scores depend on the whole prefix, so the search goes level by level: the
frontier (a row for each prefix) is joined with its frame's columns, a predictor
answers in batches with the next token's logits, and only what stays below the
cutoff leaves the task. Every level is written and read again, so the plan of a
level is the same at every depth and a lost executor costs one level.

Prefixes of one length exclude each other and each has a probability above
exp(-cutoff), so a frame has fewer than exp(cutoff) prefixes on a level, and as
few completions in all: no frame outgrows a task, however deep the search goes.

``places`` holds, for each token of a path, its place among its siblings by
summed score (ties: the smaller token). A search that always follows the best
sibling first meets completions in the order of ``places``, so what it would find
before a cap is known without searching one path after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class TokenPredictor(Protocol):
    def next_logits(self, prefixes: pd.DataFrame) -> np.ndarray:
        """The next token's logits for each row: the frame's columns and path, the tokens so far."""


def log_softmax(logits: np.ndarray) -> np.ndarray:
    x = logits - logits.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _expanded(make: Callable[[], TokenPredictor], by: list[str], cutoff: float, stop: frozenset[int], allowed: np.ndarray | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()
        for pdf in frames:
            if not len(pdf):
                continue
            nll = -log_softmax(np.asarray(predictor.next_logits(pdf.drop(columns=["nll", "places"])), float))
            tokens = np.arange(nll.shape[1]) if allowed is None else allowed
            total = pdf["nll"].to_numpy()[:, None] + nll[:, tokens]
            order = np.argsort(total, axis=1, kind="stable")  # equal scores: the smaller token first
            row, place = np.nonzero(np.take_along_axis(total, order, 1) < cutoff)
            if not len(row):
                continue
            token = tokens[order[row, place]]
            path, places = pdf["path"].to_numpy(), pdf["places"].to_numpy()
            out = {c: pdf[c].to_numpy()[row] for c in by}
            out["path"] = [[*path[r], t] for r, t in zip(row, token.tolist(), strict=True)]
            out["places"] = [[*places[r], p] for r, p in zip(row, place.tolist(), strict=True)]
            out["nll"] = total[row, order[row, place]]
            out["ended"] = [t in stop for t in token.tolist()]
            yield pd.DataFrame(out)

    return run


def completions(
    frames: DataFrame, by: list[str], make: Callable[[], TokenPredictor], at: str, cutoff: float, depth: int,
    stop: Sequence[int], allowed: Sequence[int] | None = None, accept: Callable[[Column], Column] | None = None, cap: int | None = None,
) -> DataFrame:
    """by, path (without the stop token), places, nll of every completion of the
    frames (``by`` names them; their other columns are the predictor's) with a
    summed negative log-probability strictly below ``cutoff`` and at most
    ``depth`` - 1 tokens before one of ``stop``.

    ``allowed``: the tokens that may follow, all if None. ``accept`` (of the path)
    says which completions count. With ``cap`` prefixes are dropped that come,
    in the order of ``places``, after a frame's first ``cap`` completions, and
    ``capped`` gives the same rows as without. Levels are written below ``at``,
    which all executors share. Frames without a completion have no rows.
    """
    spark = frames.sparkSession
    run = _expanded(make, by, cutoff, frozenset(stop), None if allowed is None else np.array(sorted(allowed)))
    kinds = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, path array<int>, places array<int>, nll double, ended boolean"
    root = frames.select(*by).withColumns({"path": F.expr("cast(array() as array<int>)"), "places": F.expr("cast(array() as array<int>)"), "nll": F.lit(0.0)})
    frontier, best, level = root, None, 0
    while True:
        rows = frames.join(frontier, by).mapInPandas(run, schema)
        rows.write.partitionBy("ended").parquet(f"{at}/level={level}")
        found = spark.read.schema(schema).parquet(f"{at}/level={level}")
        level += 1
        frontier = found.where("not ended").drop("ended")
        if cap is not None:
            new = _without_stop(found, by, accept)
            best = _first(new if best is None else best.unionByName(new), by, cap)
            best.write.parquet(f"{at}/best={level}")
            best = spark.read.schema(best.schema).parquet(f"{at}/best={level}")
            last = best.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), F.max("places").alias("last_")).where(F.col("n_") >= cap)
            frontier = frontier.join(last, by, "left").where("last_ is null or places < last_").drop("n_", "last_")
        if level >= depth or frontier.isEmpty():
            break
    every = spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/level={i}" for i in range(level)])
    return _without_stop(every, by, accept)


def _without_stop(rows: DataFrame, by: list[str], accept: Callable[[Column], Column] | None) -> DataFrame:
    ended = rows.where("ended").select(*by, F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), "places", "nll")
    return ended if accept is None else ended.where(F.coalesce(accept(F.col("path")), F.lit(False)))


def _first(rows: DataFrame, by: list[str], cap: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("places")
    return rows.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= cap).drop("r_")


def capped(found: DataFrame, by: list[str], cap: int) -> DataFrame:
    """by, rank, path, places, nll: of ``completions`` the ``cap`` that a search
    of the best sibling first meets first, the likeliest first."""
    order = Window.partitionBy(*by).orderBy("nll", "places")
    return _first(found, by, cap).withColumn("rank", F.row_number().over(order)).select(*by, "rank", "path", "places", "nll")


def reasons(frames: DataFrame, found: DataFrame, by: list[str], cap: int) -> DataFrame:
    """by, candidates, reason of every frame: why such a search ends, and with how
    many: ``candidate_cap``, or ``exhausted`` if there are fewer."""
    counts = found.groupBy(*by).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("candidates"))
    out = frames.select(*by).join(counts, by, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn("reason", F.when(F.col("candidates") >= cap, "candidate_cap").otherwise("exhausted"))


def levels(spark: SparkSession, at: str) -> DataFrame:
    """level, prefixes, ended: what each level of a search below ``at`` has written."""
    rows = spark.read.option("basePath", at).parquet(f"{at}/level=*").select(F.col("level").cast("int").alias("level"), "ended")
    return rows.groupBy("level").agg(F.count_if(~F.col("ended")).alias("prefixes"), F.count_if("ended").alias("ended"))
