"""The predictor boundary: what yields completions and log-probabilities stays outside.

A predictor answers whole batches; single calls, pairs and frames are all rows
of such a batch. It is made once per task from a function without arguments, so
that weights are loaded where they are used and never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grids


class Predictor(Protocol):
    def predict(self, prompts: pd.DataFrame) -> pd.Series:
        """A completion (text or null) for each row."""

    def log_probability(self, pairs: pd.DataFrame) -> pd.Series:
        """Log-probability of column ``output`` for each row."""


def completions(prompts: DataFrame, make: Callable[[], Predictor]) -> DataFrame:
    """``prompts`` with completion; empty completions are dropped by ``kept`` only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()
        for pdf in frames:
            yield pdf.assign(completion=predictor.predict(pdf))

    return prompts.mapInPandas(run, prompts.select("*", F.lit(None).cast("string").alias("completion")).schema)


def kept(rows: DataFrame, text: str = "completion") -> DataFrame:
    """Rows whose completion isn't null or blank."""
    return rows.where(F.trim(text) != "")


def log_probabilities(pairs: DataFrame, make: Callable[[], Predictor]) -> DataFrame:
    """``pairs`` (with output) and lp."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()
        for pdf in frames:
            yield pdf.assign(lp=predictor.log_probability(pdf).astype(float))

    return pairs.mapInPandas(run, pairs.select("*", F.lit(None).cast("double").alias("lp")).schema)


def in_frames(candidates: DataFrame, augmentations: DataFrame, grid: str = "grid") -> DataFrame:
    """Every candidate in every frame, as text in output. ``augmentations``
    (ordinal, rotations, flip, palette) is a literal table of 8 (1 + palettes) rows."""
    rows = candidates.join(F.broadcast(augmentations), F.lit(True))
    return rows.withColumn("output", grids.text(grids.augmented(F.col(grid), F.col("rotations"), F.col("flip"), F.col("palette"))))


def rescored(candidates: DataFrame, augmentations: DataFrame, make: Callable[[], Predictor], by: list[str], grid: str = "grid") -> DataFrame:
    """by, mean_lp: each candidate's mean over one and the same set of frames."""
    framed = in_frames(candidates, augmentations, grid).select(*by, "ordinal", "output")
    return log_probabilities(framed, make).groupBy(*by).agg(F.avg("lp").alias("mean_lp"))
