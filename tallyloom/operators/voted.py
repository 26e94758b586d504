"""Voted decoding of texts: a pool of completions for each task, each different
one scored once, pooled by canonical key and ranked.

Scores are kept in a cache that outlives a run: only texts that it hasn't are
scored, and what comes back is joined to the pool. A call to the predictor gets
no more than a given number of characters, so its memory is bounded whatever the
batches of the scan are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions.payload import candidate_key
from ..tables import spread
from . import votes
from .predictor import Predictor

MOST_CHARS = 1 << 16


def pool(prompts: DataFrame, make: Callable[[], Predictor], samples: int) -> DataFrame:
    """``prompts`` with ordinal and text: the greedy completion (ordinal 0) and
    ``samples`` - 1 drawn ones. The predictor sees the ordinal as a column and
    answers null where it has none; those are dropped, blank ones count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()
        for pdf in frames:
            yield pdf.assign(text=predictor.predict(pdf))

    each = prompts.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return each.mapInPandas(run, each.select("*", F.lit(None).cast("string").alias("text")).schema).where("text is not null")


def _in_calls(chars: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of at most ``most`` characters, or one row."""
    ends, i = np.cumsum(chars), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield slice(i, j)
        i = j


def _scored(pairs: DataFrame, make: Callable[[], Predictor], most: int) -> DataFrame:
    """``pairs`` with lp and call_first. rest_ passes through as Arrow has it; the predictor doesn't see it."""
    texts = [f.name for f in pairs.schema if f.dataType.simpleString() == "string" and f.name != "text_key"]
    seen = [c for c in pairs.columns if c != "rest_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = make()
        for batch in batches:
            pdf = batch.select(seen).to_pandas()
            chars = sum(pdf[c].str.len().fillna(0).to_numpy(int) for c in texts)
            shown, lp, first = pdf.rename(columns={"text": "output"}), [np.empty(0)], np.zeros(len(pdf), bool)
            for rows in _in_calls(chars, most):
                first[rows.start] = True
                lp.append(predictor.log_probability(shown.iloc[rows].reset_index(drop=True)).astype(float).to_numpy())
            yield batch.append_column("lp", pa.array(np.concatenate(lp), pa.float64(), from_pandas=True)).append_column("call_first", pa.array(first))

    return pairs.mapInArrow(run, pairs.select("*", F.lit(None).cast("double").alias("lp"), F.lit(False).alias("call_first")).schema)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def scored_once(candidates: DataFrame, by: list[str], make: Callable[[], Predictor], cache: str, most_chars: int = MOST_CHARS, context: list[str] = ()) -> DataFrame:
    """``candidates`` (by, text, ordinal; more columns stay) with lp: the
    log-probability of each, asked for once for each different (by, text) that
    the ``cache`` (a folder that outlives the run; by, text_key, lp, call_first)
    hasn't, and added to it. ``context``: columns that depend on ``by`` alone and
    that the predictor reads too. Candidates are made and shuffled once: equal
    texts of a task are one row that keeps the rest of each, and what is scored is
    written to a folder of this run and read again, not joined with the candidates.
    Null log-probabilities are kept as such."""
    spark = candidates.sparkSession
    rest = [c for c in candidates.columns if c not in (*by, "text", *context)]
    dealt = candidates.repartition(*by).withColumn("text_key", F.sha2("text", 256))
    # The smallest text of a key is the text.
    asked = dealt.groupBy(*by, "text_key").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in context], F.collect_list(F.struct(*rest)).alias("rest_"))
    at, known = scratch.folder(spark, "voted"), None
    if _exists(spark, cache):
        asked.write.parquet(f"{at}/asked")
        had = spark.read.parquet(cache).select(*by, "text_key", F.struct("lp").alias("had_"))
        joined = spark.read.schema(asked.schema).parquet(f"{at}/asked").join(had, [*by, "text_key"], "left")
        asked, known = joined.where("had_ is null").drop("had_"), joined.where("had_ is not null").withColumn("lp", F.col("had_.lp"))
    names = [*by, "text_key", "text", *context, "rest_", "lp"]
    fresh = _scored(asked, make, most_chars)
    fresh.write.parquet(f"{at}/scored")
    scored = spark.read.schema(fresh.schema).parquet(f"{at}/scored")
    if known is not None:  # fixed before the cache grows
        known.select(*names).write.parquet(f"{at}/known")
        known = spark.read.schema(known.select(*names).schema).parquet(f"{at}/known")
    scored.select(*by, "text_key", "lp", "call_first").write.mode("append").parquet(cache)
    out = scored.select(*names) if known is None else scored.select(*names).unionByName(known)
    return out.select(*by, "text", *context, "lp", F.inline("rest_")).select(*candidates.columns, "lp")


def calls(spark: SparkSession, cache: str) -> DataFrame:
    """texts, calls: how many texts a cache holds, and how many calls they took."""
    return spark.read.parquet(cache).agg(F.count(F.lit(1)).alias("texts"), F.count_if("call_first").alias("calls"))


def top(scored: DataFrame, by: list[str], attempts: int = 1) -> DataFrame:
    """by, attempt, text, key, found_count, mean_lp: candidates (by, ordinal,
    text, lp) pooled by canonical key, the text of the largest lp for each, by
    count plus exp(mean lp); ties go to the pool that was seen first."""
    # Dealt by task, pools and their order need no shuffle of their own.
    pooled = votes.pool(scored.repartition(*by).withColumn("key", candidate_key("text")), by, "key")
    return votes.ranked_by_sum(pooled, by, attempts).select(*by, "attempt", "text", "key", "found_count", "mean_lp")


def decode(prompts: DataFrame, by: list[str], make: Callable[[], Predictor], samples: int, cache: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """``top`` of a pool of ``samples`` completions for each of ``prompts``. Tasks
    without a completion have no row."""
    context = [c for c in prompts.columns if c not in by]
    return top(scored_once(pool(spread(prompts, by), make, samples), by, make, cache, most_chars, context), by)
