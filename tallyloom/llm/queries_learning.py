"""Queries of the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .learning import fold
from .quality_crf import quality
from .toxicity import toxicity


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fold(F.col("doc_id"), 5) != 0
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fold(F.col("doc_id"), 3) != 1
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity_ftrl": op2_toxicity_ftrl, "op9_quality_crf": op9_quality_crf}
SQL: dict[str, str] = {}
