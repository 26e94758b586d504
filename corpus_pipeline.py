"""The corpus pipeline: documents in, token ids out.

Each stage gets all that the one before it kept. All but the last return the
columns of ``documents``; the last returns the token ids of each document that
the mix took, as often as it took it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bpe import encode
from tallyloom.llm.common import table, written
from tallyloom.llm.exact_dedup import drop_exact
from tallyloom.llm.learning import fold
from tallyloom.llm.mixing import label_weights, take_mix
from tallyloom.llm.quality_crf import keep_good
from tallyloom.llm.simhash import drop_near

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model doesn't reject."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return drop_exact(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id."""
    return drop_near(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, those labelled good the more readily."""
    return take_mix(docs.select(*COLUMNS), label_weights(table(spark, sf_dir, "labels")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every document."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", good_quality), ("exact", exact_copies), ("near", near_copies), ("mix", source_mix), ("encode", token_ids)]
#: The quality model and the fingerprints' components have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
