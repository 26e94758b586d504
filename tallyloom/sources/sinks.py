"""Writers. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import parsed
from ..operators import votes
from .files import digests, json_object, opened, readable


def json_lines(df: DataFrame, path: str, nulls: bool = True) -> None:
    """One JSON object to a line; null fields are written unless told otherwise."""
    df.write.json(path, ignoreNullFields=not nulls)


def predictions(rows: DataFrame, path: str) -> None:
    """id and prediction (a JSON object, or null where the completion isn't one) to a line, in canonical form."""
    parsed_ = parsed(F.col("completion"))
    lines = rows.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"))).alias("i_"), parsed_.alias("p_"))
    lines.select(F.concat(F.expr("left(i_, length(i_) - 1)"), F.lit(',"prediction":'), F.coalesce("p_.canonical", F.lit("null")), F.lit("}")).alias("value")).write.text(path)


def prompts(rows: DataFrame, path: str, inline: bool = False) -> None:
    """Prompts (id, text) and their gold: in folders of their own, or ``inline`` in one."""
    if inline:
        json_lines(rows.select("id", "text", "gold"), path)
    else:
        json_lines(rows.select("id", "text"), f"{path}/prompts")
        json_lines(rows.select("id", "gold"), f"{path}/gold")


def summary(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A summary document per row of ``df``: one JSON object to a line, in the
    order of ``by``, null fields written, all in one file (summaries are few rows)."""
    json_lines(df.orderBy(*by).coalesce(1) if by else df.coalesce(1), path)


def challenge(rows: DataFrame, path: str) -> None:
    """Train (id, text, gold), holdout (id, text) and gold (id, gold), each in its own folder; ``rows`` has split."""
    json_lines(rows.where("split = 'train'").select("id", "text", "gold"), f"{path}/train")
    json_lines(rows.where("split = 'holdout'").select("id", "text"), f"{path}/holdout")
    json_lines(rows.where("split = 'holdout'").select("id", "gold"), f"{path}/gold_holdout")


def summary_object(df: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """The rows of ``df`` as one JSON object in one file: ``key`` names an entry,
    its other columns are the entry's fields, nulls written."""
    fields = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    json_object(df.select(key, fields.alias("entry_")), path, key, "entry_", overwrite)


def submission(attempts: DataFrame, path: str, task: str = "task_id", test: str = "test_index", grid: str = "grid", overwrite: bool = False) -> None:
    """One JSON object in one file: every task with an entry for each of its tests,
    in their order, of two attempts; see ``votes.submission_entries``."""
    json_object(votes.submission_entries(attempts, task, test, grid), path, task, "entries", overwrite)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 of every file below ``path``, chunk by chunk. Where only Spark
    knows the file system, by its own source, which refuses files of over 2 GB."""
    if readable(path):
        return digests(spark, path).select("file", "sha256")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str, **facts: str) -> DataFrame:
    """name, value (JSON text): an entry for every file below ``path`` (its place
    there, bytes and sha256) and one for each of the facts, to be written as one
    object (``json_object``)."""
    _, at, before = opened(path)
    place = F.substring("file", len(before + at.rstrip("/")) + 2, 1 << 20)
    files = digests(spark, path).select(F.concat(F.lit("files/"), place).alias("name"), F.to_json(F.struct("bytes", "sha256")).alias("value"))
    return files.union(spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in facts.items()], "name string, value string"))


def guarded(df: DataFrame, pinned: dict[str, str | None], override: bool = False) -> DataFrame:
    """``df``, or an error if a pin is missing and that isn't overridden."""
    missing = sorted(k for k, v in pinned.items() if not v)
    if missing and not override:
        raise ValueError("unpinned: " + ", ".join(missing))
    return df


def append_journal(df: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key the journal doesn't have, once each; returns how
    many. They are counted as they are written. For streams see ``journal.follow``,
    which doesn't read the journal again."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = df.dropDuplicates(key)
    if exists:
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    written = Observation()
    fresh.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return written.get["n"]
