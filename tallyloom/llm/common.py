"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a word are all but these (space and 09 to 0D), as in ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a folder of our
    own if everything runs in this process (tests), else an error: executors
    elsewhere wouldn't see it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. Removed when the driver ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, at))
    return at


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder (with ``by`` a folder for
    each value of that column) and read again: cuts the lineage and outlives any
    executor. Removed when the driver ends, or by ``forget``."""
    spark = df.sparkSession
    at = folder(spark, name)
    df.write.parquet(at, compression="zstd", partitionBy=by)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Removes what ``written`` wrote for ``df``; nothing may read it later."""
    files = df.inputFiles()
    for spark, at in list(_WRITTEN):
        if any(at.rpartition("/")[2] in f for f in files):
            remove(spark, at)
            _WRITTEN.remove((spark, at))
    df.sparkSession.sparkContext._jvm.System.gc()  # lets Spark drop the shuffles that led to it


@atexit.register
def _clean() -> None:
    for spark, at in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, at)
        except Exception:  # the JVM may have ended
            return


def lower_ascii(text):
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if at is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches between rows so that each piece has at most ``most``
    bytes of ``column``, or one row: work space stays bounded by the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield batch.slice(i, min(j, batch.num_rows) - i)
            i = min(j, batch.num_rows)
