"""A journal that skips work already done, fed by a stream of files.

Exactly once per key: the keys that were seen are the state of the stream, in a
store on the executors' disks. A batch's work depends on its own rows, however
long the journal is; rows that come again, in a batch or in a file of another
name, add nothing. A batch writes a folder of its own, so one that runs again
after a failure replaces what it wrote. The journal is read only if the stream's
checkpoint is lost: its keys then go into the state of the new one first.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STORE, ON_DISK = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def first_of_each(rows: DataFrame, key: list[str], ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """The rows of a stream whose ``key`` hasn't been seen. With ``ts`` keys are
    forgotten once the watermark is ``late`` past them, which bounds the state;
    without, a key is kept for good."""
    return rows.dropDuplicates(key) if ts is None else rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def _start(spark: SparkSession, incoming: str, schema: str, journal: str, checkpoint: str, key: list[str], ts: str | None, late: str) -> StreamingQuery:
    rows = spark.readStream.schema(schema).json(incoming)
    known = spark.readStream.schema(rows.select(*key, *([ts] if ts else [])).schema).parquet(f"{checkpoint}-known")
    both = rows.withColumn("known_", F.lit(False)).unionByName(known.withColumn("known_", F.lit(True)), allowMissingColumns=True)
    fresh = first_of_each(both, key, ts, late).where("not known_").drop("known_")

    def write(batch: DataFrame, number: int) -> None:
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]  # a checkpoint's own
        batch.write.mode("overwrite").parquet(f"{journal}/run_={run}/batch_={number}")

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ON_DISK)
    try:
        return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def follow(spark: SparkSession, incoming: str, schema: str, journal: str, checkpoint: str, key: list[str], ts: str | None = None, late: str = "1 hour") -> StreamingQuery:
    """Starts the stream from JSON-lines files in ``incoming``; ends when all are
    read. The ``journal`` has the stream's columns, and run_ and batch_, which say
    what wrote a row. A journal without a ``checkpoint`` gives its keys to the new
    one before any file is read."""
    if not _exists(spark, f"{checkpoint}-known"):
        files, at = _files(spark, f"{checkpoint}-known")
        if _exists(spark, journal):
            spark.read.parquet(journal).select(*key, *([ts] if ts else [])).write.parquet(f"{checkpoint}-known")
            nothing = f"{checkpoint}-none"
            files.mkdirs(_files(spark, nothing)[1])
            _start(spark, nothing, schema, journal, checkpoint, key, ts, late).awaitTermination()
        else:
            files.mkdirs(at)
    return _start(spark, incoming, schema, journal, checkpoint, key, ts, late)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: start, event_type, n, total per tumbling window; works on streams (with a watermark) and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: user_id, start, n per session."""
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
