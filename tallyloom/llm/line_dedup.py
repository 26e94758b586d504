"""Line deduplication over overlapping windows of three lines.

Built-in functions only. A window's identity is the MD5 of its lines; the first
window of each identity (by doc_id, then position) stays, and the lines that any
later one covers are removed. Overlapping and touching covers are merged first.
A document is named by its doc_id and a hash of its text, as ids may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 3


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, mark, spans array<struct<start,stop>>: the runs of lines (from 0,
    stop excluded) that later occurrences of repeated windows cover, of each
    different document (doc_id, mark) of ``docs`` (doc_id, mark, text)."""
    lines = docs.select("doc_id", "mark", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    windows = F.expr(
        f"if(size(lines) < {window}, array(), transform(sequence(1, size(lines) - {window - 1}), "
        f"i -> unhex(md5(concat_ws('\\n', slice(lines, i, {window}))))))"
    )
    at = lines.select("doc_id", "mark", F.posexplode(windows).alias("pos", "hash"))
    first = at.groupBy("hash").agg(F.min(F.struct("doc_id", "mark", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # The extra key makes both sides shuffle for the join alone: a window of very many lines can then be split.
    key = F.xxhash64("hash")
    later = (
        at.withColumn("key", key)
        .join(first.withColumn("key", key), ["key", "hash"])
        .where(~F.struct("doc_id", "mark", "pos").eqNullSafe(F.col("first")))
        .select("doc_id", "mark", "pos")
    )
    order = Window.partitionBy("doc_id", "mark").orderBy("pos")
    return (
        later.select("doc_id", "mark", "pos", (F.col("pos") - F.lag("pos", 1, -window - 1).over(order) > window).cast("int").alias("new"))
        .select("doc_id", "mark", "pos", F.sum("new").over(order).alias("island"))
        .groupBy("doc_id", "mark", "island")
        .agg(F.min("pos").alias("start"), (F.max("pos") + window).alias("stop"))
        .groupBy("doc_id", "mark")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    )


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (without the removed lines), n_lines, n_removed, n_spans for
    each row of ``docs`` (doc_id, text; other columns are left out).

    Lines are what stands between ``\\n``; a null or empty text is one empty
    line. A text of fewer than ``window`` lines has no window and stays. Rows
    that repeat a doc_id with another text are documents of their own, in the
    order of a hash of their texts; rows that repeat both are taken as one
    document and come back as often. Rows of a null doc_id come first in the order.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    spans = repeated_spans(docs, window).withColumnsRenamed({"doc_id": "of", "mark": "of_mark"})
    lines = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"))
    kept = F.expr(
        "flatten(transform(sequence(0, size(spans)), j -> slice(lines, if(j = 0, 0, spans[j - 1].stop) + 1, "
        "if(j = size(spans), size(lines), spans[j].start) - if(j = 0, 0, spans[j - 1].stop))))"
    )
    return lines.select(
        "doc_id",
        F.array_join(kept, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("aggregate(spans, 0L, (s, x) -> s + x.stop - x.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
    )
