"""Places, ranks and running sums along one order of all rows.

A window without a partition would sort everything in one task. Here rows are
dealt to ranges of the order, each range is sorted by its own task, and what lies
before a range is the sum over the ranges before it, of which there are as many as
partitions. The ranges are written once and read again: a second evaluation might
draw other bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch


def prefix_sums(rows: DataFrame, order: list[str], weight: str, at: str | None = None, into: str = "before") -> DataFrame:
    """``rows`` with ``into``: the sum of the whole-number column ``weight`` over
    the rows before each in the order of ``order`` (ascending, nulls first), which
    should tell rows apart: equal rows stand in any order, side by side. Written
    to ``at``, a new folder if None. A range holds equal rows whole, so values of many rows are to be
    counted first (``average_ranks``) or told apart by a key (``places``)."""
    at = at or scratch.folder(rows.sparkSession, "ranges")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # A task's ids go up by one from row to row, from the number of its partition in the upper bits.
    ranged.withColumn("id_", F.monotonically_increasing_id()).write.parquet(at)
    found = rows.sparkSession.read.schema(ranged.withColumn("id_", F.lit(0).cast("long")).schema).parquet(at).withColumn("range_", F.shiftright("id_", 33))
    sums = {r["range_"]: r["s"] for r in found.groupBy("range_").agg(F.sum(weight).alias("s")).collect()}  # a row for each partition
    before, total = [], 0
    for r in sorted(sums):
        before.append((r, total))
        total += sums[r] or 0
    starts = rows.sparkSession.createDataFrame(before, "range_ long, start_ long")
    inside = Window.partitionBy("range_").orderBy("id_").rowsBetween(Window.unboundedPreceding, -1)
    summed = found.withColumn("inside_", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), "range_").withColumn(into, F.col("start_") + F.col("inside_")).drop("range_", "id_", "inside_", "start_")


def places(rows: DataFrame, order: list[str], at: str | None = None, into: str = "place") -> DataFrame:
    """``rows`` with the place (from 0) of each in the order of ``order``, whose
    last column should be a key: then no value is too frequent for a range."""
    return prefix_sums(rows.withColumn("one_", F.lit(1)), order, "one_", at, into).drop("one_")


def average_ranks(rows: DataFrame, value: str, at: str | None = None, into: str = "rank", count: Column | None = None) -> DataFrame:
    """``value``, m (its rows, or the sum of ``count``), ``into``: the mean of the
    ranks (from 1) that equal values share. Rows are counted per value first, so a
    value that very many rows have is one row of the ranges."""
    counts = rows.groupBy(value).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("m"))
    return prefix_sums(counts, [value], "m", at, "before_").select(value, "m", (F.col("before_") + (F.col("m") + 1) / 2).alias(into))


def rank_correlation(rows: DataFrame, x: str, y: str, at: str | None = None) -> DataFrame:
    """n, rho: Spearman's coefficient over average ranks, 0 if a side is constant
    or there are no rows; nulls are a value, the smallest. Pairs are counted first
    and only counts are joined with ranks; sums are taken around the mean rank,
    which is known, so they lose no digits. Written below ``at``."""
    at = at or scratch.folder(rows.sparkSession, "ranks")
    pairs = rows.groupBy(F.col(x).alias("x_"), F.col(y).alias("y_")).agg(F.count(F.lit(1)).alias("n_"))
    pairs.write.parquet(f"{at}/pairs")
    pairs = rows.sparkSession.read.schema(pairs.schema).parquet(f"{at}/pairs")
    both = pairs
    for c in ("x_", "y_"):
        ranked = average_ranks(pairs, c, f"{at}/{c}", f"{c}rank", F.col("n_")).select(F.col(c).alias("v_"), F.col(f"{c}rank").alias(f"r{c}"))
        both = both.join(ranked, F.col(c).eqNullSafe(F.col("v_"))).drop("v_")
    n = F.sum("n_")
    middle = rows.sparkSession.createDataFrame([((pairs.agg(n).first()[0] or 0) / 2 + 0.5,)], "middle_ double")
    both = both.join(F.broadcast(middle))  # one row
    a, b, w = (F.col("rx_") - F.col("middle_")), (F.col("ry_") - F.col("middle_")), F.col("n_")
    sums = both.agg(F.coalesce(n, F.lit(0)).alias("n"), F.sum(w * a * b).alias("ab_"), (F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))).alias("s_"))
    return sums.select("n", F.when(F.col("s_") > 0, F.col("ab_") / F.col("s_")).otherwise(0.0).alias("rho"))
