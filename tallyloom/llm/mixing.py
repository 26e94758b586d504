"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key with its quality weight as the rate;
smaller keys come first. A source's complete epochs take every document; what is
left of its target is taken along the key order until the budget is met. The
order is never sorted whole: keys fall into bins, bin sums are prefix-summed per
source, and only inside a bin are documents ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, "mix"
#: Bins of a source's keys; the largest task of the ordering holds about this part of a source.
BINS = 4096


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number between 0 and 1 from 52 bits of an MD5; the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with target. Sources weigh ``weights`` in
    turn, by code point, null last; they share ``share`` of all sizes, none
    above ``most`` times its own. Ordered by that limit over the weight, the
    sources that reach it come first; the level (size per weight) is that of the
    first source below its limit, and falls again after it. Works on one row per
    source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = level.withColumn("level", F.max(F.when(F.col("limit") / F.col("w") > F.col("level"), F.col("level"))).over(whole))
    return level.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"))


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: documents labelled good are drawn twice as readily as
    unlabelled ones, those labelled bad half as readily."""
    label = F.col("quality")
    return labels.select("doc_id", F.when(label == 1, 2.0).when(label == 0, 0.5).otherwise(1.0).alias("weight"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size (words),
    source_size, target, copies, taken (copies times size).

    ``docs``: doc_id, text, source; other columns are left out. ``quality``:
    doc_id, weight (of repeated ids the largest counts; a missing, null or not
    positive weight is 1), joined after the texts have become sizes. Null
    texts have no words, null sources are one source, the last. The document on
    which a budget ends is taken if at least half of it fits, so a source's sum
    is off its target by half a document at most. Keys depend on doc_id and
    ``seed`` alone, and ties go to the smaller doc_id: reruns agree. An empty
    table gives an empty result.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
    if quality is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        sized = sized.join(quality.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("weight").cast("double").alias("weight")), "doc_id", "left")
    key = -F.ln(uniform(F.col("doc_id"), seed)) / F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    drawn = written(sized.select("doc_id", "source", "size", key.alias("key")), "drawn")
    drawn = drawn.withColumn("bin", F.least(F.floor(F.col("key") / (F.col("key") + 1) * bins), F.lit(bins - 1)).cast("int"))
    sums = drawn.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    along = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bin_rows = sums.withColumn("before", F.coalesce(F.sum("bin_size").over(along), F.lit(0))).join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "bin_size")
    bin_rows = bin_rows.withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    b = bin_rows.select(F.col("source").alias("of"), F.col("bin").alias("in_bin"), "source_size", "target", "before", "epochs", "rest")
    joined = drawn.join(b, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("in_bin")))
    inside = Window.partitionBy("of", "in_bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.col("before") + F.sum("size").over(inside) - F.col("size")
    copies = F.col("epochs") + ((F.col("rest") > 0) & (ahead + F.col("size") / 2 <= F.col("rest"))).cast("int")
    return joined.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _named(doc_id: Column, source: Column) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")).alias(name) for c, name in ((doc_id.cast("long"), "id_"), (source, "source_"))]


def take_mix(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its
    columns. Rows that share doc_id (null too) and source are all taken as often
    as the one of them that is taken most."""
    times = mix(docs, quality, **options).where("copies > 0").groupBy(*_named(F.col("doc_id"), F.col("source"))).agg(F.max("copies").alias("copies_"))
    named = docs.select("*", *_named(F.col("doc_id"), F.col("source")))
    return named.join(times, ["id_", "source_"]).withColumn("copy_", F.explode(F.array_repeat(F.lit(0), F.col("copies_")))).select(*[f"`{c}`" for c in docs.columns])
