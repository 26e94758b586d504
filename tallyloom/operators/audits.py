"""Audits of what was published: every number of a nested summary against the same
number computed again from the rows, and counts that documents claim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairing, verdicts

DEPTH = 8
#: By how much a published number may be off, by the first pattern that its path matches; others must be equal.
TOLERANCES = ((r"(^|\.)mean(_delta)?$", 5e-4), (r"ci95\[", 1e-3), (r"(^|\.)p$", 1e-6))
#: How documents claim how many tests there are; group 1 is the number.
CLAIMS = (
    r"([0-9]+)\s+offline tests",
    r"([0-9]+)\s+tests?\s+green",
    r"Test suite:\s*([0-9]+)\s+green",
    r"([0-9]+)-tests?\b",
    r"([0-9]+)-test\s+suite",
)


def leaves(rows: DataFrame, key: list[str], text: str, depth: int = DEPTH) -> DataFrame:
    """key, path, value: the leaves of the JSON in ``text``, as texts (a.b[0].c;
    null, {} and [] are leaves). The JSON becomes a VARIANT and is opened level by
    level in one pass; what is nested deeper than ``depth`` raises when it is
    read, and so does what isn't JSON. Null texts have no leaves."""
    spark = rows.sparkSession
    out = rows.where(F.col(text).isNotNull()).select(*key, F.lit("").alias("path"), F.parse_json(text).alias("v_"))
    step = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("path") != "", F.lit(".")).otherwise(F.lit("")), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    for _ in range(depth):  # a leaf, opened, gives one row without a value and stays what it is
        opened = out.lateralJoin(spark.tvf.variant_explode_outer(F.col("v_").outer()))
        out = opened.select(*[F.col(k) for k in key], F.when(F.col("value").isNotNull(), F.concat("path", step)).otherwise(F.col("path")).alias("path"), F.coalesce("value", "v_").alias("v_"))
    kind = F.schema_of_variant("v_")
    deeper = kind.rlike("^(OBJECT|ARRAY)<.") & ~kind.isin("OBJECT<>", "ARRAY<VOID>")
    value = F.when(deeper, F.raise_error(F.concat(F.lit(f"nested deeper than {depth} at "), F.col("path")))).otherwise(F.to_json("v_"))
    return out.select(*key, "path", F.regexp_replace(value, '^"(.*)"$', "$1").alias("value"))


def audit(published: DataFrame, recomputed: DataFrame, key: list[str], text: str = "json", tolerances: Sequence[tuple[str, float]] = TOLERANCES, depth: int = DEPTH) -> DataFrame:
    """key, path, published, recomputed, reason of every leaf that is off:
    ``not published``, ``not recomputed``, or ``differs`` (numbers by more than
    the tolerance of their path, anything else at all). Both sides: key and a
    JSON text. Keys that one side lacks give all leaves of the other."""
    a = leaves(published, key, text, depth).withColumnRenamed("value", "published")
    b = leaves(recomputed, key, text, depth).withColumnRenamed("value", "recomputed")
    both = a.join(b, [*key, "path"], "full")
    allowed = F.lit(0.0)
    for pattern, most in reversed(tolerances):
        allowed = F.when(F.col("path").rlike(pattern), F.lit(most)).otherwise(allowed)
    x, y = F.col("published").try_cast("double"), F.col("recomputed").try_cast("double")
    same = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= allowed).otherwise(F.col("published") == F.col("recomputed"))
    reason = F.when(F.col("published").isNull(), "not published").when(F.col("recomputed").isNull(), "not recomputed").when(~same, "differs")
    return both.withColumn("reason", reason).where("reason is not null")


def gate_summary(deltas: DataFrame, by: list[str], seed: str) -> DataFrame:
    """by, json: what a gate publishes, nested: pairs_complete, mean_delta (over
    seeds), receipt_level (n, mean, ci95, sign_test with one-sided p),
    cluster_level (mean, ci95), validity of the control's mean, verdict.
    ``deltas``: by, ``seed``, control, delta of the rows that both arms scored."""
    receipts = pairing.summary(deltas, by, "t_exact", "sign1_eps")
    seeds = deltas.groupBy(*by, seed).agg(F.avg("delta").alias("delta"), F.avg("control").alias("control"))
    trips = F.count_if(verdicts.validity(F.col("control")) != "ok").alias("trips")
    clusters = pairing.pooled(seeds, by, "t_exact").select(*by, F.col("n").alias("pairs"), F.col("mean").alias("c_mean"), F.col("low").alias("c_low"), F.col("high").alias("c_high"))
    both = receipts.join(clusters, by).join(seeds.groupBy(*by).agg(trips), by)
    clear = F.col("trips") == 0
    go = clear & (F.col("c_mean") >= verdicts.BAR) & (F.col("low") > 0) & (F.col("wins") > F.col("losses"))
    test = F.struct("wins", "losses", "ties", "p").alias("sign_test")
    receipt_level = F.struct("n", "mean", F.array("low", "high").alias("ci95"), test).alias("receipt_level")
    cluster_level = F.struct(F.col("c_mean").alias("mean"), F.array("c_low", "c_high").alias("ci95")).alias("cluster_level")
    verdict = F.when(F.coalesce(go, F.lit(False)), "GO").otherwise("NOT GO").alias("verdict")
    summary = F.struct(F.struct(F.col("pairs").alias("pairs_complete"), F.col("c_mean").alias("mean_delta"), receipt_level, cluster_level, F.when(clear, "clear").otherwise("tripped").alias("validity")).alias("gate"), verdict)
    return both.select(*by, F.to_json(summary, {"ignoreNullFields": "false"}).alias("json"))


# ---- counts that documents claim ----------------------------------------------------------------------------------------


def _line_feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _claims_of(text: str, place: int, pattern: str) -> Column:
    """array<struct<pattern, line, claimed>> of one pattern: the text is split at
    its matches, and lines are summed up from match to match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ahead = F.split(text, pattern)  # what stands before each match, and after the last
    counted = F.transform(whole, lambda m: F.struct(_line_feeds(m).alias("own"), F.regexp_extract(m, pattern, 1).alias("number")))
    matches = F.filter(F.arrays_zip(counted.alias("m"), F.transform(ahead, _line_feeds).alias("ahead")), lambda x: x["m"].isNotNull())
    one = lambda s, x: F.struct(F.lit(place).alias("pattern"), (s["line"] + x["ahead"]).alias("line"), x["m"]["number"].alias("claimed"))
    start = F.struct(F.lit(1).alias("line"), F.expr("cast(array() as array<struct<pattern:int,line:int,claimed:string>>)").alias("found"))
    add = lambda s, x: F.struct((s["line"] + x["ahead"] + x["m"]["own"]).alias("line"), F.concat(s["found"], F.array(one(s, x))).alias("found"))
    return F.aggregate(matches, start, add, lambda s: s["found"])


def claims(documents: DataFrame, key: str = "doc_id", text: str = "text", patterns: Sequence[str] = CLAIMS) -> DataFrame:
    """key, pattern (its place), line, claimed: every number that one of
    ``patterns`` (one group; Java's syntax; none matches nothing, or looks beyond
    its match but for a word's end) claims, as a search of the whole text
    for each pattern finds them, across line ends too. ``line`` (from 1) is where
    the match begins. One scan and no shuffle."""
    return documents.select(key, F.inline(F.concat(*[_claims_of(text, i, p) for i, p in enumerate(patterns)])))


def stale_claims(documents: DataFrame, actual: int | Column, key: str = "doc_id", text: str = "text", patterns: Sequence[str] = CLAIMS) -> DataFrame:
    """``claims`` whose number isn't ``actual``."""
    return claims(documents, key, text, patterns).where(F.col("claimed").cast("decimal(38,0)") != (F.lit(actual) if isinstance(actual, int) else actual))


def corrected(documents: DataFrame, actual: int | Column, text: str = "text", patterns: Sequence[str] = CLAIMS) -> DataFrame:
    """``documents`` with ``actual`` in place of every number that is claimed, one pattern after the other."""
    number = (F.lit(actual) if isinstance(actual, int) else actual).cast("string")
    out = F.col(text)
    for pattern in patterns:
        before, _, after = pattern.partition("([0-9]+)")
        out = F.regexp_replace(out, F.lit(f"(?<a>{before})[0-9]+(?<b>{after})"), F.concat(F.lit("${a}"), number, F.lit("${b}")))
    return documents.withColumn(text, out)
