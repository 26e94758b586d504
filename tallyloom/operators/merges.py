"""Banking of run records: supersede, refuse, skip; and audits of what was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import generate, scoring

TOLERANCE = 5e-4


def bank(existing: DataFrame, incoming: DataFrame, key: list[str], partner_by: list[str] | None = None, arm: str = "arm") -> DataFrame:
    """The action for every incoming record (key, error, device, dtype, mean):
    add (whatever it is), skip (an error, or the same result), supersede error, supersede
    environment (device or dtype changed), conflict (same environment, other
    result). With ``partner_by`` also conflict if the record in place still has
    the environment of its partner: of the existing records of the same
    ``partner_by`` and another ``arm`` the first by arm, if that is no error."""
    fields = ("error", "device", "dtype", "mean")
    old = existing.select(*key, F.lit(True).alias("here_"), *[F.col(c).alias(f"old_{c}") for c in fields])
    both = incoming.join(old, key, "left")
    same = F.col("device").eqNullSafe(F.col("old_device")) & F.col("dtype").eqNullSafe(F.col("old_dtype"))
    paired = F.lit(False)
    if partner_by is not None:
        arms = F.array_sort(F.collect_list(F.struct(F.col(arm).alias("a"), "error", "device", "dtype"))).alias("arms_")  # a key has few arms
        both = both.join(existing.groupBy(*partner_by).agg(arms), partner_by, "left")
        other = F.get(F.filter("arms_", lambda x: x["a"] != F.col(arm)), F.lit(0))
        paired = other.isNotNull() & other["error"].isNull() & other["device"].eqNullSafe(F.col("old_device")) & other["dtype"].eqNullSafe(F.col("old_dtype"))
    action = (
        F.when(F.col("here_").isNull(), "add")
        .when(F.col("error").isNotNull(), "skip")
        .when(F.col("old_error").isNotNull(), "supersede error")
        .when(same & F.col("mean").eqNullSafe(F.col("old_mean")), "skip")
        .when(same | paired, "conflict")
        .otherwise("supersede environment")
    )
    return both.withColumn("action", action).drop("here_", "arms_", *[f"old_{c}" for c in fields])


def banked(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The records after banking, superseded ones kept under ``superseded``; conflicts change nothing."""
    actions = bank(existing, incoming, key)
    fresh = actions.where(F.col("action").isin("add", "supersede error", "supersede environment"))
    replaced = fresh.where(F.col("action") != "add").select(*key).withColumn("superseded", F.lit(True))
    old = existing.join(replaced, key, "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    return old.unionByName(fresh.drop("action").withColumn("superseded", F.lit(False)))


def refuse_conflicts(actions: DataFrame) -> DataFrame:
    """``actions``, which raise when a conflict is read."""
    return actions.withColumn("action", F.when(F.col("action") == "conflict", F.raise_error(F.lit("conflicting results for one environment"))).otherwise(F.col("action")))


def seeded(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``incoming`` with action: seed, or why not: not an arm (no identity), local
    (no device), error, here (never overwritten)."""
    here = existing.select(*key).distinct().withColumn("here_", F.lit(True))
    anonymous = F.lit(False)
    for c in key:
        anonymous = anonymous | F.col(c).isNull()
    action = F.when(anonymous, "not an arm").when(F.col("device").isNull(), "local").when(F.col("error").isNotNull(), "error").when(F.col("here_"), "here").otherwise("seed")
    return incoming.join(here, key, "left").withColumn("action", action).drop("here_")


def purged(rows: DataFrame, device: str, dtype: str) -> DataFrame:
    """Rows of a stage that stay when it runs on ``device`` and ``dtype``: those made there."""
    return rows.where(F.col("device").eqNullSafe(F.lit(device)) & F.col("dtype").eqNullSafe(F.lit(dtype)))


def requested(plan: DataFrame, wanted: str) -> DataFrame:
    """The rows of ``plan`` (k, seed, arm) that a list "k:seed:arm,..." names; an empty list names all."""
    rows = [tuple(x.split(":")) for x in wanted.split(",") if x.strip()]
    if any(len(x) != 3 for x in rows):
        raise ValueError(f"not a list of k:seed:arm: {wanted}")
    if not rows:
        return plan
    names = plan.sparkSession.createDataFrame([(int(k), int(s), a.strip()) for k, s, a in rows], "k int, seed int, arm string")
    return plan.join(F.broadcast(names.distinct()), ["k", "seed", "arm"], "left_semi")  # as many rows as the list has


def primary_audit(runs: DataFrame, results: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """seed, arm, geometry, rescored, mismatched, status: stored predictions
    scored again against regenerated gold. ``runs``: seed, arm, k, eval_n,
    schema_text; ``results``: seed, arm, index (of the test records), prediction,
    micro_f1. Rows without a prediction can't be verified; a schema that no
    geometry yields is an integrity failure."""
    fit = generate.resolve_geometry(runs.select("seed", "schema_text").distinct())
    known = runs.join(fit.withColumnRenamed("schema_text", "s_"), (runs["seed"] == fit["seed"]) & F.col("schema_text").eqNullSafe(F.col("s_"))).select(runs["seed"], "arm", "k", "eval_n", "geometry")
    stored = results.where(F.length("prediction") > 0).join(known, ["seed", "arm"])
    gold = generate.record_targets(stored.where("geometry is not null").selectExpr("seed", "geometry", "cast(k + index as int) as index").distinct())
    again = scoring.scored(stored.withColumn("at_", (F.col("k") + F.col("index")).cast("int")).join(gold.withColumnRenamed("index", "at_"), ["seed", "geometry", "at_"]).withColumnRenamed("micro_f1", "stamped"), "prediction", "target")
    counts = again.groupBy("seed", "arm").agg(F.count(F.lit(1)).alias("rescored"), F.count_if(F.abs(F.col("stamped") - F.col("micro_f1")) > tolerance).alias("mismatched"))
    out = known.join(counts, ["seed", "arm"], "left").select("seed", "arm", "geometry", F.coalesce("rescored", F.lit(0)).alias("rescored"), F.coalesce("mismatched", F.lit(0)).alias("mismatched"))
    status = F.when(F.col("geometry").isNull(), "schema mismatch").when(F.col("rescored") == 0, "no predictions").when(F.col("mismatched") > 0, "mismatches").otherwise("verified")
    return out.withColumn("status", status)


def mismatches(stamped: DataFrame, recomputed: DataFrame, key: list[str], value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """key, stamped, recomputed where they differ by more than ``tolerance`` or one is missing."""
    a = stamped.select(*key, F.col(value).alias("stamped"))
    b = recomputed.select(*key, F.col(value).alias("recomputed"))
    differs = F.abs(F.col("stamped") - F.col("recomputed")) > tolerance
    return a.join(b, key, "full").where(F.coalesce(differs, F.lit(True)))


def claimed_counts(documents: DataFrame, pattern: str, actual: int | Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, claimed: numbers that ``pattern`` (one group) finds in a line and that aren't ``actual``."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("n_", "l_"))
    found = lines.select(key, (F.col("n_") + 1).alias("line"), F.explode(F.regexp_extract_all("l_", F.lit(pattern), F.lit(1))).alias("claimed"))
    return found.where(F.col("claimed").cast("long") != actual)


def same_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The keys that only one side has, with the side."""
    only = lambda x, y, side: x.select(*key).distinct().join(y.select(*key), key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").union(only(b, a, "right"))
