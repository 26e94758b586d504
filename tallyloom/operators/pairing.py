"""Pairs of arms: who has a partner, on which rows, and the statistics of their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import ranks


def same_or_both_null(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def pair_status(plan: DataFrame, arms: DataFrame, key: list[str], treated: str, control: str) -> DataFrame:
    """``plan`` (the designed keys) with status: missing, errored, heterogeneous
    (device or dtype differ; null equals null) or paired, tested in that order.
    ``arms``: key, arm, error, device, dtype, mean."""
    fields = ["error", "device", "dtype", "mean"]
    one = lambda arm, tag: arms.where(F.col("arm") == arm).select(*key, F.lit(True).alias(f"{tag}_here"), *[F.col(f).alias(f"{tag}_{f}") for f in fields])
    both = plan.join(one(treated, "t"), key, "left").join(one(control, "c"), key, "left")
    status = (
        F.when(F.col("t_here").isNull() | F.col("c_here").isNull(), "missing")
        .when(F.col("t_error").isNotNull() | F.col("c_error").isNotNull(), "errored")
        .when(~same_or_both_null(F.col("t_device"), F.col("c_device")) | ~same_or_both_null(F.col("t_dtype"), F.col("c_dtype")), "heterogeneous")
        .otherwise("paired")
    )
    return both.withColumn("status", status).withColumn("delta", F.when(status == "paired", F.col("t_mean") - F.col("c_mean")))


def row_deltas(rows: DataFrame, key: list[str], treated: str, control: str) -> DataFrame:
    """key, treated, control, delta of the rows that both arms scored (by key,
    never by position), in one aggregation. Of repeated rows the best score counts."""
    score = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("micro_f1")))
    both = rows.where(F.col("arm").isin(treated, control)).groupBy(*key).agg(score(treated).alias("treated"), score(control).alias("control"))
    return both.where("treated is not null and control is not null").withColumn("delta", F.col("treated") - F.col("control"))


def partners(runs: DataFrame, key: list[str], arm: str = "arm", order: str = "file") -> DataFrame:
    """``runs`` with partner_arm and partner_file: of the runs of the same key and
    another arm the first by ``order``. One aggregation per key and arm; a key has few arms."""
    first = runs.groupBy(*key, arm).agg(F.min(order).alias(order))
    per_key = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("f"), F.col(arm).alias("a")))).alias("all_"))
    found = F.get(F.filter("all_", lambda x: x["a"] != F.col(arm)), F.lit(0))
    return runs.join(per_key, key).select(*runs.columns, found["a"].alias("partner_arm"), found["f"].alias("partner_file"))


def side_by_side(rows: DataFrame, key: list[str], required: list[str], optional: list[str] = ()) -> DataFrame:
    """key and a column per arm of (key, arm, micro_f1): the keys that every
    required arm scored; an optional arm may be null. One aggregation."""
    score = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("micro_f1"))).alias(arm)
    out = rows.where(F.col("arm").isin(*required, *optional)).groupBy(*key).agg(*map(score, [*required, *optional]))
    return out.dropna(subset=required)


def environments(pairs: DataFrame, by: list[str], env: str = "env") -> DataFrame:
    """by, pairs, pooled_across (the environments, sorted), ci_is_authoritative:
    an interval over pairs of several environments reports, it doesn't decide."""
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.array_sort(F.collect_set(env)).alias("pooled_across"))
    return out.withColumn("ci_is_authoritative", F.size("pooled_across") <= 1)


def one_environment(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs measured in one environment, with refused: null, or why not."""
    return pairs.withColumn("refused", F.when(~same_or_both_null(F.col(a), F.col(b)), F.concat_ws("/", F.coalesce(a, F.lit("none")), F.coalesce(b, F.lit("none")))))


def attrition(rows: DataFrame, by: list[str], index: str, treated: str, control: str) -> DataFrame:
    """by, designed, scored (by both), excluded, symmetric: whether the arms lost
    the same rows. Counts only: no set of indices is gathered."""
    lost = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("micro_f1").isNull()))
    each = rows.groupBy(*by, index).agg(F.coalesce(lost(treated), F.lit(True)).alias("t"), F.coalesce(lost(control), F.lit(True)).alias("c"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("designed"), F.count_if(~F.col("t") & ~F.col("c")).alias("scored"), F.count_if(F.col("t") | F.col("c")).alias("excluded"), (F.count_if(F.col("t") != F.col("c")) == 0).alias("symmetric"))


def pooled(deltas: DataFrame, by: list[str], quantile: str = "t_exact") -> DataFrame:
    """by, n, mean, se, low, high, excludes_zero under a named quantile: t_exact, t_table or z196."""
    return _interval(deltas.groupBy(*by).agg(*_moments()), quantile)


def _moments() -> list[Column]:
    return [F.count("delta").alias("n"), F.avg("delta").alias("mean"), stats.spread(F.col("delta")).alias("sd")]


def _interval(out: DataFrame, quantile: str) -> DataFrame:
    q = {"t_exact": lambda: stats.t_exact(F.col("n") - 1), "t_table": lambda: stats.t_table(F.col("n") - 1), "z196": lambda: F.lit(1.96)}[quantile]()
    out = out.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("q_", q)
    out = out.withColumn("low", F.col("mean") - F.col("q_") * F.col("se")).withColumn("high", F.col("mean") + F.col("q_") * F.col("se"))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0)).drop("q_")


SIGN_TESTS = {"sign2_tol01": (0.01, "two", None), "sign2_tol01_r4": (0.01, "two", 4), "sign2_tol01_r6": (0.01, "two", 6), "sign1_eps": (1e-12, "one", None)}


def _outcomes(tolerance: float) -> list[Column]:
    d = F.col("delta")
    return [stats.wins(d, tolerance).alias("wins"), stats.losses(d, tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties")]


def _with_p(out: DataFrame, variant: str) -> DataFrame:
    _, sides, places = SIGN_TESTS[variant]
    p = (stats.sign_two_sided if sides == "two" else stats.sign_one_sided)(F.col("wins"), F.col("losses"))
    out = out.withColumn("p", p)
    if variant == "sign2_tol01":
        return out.withColumn("p", F.when(F.col("p") >= 1e-4, F.round("p", 4)).otherwise(F.col("p")))
    return out.withColumn("p", F.round("p", places)) if places else out


def sign_test(deltas: DataFrame, by: list[str], variant: str) -> DataFrame:
    """by, wins, losses, ties, p under a named variant: tolerance, sides and
    rounding. ``sign2_tol01`` rounds to four places only from 1e-4 on."""
    return _with_p(deltas.groupBy(*by).agg(*_outcomes(SIGN_TESTS[variant][0])), variant)


def summary(deltas: DataFrame, by: list[str], quantile: str, variant: str) -> DataFrame:
    """What a gate decides on, in one aggregation: ``pooled``, ``sign_test`` and the control's mean."""
    out = deltas.groupBy(*by).agg(*_moments(), *_outcomes(SIGN_TESTS[variant][0]), F.avg("control").alias("control"))
    return _with_p(_interval(out, quantile), variant)


def without_largest(deltas: DataFrame, by: list[str], n: int, order: Sequence[str] = ()) -> DataFrame:
    """by, jackknife_mean: the mean without the n largest; null if none is left.
    Equal deltas are counted first, so a window orders values, not rows; which of
    equal ones go (``order``) makes no difference to the mean."""
    largest_first = Window.partitionBy(*by).orderBy(F.desc("delta")).rowsBetween(Window.unboundedPreceding, -1)
    counts = deltas.where("delta is not null").groupBy(*by, "delta").agg(F.count(F.lit(1)).alias("m_"))
    dropped = F.greatest(F.lit(0), F.least("m_", n - F.coalesce(F.sum("m_").over(largest_first), F.lit(0))))
    left = counts.withColumn("left_", F.col("m_") - dropped)
    return left.groupBy(*by).agg(F.try_divide(F.sum(F.col("delta") * F.col("left_")), F.sum("left_")).alias("jackknife_mean"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho over average ranks; 0 if a side is constant. No task orders more than a range of the values."""
    return ranks.rank_correlation(rows, x, y)


def both_measured(before: DataFrame, after: DataFrame, key: list[str], values: str) -> DataFrame:
    """n_before, mean_before, n_after, mean_after over the finite values of the
    keys whose lists both sides have and aren't empty; null means without any."""
    one = lambda df, tag: df.where(F.size(values) > 0).select(*key, F.col(values).alias(tag))
    both = one(before, "b_").join(one(after, "a_"), key)
    finite = lambda c: F.filter(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    add = lambda c: F.aggregate(finite(c), F.lit(0.0), lambda s, x: s + x)
    sums = both.agg(*[f(F.expr("0") + x).alias(n) for f, x, n in ((F.sum, F.size(finite("b_")), "n_before"), (F.sum, add("b_"), "s_before"), (F.sum, F.size(finite("a_")), "n_after"), (F.sum, add("a_"), "s_after"))])
    mean = lambda t: F.try_divide(F.col(f"s_{t}"), F.col(f"n_{t}")).alias(f"mean_{t}")
    return sums.select("n_before", mean("before"), "n_after", mean("after"))


def break_even(adapt_cost: Column, frontier_cost: Column, adapted_cost: Column) -> Column:
    """Documents after which adapting pays; null if it never does."""
    return F.when(frontier_cost > adapted_cost, adapt_cost / (frontier_cost - adapted_cost))


def headroom(treated: Column, control: Column) -> Column:
    """Share of the room above the control that the treated arm captures; null without room."""
    return F.when(1 - control > 1e-9, (treated - control) / (1 - control))
