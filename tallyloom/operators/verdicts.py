"""Decisions as ordered rules over one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bar, the validity window of the control's mean, the level.
BAR, FLOOR, CEILING, LEVEL = 0.05, 0.15, 0.95, 0.05


def validity(control_mean: Column) -> Column:
    """floor, ceiling, no mean or ok (strict bounds)."""
    return F.when(control_mean.isNull(), "no mean").when(control_mean < FLOOR, "floor").when(control_mean > CEILING, "ceiling").otherwise("ok")


def gate(trips: Column, blocked: Column, mean: Column, low: Column, p: Column, wins: Column, losses: Column, words: tuple[str, str] = ("GO", "PIVOT")) -> Column:
    """UNINFORMATIVE if a validity trip occurred, then UNDECIDABLE if a designed
    pair is blocked, then the first word if the mean reaches the bar, its
    interval lies above zero and the two-sided sign test agrees, else the second."""
    passes = (mean >= BAR) & (low > 0) & (p < LEVEL) & (wins > losses)
    return F.when(trips > 0, "UNINFORMATIVE").when(blocked > 0, "UNDECIDABLE").when(F.coalesce(passes, F.lit(False)), words[0]).otherwise(words[1])


def receipts_gate(blocked: Column, mean: Column) -> Column:
    return F.when(blocked > 0, "UNDECIDABLE").when(mean >= BAR, "PASS").otherwise("FAIL")


def retention(mean: Column, wins: Column, losses: Column) -> Column:
    return F.when(mean.isNull(), "REFUSED").when((mean >= -BAR) & (wins >= losses), "PASS").otherwise("FAIL")


def unified(mean: Column, low: Column, wins: Column, losses: Column) -> Column:
    return F.when(mean.isNull(), "REFUSED").when((mean >= BAR) & (low > 0) & (wins > losses), "PASS").otherwise("FAIL")


def difficulty(cells: Column, spread: Column, rho: Column, gap: Column) -> Column:
    """Needs ten cells and a spread of 0.10; PASS takes both criteria, PARTIAL one."""
    r, g = rho <= -0.60, gap >= 0.10
    return F.when((cells < 10) | (spread < 0.10), "UNINFORMATIVE").when(r & g, "PASS").when(r | g, "PARTIAL").otherwise("REFUTED")


def rehearsal(mean: Column, p_one_sided: Column, wins: Column, losses: Column) -> Column:
    """The interval is reported, not gating."""
    return F.when((mean >= BAR) & (p_one_sided < LEVEL) & (wins > losses), "PASS").otherwise("FAIL")


def role(k: Column) -> Column:
    """k = 10 is reported and can never decide."""
    return F.when(k == 10, "secondary").otherwise("decision")


def advice(control_mean: Column, delta: Column) -> Column:
    return F.when(control_mean >= 0.98, "saturated baseline").when(delta <= 0, "no help").otherwise("helps")


def p_text(p: Column) -> Column:
    return F.when(p.isNull(), "n/a").when(p < 1e-15, "< 1e-15").otherwise(F.format_string("%.4g", p))
