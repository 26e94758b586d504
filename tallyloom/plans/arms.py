"""Gold, predictions and arms derived from ``orders`` and ``customer`` by integer
arithmetic on keys, so that their scores are known in closed form.

Gold has five leaves (status, priority, total, cust, seg). Arm ``base`` spoils
leaf j where (key * (j + 3) + 7 j j) % 5 = 0, is broken JSON where key % 41 = 0
and missing where key % 97 = 0; arm ``tuned`` spoils leaf j where
(key * 29 + 13 j) % 23 = 0. Formatting noise (case, spaces, thousands commas, key
order) must not change a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table

LEAVES = ("status", "priority", "total", "cust", "seg")
SPOILED = {"base": "(k * ({j} + 3) + {j} * {j} * 7) % 5 = 0", "tuned": "(k * 29 + {j} * 13) % 23 = 0"}

#: The same facts in SQL: one row per order and arm with the number of spoiled leaves.
FACTS = (
    "g as (select o_orderkey as k, (c_nationkey % 7)::int as tenant, o_orderpriority as tier, ((o_orderkey * 37) % 911)::int as doc_chars from orders join customer on o_custkey = c_custkey), "
    "facts as (select k, tenant, tier, doc_chars, 'base' as arm, "
    + " + ".join(f"({SPOILED['base'].format(j=j)})::int" for j in range(5))
    + " as spoiled, k % 41 = 0 as broken, k % 97 = 0 as missing from g union all select k, tenant, tier, doc_chars, 'tuned', "
    + " + ".join(f"({SPOILED['tuned'].format(j=j)})::int" for j in range(5))
    + ", false, false from g), "
    "scores as (select *, case when missing then null when broken then 0.0 else (5 - spoiled) / 5.0 end::double as f1 from facts)"
)


def gold(spark: SparkSession, d: str) -> DataFrame:
    """k, tenant, tier, doc_chars, the five leaves, and gold JSON."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    cols = "o_orderkey k, cast(c_nationkey % 7 as int) tenant, o_orderpriority tier, cast((o_orderkey * 37) % 911 as int) doc_chars, o_orderstatus status, o_orderpriority priority, o_totalprice, cast(c_custkey as string) cust, c_mktsegment seg"
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr(*cols.split(", "))
    rows = spread(rows, "k", o)
    rows = rows.withColumn("total", F.format_string("%.2f", F.col("o_totalprice").cast("double"))).drop("o_totalprice")
    return rows.withColumn("gold", F.to_json(F.struct(*LEAVES)))


def prediction(arm: str) -> Column:
    """The arm's text for a row of gold; null where it misses the row."""

    def leaf(j: int, name: str) -> Column:
        x = F.col(name)
        if name == "total":  # grouped thousands on odd keys
            x = F.when(F.col("k") % 2 == 1, F.format_number(x.cast("double"), 2)).otherwise(x)
        elif name in ("priority", "seg"):
            x = F.when(F.col("k") % 2 == 1, F.concat(F.lit(" "), F.upper(x), F.lit("  "))).otherwise(F.lower(x))
        return F.when(F.expr(SPOILED[arm].format(j=j)), F.concat(F.lit("x"), x)).otherwise(x).alias(name)

    text = F.to_json(F.struct(*[leaf(j, n) for j, n in reversed(list(enumerate(LEAVES)))]))
    if arm == "base":
        text = F.when(F.col("k") % 97 != 0, F.when(F.col("k") % 41 == 0, F.concat(text, F.lit(" trailing"))).otherwise(text))
    return text


def predictions(g: DataFrame, arm: str) -> DataFrame:
    """``g`` with arm and prediction; rows that the arm misses are absent."""
    out = g.where("k % 97 <> 0") if arm == "base" else g
    return out.withColumn("arm", F.lit(arm)).withColumn("prediction", prediction(arm))


def wide(spark: SparkSession, d: str) -> DataFrame:
    """Gold rows with both predictions, base_text and tuned_text, null where the arm misses the row."""
    g = gold(spark, d)
    for arm in ("base", "tuned"):
        g = g.withColumn(f"{arm}_text", prediction(arm))
    return g


def both(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d)
    return predictions(g, "base").unionByName(predictions(g, "tuned"))
