"""Queries: files of tasks, generated kits, normal forms and quantiles, each value of which SQL computes too."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import grids, stats
from ..functions.payload import normal_leaf
from ..operators import corpora, generate, pairing, scoring, splits, verdicts
from ..sources import files, readers, sinks
from ..tables import table
from . import arms
from .scores import COUNTS, PAIRED, W, _tail, tenant_deltas
from .tables_grid import CELLS, PALETTE, PLACES, vectors
from .tables_text import EX

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- normal forms -------------------------------------------------------------------------------------------------------


@query(W + r""", v as (select o_orderkey as k, unnest([{'path': 'status', 'value': lower(o_orderstatus)}, {'path': 'priority', 'value': lower(o_orderpriority)}, {'path': 'total', 'value': regexp_replace(printf('%.2f', o_totalprice::double), '\.?0+$', '')}, {'path': 'cust', 'value': c_custkey::varchar}, {'path': 'seg', 'value': lower(c_mktsegment)}]) as l from orders join customer on o_custkey = c_custkey) select k, l.path as path, l.value as value, 1::bigint as n from v""")
def leaf_values(spark, d):
    """Every leaf of every gold document in its normal form."""
    return scoring.bag(scoring.with_parsed(arms.gold(spark, d), "gold", "parsed"), ["k"], "parsed")


#: Texts around a price p with c cents: how each is written, and its normal form (n: the plain number).
_FORMS = {
    0: ("concat('+', p_grouped, '.', c, '0')", "n"), 1: ("concat('  -00', p, '.', c, ' ')", "'-' || n"), 2: ("concat(p, '.', c)", "n"), 3: ("concat(p, ',12', c)", "p || ',12' || c"),
    4: ("concat(p_grouped, '.')", "p_grouped || '.'"), 5: ("concat('EUR\\t', p, '\\n x')", "'eur ' || p || ' x'"), 6: ("concat('é', p_grouped)", "'é' || p_grouped"),
}


@query(r"with l as (select l_orderkey as k, l_linenumber as line, floor(l_extendedprice)::bigint as p, printf('%02d', ((l_extendedprice * 100)::bigint % 100)::int) as c from lineitem group by all), t as (select *, regexp_replace(printf('%.2f', (p || '.' || c)::double), '\.?0+$', '') as n, trim(printf('%,d', p)) as p_grouped from l) select k, line, p::varchar || '.' || c as price, case (k + line) % 7 " + " ".join(f"when {i} then {form}" for i, (_, form) in _FORMS.items()) + " end as normal from t")
def leaf_numbers(spark, d):
    """Prices in seven forms, of which three are numbers: signs, zeros, grouped
    digits, what only looks grouped, words."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.floor("l_extendedprice").cast("long").alias("p"), F.format_string("%02d", (F.round(F.col("l_extendedprice") * 100).cast("long") % 100)).alias("c")).distinct()
    x = li.withColumn("p_grouped", F.format_number("p", 0)).withColumn("p", F.col("p").cast("string"))
    form = F.expr("case (k + line) % 7 " + " ".join(f"when {i} then {text}" for i, (text, _) in _FORMS.items()) + " end")
    return x.select("k", "line", F.concat("p", F.lit("."), "c").alias("price"), normal_leaf(form).alias("normal"))


# ---- grids --------------------------------------------------------------------------------------------------------------


_TURNED = " union all ".join(f"select vec_id, {k} as rotations, {'true' if f else 'false'} as flip, {r} as nr, {'7 - (' + q + ')' if f else q} as nq, v as nv from c" for f in (False, True) for k, (r, q) in PLACES.items())


@query("with " + CELLS + f", x as ({_TURNED}), z as (select vec_id, rotations, flip, nr, string_agg(({PALETTE!r}[nv + 1])::varchar, '' order by nq) as t from x group by all), o as (select vec_id, r, string_agg(v::varchar, '' order by q) as t from c group by all), w as (select vec_id, sha256(string_agg(t, chr(10) order by r)) as digest from o group by vec_id) select vec_id, rotations, flip, sha256(string_agg(z.t, chr(10) order by nr)) as augmented, w.digest as restored from z join w using (vec_id) group by vec_id, rotations, flip, w.digest")
def augmented_sweep(spark, d):
    """Every grid turned, mirrored and painted in all eight ways, and brought back."""
    elements = spark.createDataFrame([(k, f) for f in (False, True) for k in range(4)], "rotations int, flip boolean")
    rows = vectors(spark, d).crossJoin(F.broadcast(elements))  # eight rows, always
    args = (F.col("rotations"), F.col("flip"), F.array(*map(F.lit, PALETTE)))
    there = rows.withColumn("there", grids.augmented(F.col("grid"), *args))
    return there.select("vec_id", "rotations", "flip", F.sha2(grids.text(F.col("there")), 256).alias("augmented"), F.sha2(grids.text(grids.restored(F.col("there"), *args)), 256).alias("restored"))


def _grid_files(spark: SparkSession, d: str) -> str:
    """A task file for each part whose key ends in 0: grids of the key's digits; every fifth has an input that isn't a grid, every seventh no test."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k")).where("k % 10 = 0")
    digits = F.transform(F.split(F.col("k").cast("string"), ""), lambda x: x.cast("int"))
    pair = lambda g: F.struct(g.alias("input"), F.array(F.reverse(digits)).alias("output"))
    body = F.struct(F.array(pair(F.when(F.col("k") % 50 == 0, F.array(F.array(F.lit(11)))).otherwise(F.array(digits)))).alias("train"), F.when(F.col("k") % 70 != 0, F.array(pair(F.array(digits)))).otherwise(F.array().cast("array<struct<input:array<array<int>>,output:array<array<int>>>>")).alias("test"))
    at = scratch.folder(spark, "grids")
    files.file_each(p.select(F.to_json(body).alias("value"), F.concat(F.lit("t"), "k").alias("name")), at, "name", "value")
    return at


@query("with t as (select p_partkey as k from part where p_partkey % 10 = 0) select count(*) as tasks, count(*) filter (where k % 50 = 0) as bad_inputs, count(*) filter (where k % 70 = 0) as without_test, sum(case when k % 70 <> 0 then length(k::varchar) else 0 end)::bigint as test_cells from t")
def grid_task_files(spark, d):
    """Tasks read from a file each, and what is wrong with them."""
    t = readers.grid_tasks(spark, _grid_files(spark, d), "*.txt")
    has = lambda reason: F.count_if(F.array_contains("_errors", reason))
    size = F.aggregate("test", F.lit(0).cast("long"), lambda s, p: s + grids.cells(p["input"]))
    return t.agg(F.count(F.lit(1)).alias("tasks"), has("bad train input").alias("bad_inputs"), has("no test pairs").alias("without_test"), F.sum(size).alias("test_cells"))


# ---- quantiles and renderings -------------------------------------------------------------------------------------------


#: The 97.5 % quantile by bisection of Simpson's rule over the density, 800 steps.
QUANTILES = PAIRED + """, n as (select tenant, (count(*) % 40 + 2)::int as df from p group by tenant),
b as (with recursive r(tenant, df, lo, hi, i) as (
    select tenant, df, 0.0::double, 16.0::double, 0 from n
    union all
    select tenant, df, case when area < 0.475 then mid else lo end, case when area < 0.475 then hi else mid end, i + 1 from (
        select r.tenant, df, lo, hi, i, (lo + hi) / 2 as mid, (select sum((case when j = 0 or j = 800 then 1 when j % 2 = 1 then 4 else 2 end) * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0) - 0.5 * ln(df * pi()) - (df + 1) / 2.0 * ln(1 + pow((lo + hi) / 2 * j / 800.0, 2) / df))) * (lo + hi) / 2 / 2400.0 from range(0, 801) s(j)) as area from r where i < 40))
  select * from r where i = 40)"""


@query(QUANTILES + " select tenant, df, round((lo + hi) / 2, 4) as quantile from b")
def t_quantiles(spark, d):
    """Student's quantile for as many degrees of freedom as tenants have rows, modulo 40."""
    n = tenant_deltas(spark, d).groupBy("tenant").agg((F.count(F.lit(1)) % 40 + 2).cast("int").alias("df"))
    return n.select("tenant", "df", F.round(stats.t_exact(F.col("df")), 4).alias("quantile"))


@query(COUNTS + _tail("wins") + ", q as (select tenant, case when p < 1e-15 then '< 1e-15' else 'p' end as shown, least(p, 1) as p from tail) select tenant, shown, round(p, 5) as p from q")
def p_renderings(spark, d):
    """One-sided p of every tenant, as it is shown: below 1e-15 only its bound."""
    s = pairing.sign_test(tenant_deltas(spark, d), ["tenant"], "sign1_eps")
    shown = verdicts.p_text(F.col("p"))
    return s.select("tenant", F.when(shown.startswith("<"), shown).otherwise("p").alias("shown"), F.round("p", 5).alias("p"))


@query("with z as (select distinct (l_discount * 100)::int as cents from lineitem), s as (select cents, cents / 4.0::double as x from z), i as (select cents, x, (select sum((case when j = 0 or j = 400 then 1 when j % 2 = 1 then 4 else 2 end) * exp(-pow(x * j / 400.0, 2) / 2)) * x / 1200.0 from range(0, 401) r(j)) as area from s) select cents, round(0.5 + area / sqrt(2 * pi()), 7) as p from i")
def normal_probabilities(spark, d):
    """The normal distribution at quarters of a discount's cents; SQL integrates the density."""
    z = table(spark, d, "lineitem").select(F.round(F.col("l_discount") * 100).cast("int").alias("cents")).distinct()
    return z.select("cents", F.round(stats.normal_cdf(F.col("cents") / 4.0), 7).alias("p"))


# ---- kits ---------------------------------------------------------------------------------------------------------------


@query("select conv_id, i as index, length(input)::int as prompt_chars, length(output)::int as gold_chars from (" + EX + " select * from x)")
def prompt_files(spark, d):
    """Prompts and gold written apart and inline, read again and joined by id."""
    x = corpora.exchanges(table(spark, d, "conversations"))
    rows = x.select(F.concat_ws(":", "conv_id", "index").alias("id"), F.col("input").alias("text"), F.to_json(F.struct("output")).alias("gold"))
    at = scratch.folder(spark, "prompts")
    sinks.prompts(rows, f"{at}/apart")
    sinks.prompts(rows, f"{at}/inline", inline=True)
    prompts, gold = (spark.read.schema(f"id string, {c} string").json(f"{at}/apart/{name}") for name, c in (("prompts", "text"), ("gold", "gold")))
    inline = spark.read.schema("id string, text string, gold string").json(f"{at}/inline")
    both = prompts.join(gold, "id").join(inline.withColumnsRenamed({"text": "t", "gold": "g"}), "id").where("text = t and gold = g")
    answer = F.from_json("gold", "output string")["output"]
    return both.select(F.split("id", ":")[0].cast("long").alias("conv_id"), F.split("id", ":")[1].cast("int").alias("index"), F.length("text").alias("prompt_chars"), F.length(answer).alias("gold_chars"))


@query("select n_nationkey as seed, e::int as ordinal, 45::int as total, e % 3 = 0 as is_plain, 0::int as background from nation, range(0, 24) r(e)")
def seeded_palettes(spark, d):
    """The sweep of each nation's seed with two palettes to an element: all are
    permutations, the first of each element is plain, and the background stays."""
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").alias("seed"))

    def draw(frames):
        for pdf in frames:
            for seed in pdf["seed"]:
                rows = [(int(seed), 3 * element + i, p) for element in range(8) for i, p in enumerate([list(range(10)), *generate.palettes(int(seed) + element, 2, True)])]
                yield pd.DataFrame(rows, columns=["seed", "ordinal", "palette"])

    out = seeds.mapInPandas(draw, "seed int, ordinal int, palette array<int>")
    plain = F.array(*map(F.lit, range(10)))
    return out.where(F.array_sort("palette") == plain).select("seed", "ordinal", F.aggregate("palette", F.lit(0), lambda s, x: s + x).alias("total"), (F.col("palette") == plain).alias("is_plain"), F.col("palette")[0].alias("background"))


@query("with r as (select conv_id, unnest(['train', 'holdout']) as side from conversations) select 10::bigint as train, count(distinct conv_id) - 10 as holdout, 0::bigint as shared from r")
def seeded_split(spark, d):
    """Ten conversations train; which ones is drawn by a seed and tested."""
    c = table(spark, d, "conversations").select("conv_id").distinct()
    s = splits.seeded_split(c, "conv_id", 10, 11)
    per = s.groupBy("conv_id").agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "holdout").alias("h"))
    return per.agg(F.sum("t").alias("train"), F.sum("h").alias("holdout"), F.count_if((F.col("t") > 0) & (F.col("h") > 0)).alias("shared"))


@query("select l_orderkey as k, l_linenumber as line, '{\"menu\":' || l_quantity::int || '}' as gt_parse from lineitem where l_linenumber % 3 <> 0 group by all")
def pruned_receipts(spark, d):
    """Labels read from one JSON column of a table; rows without gt_parse fall away."""
    at = scratch.folder(spark, "receipts")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")).distinct()
    inner = F.when(F.col("l_linenumber") % 3 != 0, F.struct(F.col("q").alias("menu")))
    li.select(F.to_json(F.struct(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), inner.alias("gt_parse"))).alias("ground_truth"), F.lit("x" * 100).alias("image")).write.parquet(at)
    found = readers.pruned_rows(spark, at, "ground_truth")
    return found.select(F.get_json_object("ground_truth", "$.k").cast("long").alias("k"), F.get_json_object("ground_truth", "$.line").cast("int").alias("line"), "gt_parse")
