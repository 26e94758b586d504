"""Queries: gates over run records that come from the scores of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, pairing, splits
from ..sources import readers
from ..tables import table
from .scores import PAIRED, W, all_scores, wide_scores

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A record for each rung (tier), k, seed (tenant) and arm; some tuned ones are missing, errored or from another device."""
    s = all_scores(spark, d).withColumn("rung", F.substring("tier", 1, 1).cast("int")).withColumn("seed", F.col("tenant"))
    r = s.groupBy("rung", F.when(F.col("k") % 2 == 0, 10).otherwise(30).alias("k"), "seed", "arm").agg(F.round(F.avg("micro_f1"), 4).alias("mean"))
    tuned = F.col("arm") == "tuned"
    r = r.where(~(tuned & ((F.col("rung") == 2) & (F.col("seed") == 3))))
    return r.withColumn("error", F.when(tuned & (F.col("rung") == 3) & (F.col("seed") < 2), "oom")).withColumn("device", F.when(~(tuned & (F.col("rung") == 4) & (F.col("seed") > 4)), "cpu")).withColumn("dtype", F.lit("fp32"))


RUNS = W + """, r as (select left(tier, 1)::int as rung, case when k % 2 = 0 then 10 else 30 end as k, tenant as seed, arm, round(avg(f1), 4) as mean from scores group by all),
pr as (select t.rung, t.k, t.seed, round(t.mean - b.mean, 4) as delta, case when t.rung = 2 and t.seed = 3 then 'missing' when t.rung = 3 and t.seed < 2 then 'errored' when t.rung = 4 and t.seed > 4 then 'heterogeneous' else 'paired' end as status
  from r t join r b on t.rung = b.rung and t.k = b.k and t.seed = b.seed where t.arm = 'tuned' and b.arm = 'base')"""


@query(RUNS + """, z as (select rung, count(*) as designed, count(*) filter (where status = 'paired') as complete, coalesce(string_agg(seed::varchar, ',' order by seed) filter (where status = 'heterogeneous'), '') as blocked, avg(delta) as mean from pr where k = 10 group by rung)
select rung, designed, complete, blocked, case when complete = designed then round(mean, 6) end as mean_delta, case when complete < designed then 'UNDECIDABLE' when mean >= 0.05 then 'PASS' else 'FAIL' end as verdict, case when complete < designed then 'undecidable: ' || complete || '/' || designed || ' gating pairs complete' end as status from z""")
def receipts_gate(spark, d):
    """Every rung's gate: rungs 2, 3 and 4 have pairs that are missing, errored, or blocked by their environments."""
    plan = table(spark, d, "customer").select((F.col("c_nationkey") % 7).cast("int").alias("seed")).distinct()
    tiers = table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("rung")).distinct()
    designed = plan.join(F.broadcast(tiers)).join(F.broadcast(spark.createDataFrame([(10,), (30,)], "k int")))  # seeds by tiers by two
    out = gates.receipts(designed, _runs(spark, d), "tuned", "base")
    return out.withColumn("blocked", F.array_join(F.col("blocked").cast("array<string>"), ",")).withColumn("mean_delta", F.round("mean_delta", 6))


CELLS = PAIRED + ", c as (select tier, tenant, round(avg(control), 9) as base, round(avg(delta), 9) as delta from p group by tier, tenant), o as (select *, row_number() over (order by base, delta) as lo, row_number() over (order by base desc, delta desc) as hi, rank() over (order by base) + (count(*) over (partition by base) - 1) / 2.0 as ra, rank() over (order by delta) + (count(*) over (partition by delta) - 1) / 2.0 as rb from c)"


@query(CELLS + ", v as (select count(*) as cells, max(base) - min(base) as spread, corr(ra, rb) as rho, avg(delta) filter (where lo <= 4) - avg(delta) filter (where hi <= 4) as gap from o) select cells, round(spread, 6) as spread, round(rho, 6) as rho, round(gap, 6) as gap, case when cells < 10 or spread < 0.1 then 'UNINFORMATIVE' when rho <= -0.6 and gap >= 0.1 then 'PASS' when rho <= -0.6 or gap >= 0.1 then 'PARTIAL' else 'REFUTED' end as verdict from v")
def difficulty_law(spark, d):
    """Cells of tier and tenant: do the harder ones gain more?"""
    x = wide_scores(spark, d).select("tier", "tenant", F.col("tuned.f1").alias("t"), F.col("base.f1").alias("b")).where("t is not null and b is not null")
    cells = x.groupBy("tier", "tenant").agg(F.round(F.avg("b"), 9).alias("base"), F.round(F.avg(F.col("t") - F.col("b")), 9).alias("delta"))
    out = gates.difficulty(cells)
    return out.select("cells", *[F.round(c, 6).alias(c) for c in ("spread", "rho", "gap")], "verdict")


GROUPS = PAIRED + ", h as (select tenant, case when k % 2 = 0 then 10 else 30 end as k, case when tenant = 6 then 1.0 else control end as control, case when tenant = 5 then -delta when tenant = 6 then 0.0 else delta end as delta from p), c as (select tenant, k, count(*) as n, avg(control) as control, avg(delta) as mean, count(*) filter (where delta > 1e-12) as wins, count(*) filter (where delta < -1e-12) as losses from h group by tenant, k), i as (select unnest(range(0, (select max(wins + losses) + 1 from c))) as i), t as (select tenant, k, sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0::double))) as p from c, i where i >= wins and i <= wins + losses group by tenant, k)"


@query(GROUPS + " select tenant, c.k, n, round(mean, 6) as mean, round(least(p, 1.0), 6) as p, case when mean >= 0.05 and p < 0.05 and wins > losses then 'PASS' else 'FAIL' end as verdict, case when control >= 0.98 then 'saturated baseline' when mean <= 0 then 'no help' else 'helps' end as advice, case when c.k = 10 then 'secondary' else 'decision' end as role from c join t using (tenant, k)")
def rehearsals(spark, d):
    """A rehearsal for each tenant and k: tenant 5 loses by what others win, tenant 6's baseline is saturated."""
    x = wide_scores(spark, d).select("tenant", F.when(F.col("k") % 2 == 0, 10).otherwise(30).alias("k"), F.col("tuned.f1").alias("treated"), F.col("base.f1").alias("control")).where("treated is not null and control is not null")
    x = x.withColumn("delta", F.expr("case tenant when 5 then control - treated when 6 then 0D else treated - control end")).withColumn("control", F.expr("if(tenant = 6, 1D, control)"))
    out = gates.rehearsal(x, ["tenant", "k"], "k")
    return out.select("tenant", "k", "n", F.round("mean", 6).alias("mean"), F.round("p", 6).alias("p"), "verdict", "advice", "role")


@query("with s as (select unnest([203, 204, 206, 207, 208, 209]) as seed), r as (select distinct 200 + n_nationkey as seed, n_regionkey as r from nation) select seed::int as seed, case when seed not in (select seed from r) then 'missing' when r = 1 then 'errored' when r = 2 then 'heterogeneous' else 'paired' end as status from s left join r using (seed)")
def frozen_seeds(spark, d):
    """The frozen seeds among the runs of nations: others don't count, and none is missed silently."""
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 200).cast("int").alias("seed"), F.col("n_regionkey").alias("r")).withColumn("k", F.lit(30))
    arm = lambda name, error, device: n.select("k", "seed", F.lit(name).alias("arm"), error.alias("error"), device.alias("device"), F.lit("fp32").alias("dtype"), F.lit(0.5).alias("mean"))
    nothing = F.lit(None).cast("string")
    runs = arm("adapted", F.when(F.col("r") == 1, "oom"), F.when(F.col("r") == 2, "gpu").otherwise("cpu")).union(arm("kshot", nothing, F.lit("cpu")))
    return pairing.pair_status(gates.frozen_plan(spark, 30), runs, ["k", "seed"], "adapted", "kshot").select("seed", "status")


@query("select case when doc_id % 3 = 0 then 'done' else 'fresh' end as origin, doc_id as index, row_number() over (order by doc_id) - 1 as place, n_chars as score from documents")
def resumed_in_order(spark, d):
    """Results of a run that was resumed, in the order of their index again: what was done before, and what the rest gave."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("n_chars").alias("score"))
    done = x.where("index % 3 = 0").withColumn("origin", F.lit("done"))
    fresh = x.withColumn("origin", F.lit("fresh"))
    return splits.resumed(done, fresh, ["index"]).select("origin", "index", "place", "score")


@query("select doc_id as index, n_chars as score from documents where doc_id % 4 = 1")
def indexed_subset(spark, d):
    """The results whose index a list of wanted ones has."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("n_chars").alias("score"))
    return readers.subset(x, x.where("index % 4 = 1").select("index"), "index")


@query()
def shuffled_slices(spark, d):
    """The first 30 rows of a seeded shuffle train, the next 50 are evaluated; the draw is tested."""
    return splits.shuffled_slices(table(spark, d, "documents").select("doc_id"), "doc_id", 30, 50, 7).select("doc_id", "split", "index")
