"""Queries: leaves, scores, pairs, statistics, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.payload import overlap, parsed
from ..operators import gates, merges, pairing, scoring, splits, verdicts
from ..tables import table
from . import arms

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def all_scores(spark: SparkSession, d: str) -> DataFrame:
    """k, tenant, tier, doc_chars, arm, valid_json, exact_match, micro_f1; one row per order and arm, null where missing."""
    one = lambda arm: F.struct(F.lit(arm).alias("arm"), F.col(f"{arm}.valid").alias("valid_json"), F.col(f"{arm}.exact").alias("exact_match"), F.col(f"{arm}.f1").alias("micro_f1"))
    return wide_scores(spark, d).select("k", "tenant", "tier", "doc_chars", F.inline(F.array(one("base"), one("tuned"))))


def wide_scores(spark: SparkSession, d: str) -> DataFrame:
    """k, tenant, tier, doc_chars, base, tuned: an order and its score by each arm, null where missing."""
    return scoring.scored_arms(arms.wide(spark, d), {"base": "base_text", "tuned": "tuned_text"}).select("k", "tenant", "tier", "doc_chars", "base", "tuned")


def tenant_deltas(spark: SparkSession, d: str) -> DataFrame:
    """tenant, k, treated, control, delta of the rows that both arms scored."""
    x = wide_scores(spark, d).select("tenant", "k", F.col("tuned.f1").alias("treated"), F.col("base.f1").alias("control"))
    return x.where("treated is not null and control is not null").withColumn("delta", F.col("treated") - F.col("control"))


W = "with " + arms.FACTS
PAIRED = W + ", p as (select b.tenant, b.k, b.tier, b.doc_chars, t.f1 as treated, b.f1 as control, t.f1 - b.f1 as delta from scores b join scores t on b.k = t.k where b.arm = 'base' and t.arm = 'tuned' and b.f1 is not null and t.f1 is not null)"


@query(W + " select path, case when path in ('priority', 'seg') then 'word' else 'other' end as kind, count(*) as n from (select unnest(['status','priority','total','cust','seg']) as path, k from g) group by all")
def leaf_bag(spark, d):
    rows = scoring.with_parsed(arms.gold(spark, d), "gold", "parsed")
    b = scoring.bag(rows, ["k"], "parsed")
    return b.groupBy("path").agg(F.sum("n").alias("n")).select("path", F.when(F.col("path").isin("priority", "seg"), "word").otherwise("other").alias("kind"), "n")


@query(W + " select arm, k, (5 - spoiled)::int as shared from facts where not missing and not broken")
def bag_overlap(spark, d):
    rows = arms.both(spark, d).withColumn("p", parsed("prediction")).withColumn("g", parsed("gold")).where("p.valid")
    return rows.select("arm", "k", overlap(F.col("p.leaves"), F.col("g.leaves")).alias("shared"))


@query(W + " select arm, k, not broken as valid_json, f1 as micro_f1 from scores where not missing")
def doc_micro_f1(spark, d):
    return all_scores(spark, d).where("micro_f1 is not null").select("arm", "k", "valid_json", F.round("micro_f1", 9).alias("micro_f1"))


@query(W + " select arm, tenant, count(f1) as scored, count(*) filter (where broken and not missing) as invalid_json, count(*) filter (where missing) as no_completion, round(avg(f1), 4) as mean_micro_f1 from scores group by all")
def arm_rollup(spark, d):
    return scoring.arm_rollup(all_scores(spark, d), ["arm", "tenant"]).drop("exact")


@query(W + " select tenant, count(*) as n, round(avg(coalesce(f1, 0)), 6) as mean from scores where arm = 'base' group by all")
def protocol_mean(spark, d):
    g = arms.gold(spark, d)
    p = arms.predictions(g, "base").select("k", "prediction", F.lit(0).alias("line_no"))
    return scoring.protocol(g, p, "k").groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("micro_f1"), 6).alias("mean"))


@query(W + " select tenant, count(*) as n, round(avg(case when k % 5 = 0 then 0 else coalesce(f1, 0) end), 6) as zero_mean, round(avg(coalesce(f1, 0)), 6) as last_mean from scores where arm = 'base' group by all")
def duplicate_rules(spark, d):
    """Every fifth id comes twice: with an unreadable row first. One rule scores it 0, the other takes the last."""
    g = arms.gold(spark, d)
    p = arms.predictions(g, "base").select("k", "prediction", F.lit(1).alias("line_no"))
    p = p.union(g.where("k % 5 = 0").select("k", F.lit("{"), F.lit(0)))
    p = p.where("not (k % 97 = 0 and k % 5 = 0)")
    return scoring.both_protocols(g, p, "k").groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("zero"), 6).alias("zero_mean"), F.round(F.avg("last"), 6).alias("last_mean"))


@query(W + " select arm, count(*) filter (where f1 = 1 or k % 10 = 0) as f1_one, count(*) filter (where k % 10 = 0) as exact_one from scores where not missing group by arm")
def exact_vs_f1(spark, d):
    """Formatting noise leaves F1 at 1 and canonical equality false; every tenth prediction is the gold, differently spaced."""
    rows = arms.both(spark, d).withColumn("prediction", F.when(F.col("k") % 10 == 0, F.regexp_replace("gold", ":", " :  ")).otherwise(F.col("prediction")))
    s = scoring.scored(rows)
    return s.groupBy("arm").agg(F.count_if(F.col("micro_f1") == 1).alias("f1_one"), F.count_if(F.col("exact_match")).alias("exact_one"))


@query(W + " select tier, count(*) as n, round(avg(case when broken then 1.0 else 0.0 end), 6) as invalid_rate from facts where arm = 'base' and not missing group by tier")
def invalid_rate_by_tier(spark, d):
    s = all_scores(spark, d).where("arm = 'base' and micro_f1 is not null")
    return s.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((~F.col("valid_json")).cast("double")), 6).alias("invalid_rate"))


def arm_table(spark, d):
    """One record per tenant and arm; tenant 3 has no tuned arm, 4 an errored one, 5 another dtype, 6 null devices on both sides."""
    # The condition names a sum, so it stays above it and every use shares one scoring of the rows.
    s = scoring.arm_rollup(all_scores(spark, d), ["arm", "tenant"]).where("not (arm = 'tuned' and tenant = 3 and scored >= 0)").select("arm", "tenant", F.col("mean_micro_f1").alias("mean"))
    t = (F.col("arm") == "tuned")
    return s.withColumn("error", F.when(t & (F.col("tenant") == 4), "out of memory")).withColumn("device", F.when(F.col("tenant") != 6, "cpu")).withColumn("dtype", F.when(t & (F.col("tenant") == 5), "fp16").otherwise("fp32"))


ARMS = W + ", m as (select arm, tenant, round(avg(f1), 4) as mean from scores group by all), st as (select distinct tenant, case tenant when 3 then 'missing' when 4 then 'errored' when 5 then 'heterogeneous' else 'paired' end as status from g)"


@query(ARMS + " select st.tenant, status, case when status = 'paired' then round(t.mean - b.mean, 6) end as delta from st left join m b on b.tenant = st.tenant and b.arm = 'base' left join m t on t.tenant = st.tenant and t.arm = 'tuned'")
def pair_status(spark, d):
    plan = table(spark, d, "customer").select((F.col("c_nationkey") % 7).cast("int").alias("tenant")).distinct()
    return pairing.pair_status(plan, arm_table(spark, d), ["tenant"], "tuned", "base").select("tenant", "status", F.round("delta", 6).alias("delta"))


@query(PAIRED + " select tenant, k, round(delta, 6) as delta from p")
def receipt_deltas(spark, d):
    return tenant_deltas(spark, d).select("tenant", "k", F.round("delta", 6).alias("delta"))


@query(W + " select tenant, count(*) as designed, count(f1) as scored, count(*) - count(f1) as excluded, count(f1) = count(*) as symmetric from scores where arm = 'base' group by tenant")
def attrition(spark, d):
    return pairing.attrition(all_scores(spark, d), ["tenant"], "k", "tuned", "base")


@query(PAIRED + ", s as (select tenant, round(avg(f1) filter (where arm = 'tuned') - avg(f1) filter (where arm = 'base'), 6) as stamped from scores group by tenant), r as (select tenant, round(avg(delta), 6) as paired from p group by tenant) select tenant, stamped, paired from s join r using (tenant)")
def seed_deltas(spark, d):
    """The difference of the arms' own means beside the mean over shared rows: they part when attrition is lopsided."""
    t, b = F.col("tuned.f1"), F.col("base.f1")
    return wide_scores(spark, d).groupBy("tenant").agg(F.round(F.avg(t) - F.avg(b), 6).alias("stamped"), F.round(F.avg(t - b), 6).alias("paired"))


def _pooled(frame, quantile):
    out = pairing.pooled(frame, [], quantile)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "se", "low", "high")], "excludes_zero")


def _pooled_sql(rows: str, q: str) -> str:
    return f", st as (select count(*) as n, avg(delta) as mean, stddev_samp(delta) / sqrt(count(*)) as se from {rows}) select n, round(mean, 6) as mean, round(se, 6) as se, round(mean - {q} * se, 6) as low, round(mean + {q} * se, 6) as high, mean - {q} * se > 0 or mean + {q} * se < 0 as excludes_zero from st"


@query(PAIRED + _pooled_sql("p", "1.96"))
def pooled_ci_z(spark, d):
    return _pooled(tenant_deltas(spark, d), "z196")


#: The 97.5 % quantile of Student's t for many degrees of freedom, from the normal one (Cornish-Fisher, three terms).
_Z, _DF = "1.959963984540054", "(select count(*) - 1 from p)"
_T = f"round({_Z} + (pow({_Z}, 3) + {_Z}) / (4.0 * {_DF}) + (5 * pow({_Z}, 5) + 16 * pow({_Z}, 3) + 3 * {_Z}) / (96.0 * pow({_DF}, 2)) + (3 * pow({_Z}, 7) + 19 * pow({_Z}, 5) + 17 * pow({_Z}, 3) - 15 * {_Z}) / (384.0 * pow({_DF}, 3)), 4)"


@query(PAIRED + _pooled_sql("p", _T))
def pooled_ci_t(spark, d):
    return _pooled(tenant_deltas(spark, d), "t_exact")


@query(PAIRED + ", c as (select tenant, avg(delta) as delta from p group by tenant)" + _pooled_sql("c", "2.4469"))
def cluster_ci(spark, d):
    return _pooled(tenant_deltas(spark, d).groupBy("tenant").agg(F.avg("delta").alias("delta")), "t_exact")


COUNTS = PAIRED + ", c as (select tenant, avg(control) as control, avg(delta) as mean, stddev_samp(delta) as sd, count(*) as n, count(*) filter (where delta > 0.01) as wins, count(*) filter (where delta < -0.01) as losses, count(*) filter (where abs(delta) <= 0.01) as ties from p group by tenant)"


def _tail(lowest: str) -> str:
    """SQL: p of each tenant, the binomial tail from ``lowest`` wins on."""
    return f", i as (select unnest(range(0, (select max(wins + losses) + 1 from c))) as i), tail as (select tenant, sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0::double))) as p from c, i where i >= {lowest} and i <= wins + losses group by tenant)"


TWO_SIDED = _tail("greatest(wins, losses)")


@query(COUNTS + " select tenant, wins, losses, ties from c")
def sign_counts(spark, d):
    return pairing.sign_test(tenant_deltas(spark, d), ["tenant"], "sign2_tol01").drop("p")


@query(COUNTS + TWO_SIDED + " select tenant, least(1.0, round(2 * p, 6)) as p from tail")
def sign_two_sided(spark, d):
    return pairing.sign_test(tenant_deltas(spark, d), ["tenant"], "sign2_tol01_r6").select("tenant", "p")


@query(COUNTS + _tail("wins") + " select tenant, round(p, 6) as p from tail")
def sign_one_sided(spark, d):
    return pairing.sign_test(tenant_deltas(spark, d), ["tenant"], "sign1_eps").select("tenant", F.round("p", 6).alias("p"))


@query(PAIRED + ", s as (select tenant, count(*) as n, stddev_samp(delta) as sd from p group by tenant) select tenant, n, round((1.960 + 0.842) * sd / sqrt(n), 6) as mde, ceil(pow((1.960 + 0.842) * sd / 0.05, 2))::bigint as required from s")
def mde_and_required_n(spark, d):
    s = tenant_deltas(spark, d).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), stats.spread(F.col("delta")).alias("sd"))
    return s.select("tenant", "n", F.round(stats.detectable(F.col("sd"), F.col("n")), 6).alias("mde"), stats.required(F.col("sd")).cast("long").alias("required"))


@query(PAIRED + ", r as (select *, row_number() over (partition by tenant order by delta desc, k) as i from p) select tenant, round(avg(delta) filter (where i > 2), 6) as jackknife_mean from r group by tenant")
def jackknife_top2(spark, d):
    return pairing.without_largest(tenant_deltas(spark, d), ["tenant"], 2).select("tenant", F.round("jackknife_mean", 6).alias("jackknife_mean"))


@query("with x as (select n_chars, quality from documents join labels using (doc_id)), r as (select rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as a, rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2.0 as b from x) select count(*) as n, round(corr(a, b), 9) as rho from r")
def spearman_len_quality(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return pairing.spearman(x, "n_chars", "quality").select("n", F.round("rho", 9).alias("rho"))


@query(PAIRED + ", c as (select tenant, avg(control) as base, avg(delta) as delta from p group by tenant), r as (select *, row_number() over (order by base, delta, tenant) as lo, row_number() over (order by base desc, delta desc, tenant desc) as hi from c) select round(avg(delta) filter (where lo <= 4) - avg(delta) filter (where hi <= 4), 6) as gap from r")
def low_high_gap(spark, d):
    c = tenant_deltas(spark, d).groupBy("tenant").agg(F.avg("control").alias("base"), F.avg("delta").alias("delta"))
    return gates.ends_gap(c, "base", "delta").select(F.round("gap", 6).alias("gap"))


@query(PAIRED + " select k, case when 1 - control > 1e-9 then round((treated - control) / (1 - control), 6) end as fraction from p")
def headroom_fraction(spark, d):
    return tenant_deltas(spark, d).select("k", F.round(pairing.headroom(F.col("treated"), F.col("control")), 6).alias("fraction"))


@query(PAIRED + " select tenant, count(*) filter (where control = 0) as zero_docs, count(*) filter (where control = 1 and treated = 1) as both_perfect, case when abs(sum(delta)) > 1e-9 then round(coalesce(sum(delta) filter (where control = 0), 0) / sum(delta), 6) end as zero_share from p group by tenant")
def zero_doc_share(spark, d):
    x = tenant_deltas(spark, d)
    total, part = F.sum("delta"), F.coalesce(F.sum(F.when(F.col("control") == 0, F.col("delta"))), F.lit(0.0))
    return x.groupBy("tenant").agg(F.count_if(F.col("control") == 0).alias("zero_docs"), F.count_if((F.col("control") == 1) & (F.col("treated") == 1)).alias("both_perfect"), F.when(F.abs(total) > 1e-9, F.round(part / total, 6)).alias("zero_share"))


@query("with x as (select source, doc_id, n_chars, quality from documents join labels using (doc_id)), r as (select *, row_number() over (partition by source order by n_chars, doc_id) as i, count(*) over (partition by source) as n from x) select source, round(avg(quality) filter (where i <= n // 2), 6) as shorter, round(avg(quality) filter (where i > n // 2), 6) as longer from r group by source")
def median_split(spark, d):
    x = table(spark, d, "documents").select("source", "doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    # Whole lengths fall on one side; only the length that the middle cuts is ordered by id.
    h = splits.counts_before(x.withColumn("known", F.col("quality").isNotNull().cast("int")), "source", "n_chars", ("total", "quality"), ("known", "known"))
    h = h.withColumn("half", F.floor(F.col("n") / 2)).withColumn("low", F.col("before") + F.col("m") <= F.col("half")).withColumn("cut", ~F.col("low") & (F.col("before") < F.col("half")))
    middle = h.where("cut").select("source", "n_chars", (F.col("half") - F.col("before")).alias("room"))
    tied = x.join(middle, ["source", "n_chars"]).withColumn("low", F.row_number().over(Window.partitionBy("source", "n_chars").orderBy("doc_id")) <= F.col("room"))
    rows = h.where("not cut").select("source", "low", "total", "known").unionByName(tied.select("source", "low", F.col("quality").alias("total"), F.col("quality").isNotNull().cast("int").alias("known")))
    mean = lambda side: F.round(F.try_divide(F.sum(F.when(side, F.col("total"))), F.sum(F.when(side, F.col("known")))), 6)
    return rows.groupBy("source").agg(mean(F.col("low")).alias("shorter"), mean(~F.col("low")).alias("longer"))


@query(PAIRED + ", c as (select tenant, avg(delta) as delta from p group by tenant) select count(*) as tenants, round(min(delta), 6) as low, round(max(delta), 6) as high, round(avg(delta), 6) as mean, round(max(delta) - min(delta), 6) as range, count(*) filter (where delta < 0) as negative from c")
def difficulty_map(spark, d):
    c = tenant_deltas(spark, d).groupBy("tenant").agg(F.avg("delta").alias("delta"))
    r = lambda x, name: F.round(x, 6).alias(name)
    return c.agg(F.count(F.lit(1)).alias("tenants"), r(F.min("delta"), "low"), r(F.max("delta"), "high"), r(F.avg("delta"), "mean"), r(F.max("delta") - F.min("delta"), "range"), F.count_if(F.col("delta") < 0).alias("negative"))


GATE = COUNTS + TWO_SIDED + ", q as (select *, mean - 1.96 * sd / sqrt(n) as low, 2 * p < 0.05 as agrees from c join tail using (tenant))"


def _gate_rows(spark, d):
    return pairing.summary(tenant_deltas(spark, d), ["tenant"], "z196", "sign2_tol01")


@query(GATE + " select tenant, case when control < 0.15 or control > 0.95 then 'UNINFORMATIVE' when tenant % 3 = 2 then 'UNDECIDABLE' when mean >= 0.05 and low > 0 and agrees and wins > losses then 'GO' else 'PIVOT' end as verdict from q")
def gate_verdict(spark, d):
    """Tenants 2 and 5 have a blocked pair."""
    g = _gate_rows(spark, d)
    trips = (verdicts.validity(F.col("control")) != "ok").cast("int")
    return g.select("tenant", verdicts.gate(trips, (F.col("tenant") % 3 == 2).cast("int"), F.col("mean"), F.col("low"), F.col("p"), F.col("wins"), F.col("losses")).alias("verdict"))


@query(GATE + " select tenant, case when tenant < 2 then 'UNINFORMATIVE' when tenant < 4 then 'UNDECIDABLE' when mean >= 0.05 and low > 0 and agrees and wins > losses then 'PASS' else 'FAIL' end as verdict from q")
def gate_verdict_priority(spark, d):
    """Forced floors come before forced blocks, those before the numbers."""
    g = _gate_rows(spark, d).withColumn("control", F.when(F.col("tenant") < 2, 0.1).otherwise(0.5))
    trips = (verdicts.validity(F.col("control")) != "ok").cast("int")
    return g.select("tenant", verdicts.gate(trips, (F.col("tenant") < 4).cast("int"), F.col("mean"), F.col("low"), F.col("p"), F.col("wins"), F.col("losses"), ("PASS", "FAIL")).alias("verdict"))


@query(GATE + " select tenant, case when tenant = 6 then 'REFUSED' when mean >= -0.05 and wins >= losses then 'PASS' else 'FAIL' end as retained, case when tenant = 6 then 'REFUSED' when mean >= 0.05 and low > 0 and wins > losses then 'PASS' else 'FAIL' end as unified from q")
def retention_reads(spark, d):
    g = _gate_rows(spark, d).withColumn("mean", F.when(F.col("tenant") != 6, F.col("mean")))
    return g.select("tenant", verdicts.retention(F.col("mean"), F.col("wins"), F.col("losses")).alias("retained"), verdicts.unified(F.col("mean"), F.col("low"), F.col("wins"), F.col("losses")).alias("unified"))


@query(ARMS + " select m.tenant, m.arm, case when arm = 'base' then 'skip' when m.tenant = 3 then 'add' when m.tenant = 4 then 'supersede error' when m.tenant = 5 then 'supersede environment' when m.tenant = 6 then 'conflict' else 'skip' end as action from m")
def bank_merge(spark, d):
    existing = arm_table(spark, d)
    incoming = scoring.arm_rollup(all_scores(spark, d), ["arm", "tenant"]).select("arm", "tenant", F.col("mean_micro_f1").alias("mean")).withColumn("error", F.lit(None).cast("string"))
    incoming = incoming.withColumn("device", F.when(F.col("tenant") != 6, "cpu")).withColumn("dtype", F.lit("fp32"))
    incoming = incoming.withColumn("mean", F.when((F.col("arm") == "tuned") & (F.col("tenant") == 6), F.col("mean") + 0.1).otherwise(F.col("mean")))
    return merges.bank(existing, incoming, ["arm", "tenant"]).select("tenant", "arm", "action")


@query(W + ", m as (select tenant, avg(f1) as mean, count(f1) as n, sum(5 - spoiled) filter (where not broken and not missing) as fifths from scores where arm = 'base' group by tenant), s as (select tenant, round(fifths / (5.0 * n), 4) + case tenant % 3 when 2 then 0.01 when 1 then 0.0003 else 0 end as stamped, mean from m) select tenant, round(stamped, 6) as stamped, round(mean, 6) as recomputed from s where abs(stamped - mean) > 0.0005")
def audit_mismatch(spark, d):
    """Stamps from the roll-up, rounded to four places, against the mean of the
    rows; some are off by 3e-4, which passes, some by 1e-2."""
    s = all_scores(spark, d).where("arm = 'base'")
    m = s.groupBy("tenant").agg(F.avg("micro_f1").alias("mean"))
    off = F.element_at(F.array(F.lit(0.0), F.lit(0.0003), F.lit(0.01)), F.col("tenant") % 3 + 1)
    stamped = scoring.arm_rollup(s, ["tenant"]).select("tenant", (F.col("mean_micro_f1") + off).alias("mean"))
    return merges.mismatches(stamped, m, ["tenant"], "mean").select("tenant", F.round("stamped", 6).alias("stamped"), F.round("recomputed", 6).alias("recomputed"))


@query(W + ", f as (select k, case when (k * 3) % 5 = 0 then 1 else 0 end as s0, case when (k * 4 + 7) % 5 = 0 then 1 else 0 end as s1 from g), x as (select k, 'status' as path, s0 as bad, 0 as gone from f union all select k, 'priority', s1, (k % 20 = 0)::int from f) select k, path, case when gone = 1 then 'miss' when bad = 1 then 'wrong' else 'hit' end as status from x union all select k, 'more', 'extra' from f")
def field_diff_status(spark, d):
    g = arms.gold(spark, d)
    leaf = lambda name, v: F.struct(F.lit(name).alias("path"), v.alias("value"))
    spoil = lambda j, name: F.when(F.expr(arms.SPOILED["base"].format(j=j)), F.concat(F.lit("x"), F.col(name))).otherwise(F.col(name))
    gold = g.select("k", F.inline(F.array(leaf("status", F.col("status")), leaf("priority", F.col("priority")))))
    pred = g.select("k", F.inline(F.array(leaf("status", spoil(0, "status")), leaf("priority", spoil(1, "priority")), leaf("more", F.lit("1"))))).where("not (path = 'priority' and k % 20 = 0)")
    return scoring.field_status(pred, gold, ["k"])
