"""Queries: files of one object, digests and manifests, versions, audits of what was published, claimed counts, endless streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import audits, ranks
from ..sources import files, sinks
from ..sources.versions import Refused, Versions
from ..streaming import epochs
from ..tables import table
from .scores import PAIRED, wide_scores
from .tables_grid import CELLS, vectors

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- one object to a file -----------------------------------------------------------------------------------------------


ROWS = "with " + CELLS + ", rt as (select vec_id, r, '[' || string_agg(v::varchar, ',' order by q) || ']' as row, '[' || string_agg(((v + 1) % 10)::varchar, ',' order by q) || ']' as other from c group by vec_id, r), g as (select vec_id, '[' || string_agg(row, ',' order by r) || ']' as grid, '[' || string_agg(other, ',' order by r) || ']' as second from rt group by vec_id)"


@query(ROWS + " , e as (select vec_id // 2 as task, vec_id % 2 as test, case when vec_id % 5 = 4 then '[[0]]' else grid end as a, case when vec_id % 3 = 0 then second when vec_id % 5 = 4 then '[[0]]' else grid end as b from g) select 't' || task as task_id, '[' || string_agg('{\"attempt_1\":' || a || ',\"attempt_2\":' || b || '}', ',' order by test) || ']' as entries from e group by task")
def submission_file(spark, d):
    """Two tests to a task, written as one object and read again: every third test
    has a second attempt, every fifth lacks the first."""
    g = vectors(spark, d).select(F.concat(F.lit("t"), F.floor(F.col("vec_id") / 2).cast("string")).alias("task_id"), (F.col("vec_id") % 2).alias("test_index"), "vec_id", "grid")
    other = F.transform("grid", lambda r: F.transform(r, lambda c: (c + 1) % 10))
    nothing = F.lit(None).cast("array<array<int>>")
    tries = F.array(F.struct(F.lit(1).alias("attempt"), F.when(F.col("vec_id") % 5 != 4, F.col("grid")).alias("grid")), F.struct(F.lit(2).alias("attempt"), F.when(F.col("vec_id") % 3 == 0, other).otherwise(nothing).alias("grid")))
    at = scratch.folder(spark, "submission") + ".json"
    sinks.submission(g.select("task_id", "test_index", F.inline(tries)), at)
    return files.object_entries(spark, at).select(F.col("key").alias("task_id"), F.col("value").alias("entries"))


@query("select source, count(*) as n, sum(n_chars)::bigint as chars, max(case when source = (select min(source) from documents) then null else doc_id end) as latest from documents group by source")
def summary_file(spark, d):
    """A summary of each source as the entries of one object, nulls written."""
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("source").alias("first"))
    s = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("latest")).join(F.broadcast(first))  # one row
    at = scratch.folder(spark, "summary") + ".json"
    sinks.summary_object(s.withColumn("latest", F.when(F.col("source") != F.col("first"), F.col("latest"))).drop("first"), at, "source")
    return files.object_entries(spark, at).select(F.col("key").alias("source"), F.from_json("value", "n long, chars long, latest long").alias("v")).select("source", "v.*")


# ---- digests ------------------------------------------------------------------------------------------------------------

LINES = "f as (select o_orderkey % 7 as part, string_agg(o_orderkey || ' ' || o_orderstatus || chr(10), '' order by o_orderkey) as body from orders group by 1)"


def _parts(spark: SparkSession, d: str) -> str:
    """Seven files of orders, a line each."""
    at = scratch.folder(spark, "parts")
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("part"), "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderstatus").alias("value"))
    o.repartition(7, "part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(at)
    return at


@query("with " + LINES + " select part, length(body)::bigint as bytes, ((length(body) + 1023) // 1024)::bigint as chunks, sha256(body) as sha256 from f")
def chunked_digests(spark, d):
    """Files read and digested in chunks of a kilobyte."""
    found = files.digests(spark, _parts(spark, d), chunk=1024).where("file like '%/part=%'")
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "bytes", "chunks", "sha256")


@query("with " + LINES + " select 'files/part=' || part as name, '{\"bytes\":' || length(body) || ',\"sha256\":\"' || sha256(body) || '\"}' as value from f union all select 'commit', 'none' union all select 'orders', count(*)::varchar from orders")
def manifest_file(spark, d):
    """The manifest of a run: an entry for each file and each fact, as one object, read again."""
    at = scratch.folder(spark, "manifest") + ".json"
    facts = {"commit": "none", "orders": str(table(spark, d, "orders").count())}
    files.json_object(sinks.manifest(spark, _parts(spark, d), **facts), at, "name", "value")
    return files.object_entries(spark, at).select(F.regexp_replace("key", "/part-[^/]*$", "").alias("name"), "value")


# ---- versions -----------------------------------------------------------------------------------------------------------


def _three_rounds(spark: SparkSession, d: str) -> tuple[Versions, list[DataFrame], bool]:
    """Orders as records: the first half, then all from another device, then every
    third with another mean; a writer that read the first version comes too late."""
    v = Versions(spark, scratch.folder(spark, "bank"), ["seed", "arm"])
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seed"), F.lit("adapted").alias("arm"), F.expr("if(o_orderkey % 9 = 0, 'oom', null)").alias("error"), F.lit("gpu").alias("device"), F.lit("fp32").alias("dtype"), (F.col("o_orderkey") % 10 / 10.0).alias("mean"))
    rounds = [v.bank(o.where("seed % 2 = 0"))]
    late = v.current()
    more = o.withColumn("error", F.lit(None).cast("string")).withColumn("device", F.expr("if(seed % 4 = 0, 'cpu', 'gpu')"))
    rounds.append(v.bank(more))
    rounds.append(v.bank(more.withColumn("mean", F.expr("if(seed % 3 = 0, mean + 1, mean)"))))
    try:
        v.bank(more.where("seed % 5 = 0"), based_on=late)
        refused = False
    except Refused:
        refused = True
    return v, [r.actions for r in rounds], refused


RECORDS = """with a as (select o_orderkey as seed, o_orderkey % 2 = 0 as early, o_orderkey % 9 = 0 as failed, case when o_orderkey % 4 = 0 then 'cpu' else 'gpu' end as device, (o_orderkey % 10 / 10.0)::double as mean from orders),
b as (select *, case when not early then 'add' when failed then 'supersede error' when device = 'cpu' then 'supersede environment' else 'skip' end as second, case when seed % 3 = 0 then 'conflict' else 'skip' end as third from a)"""


@query(RECORDS + " select 1 as version, seed, case when failed then 'oom' end as error, 'gpu' as device, round(mean, 6) as mean, second like 'supersede%' as superseded from b where early union all select 2, seed, case when second = 'skip' and failed then 'oom' end, device, round(mean, 6), false from b")
def banked_versions(spark, d):
    """The records of both versions; those that the second replaced are still in the first."""
    v, _, _ = _three_rounds(spark, d)
    gone = v.superseded(2).select("seed", F.lit(True).alias("gone"))
    first = v.read(1).join(gone, "seed", "left").select(F.lit(1).alias("version"), "seed", "error", "device", F.round("mean", 6).alias("mean"), F.coalesce("gone", F.lit(False)).alias("superseded"))
    return first.unionByName(v.read().select(F.lit(2).alias("version"), "seed", "error", "device", F.round("mean", 6).alias("mean"), F.lit(False).alias("superseded")))


@query(RECORDS + " select 1 as round, 'add' as action, count(*) as n, true as late_writer_refused from b where early union all select 2, second, count(*), true from b group by second union all select 3, third, count(*), true from b group by third")
def banking_rounds(spark, d):
    """What became of the records of three rounds, and of the writer that came late."""
    _, rounds, refused = _three_rounds(spark, d)
    out = None
    for i, actions in enumerate(rounds, 1):
        one = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("round"), "action", "n", F.lit(refused).alias("late_writer_refused"))
        out = one if out is None else out.union(one)
    return out


# ---- audits -------------------------------------------------------------------------------------------------------------


def _tier_deltas(spark: SparkSession, d: str) -> DataFrame:
    x = wide_scores(spark, d).select("tier", "tenant", F.col("tuned.f1").alias("treated"), F.col("base.f1").alias("control"))
    return x.where("treated is not null and control is not null").withColumn("delta", F.col("treated") - F.col("control"))


#: Each tier's summary from its rows; the quantile of t by three terms, the tail by logarithms.
TIERS = PAIRED + """, r as (select tier, count(*) as n, avg(delta) as mean, stddev_samp(delta) / sqrt(count(*)) as se, count(*) filter (where delta > 1e-12) as wins, count(*) filter (where delta < -1e-12) as losses from p group by tier),
s as (select tier, tenant, avg(delta) as delta, avg(control) as control from p group by tier, tenant),
c as (select tier, count(*) as pairs, avg(delta) as mean, count(*) filter (where control < 0.15 or control > 0.95) as trips from s group by tier),
q as (select *, 1.959963984540054::double as z, n - 1 as df from r),
t as (select *, mean - (z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * pow(df, 2)) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(df, 3))) * se as low from q),
w as (select t.*, pairs, c.mean as c_mean, case when trips = 0 and c.mean >= 0.05 and low > 0 and wins > losses then 'GO' else 'NOT GO' end as verdict from t join c using (tier))"""


@query(TIERS + """ select tier, 'gate.receipt_level.n' as path, 'differs' as reason, (n + 1)::double::varchar as published, n::double::varchar as recomputed from w where tier like '1%'
union all select tier, 'gate.receipt_level.ci95[0]', 'differs', round(low + 0.01, 4)::varchar, round(low, 4)::varchar from w where tier like '2%'
union all select tier, 'gate.receipt_level.sign_test.p', 'differs', '0.5', '0.0' from w where tier like '3%'
union all select tier, 'verdict', 'differs', case verdict when 'GO' then 'NOT GO' else 'GO' end, verdict from w where tier like '5%'
union all select tier, 'gate.pairs_complete', 'not published', null, pairs::double::varchar from w where tier like '5%'""")
def summary_audit(spark, d):
    """Published summaries with a fault each: a count, an end of an interval, a p
    value, a verdict and a number that is missing; tier 4's mean is off by 3e-4, which passes."""
    right = audits.gate_summary(_tier_deltas(spark, d), ["tier"], "tenant")
    right.write.parquet(at := scratch.folder(spark, "summaries"))
    right = spark.read.parquet(at)
    i, was = F.substring("tier", 1, 1), F.col("json")
    number = lambda path: F.get_json_object(was, path).cast("double")
    put = lambda name, x: F.regexp_replace(was, F.lit(rf'("{name}":\[?)[-0-9.Ee]+'), F.concat(F.lit("$1"), x.cast("string")))
    spoiled = (
        F.when(i == "1", put("n", (number("$.gate.receipt_level.n") + 1).cast("long")))
        .when(i == "2", F.replace(was, number("$.gate.receipt_level.ci95[0]").cast("string"), (number("$.gate.receipt_level.ci95[0]") + 0.01).cast("string")))
        .when(i == "3", put("p", F.lit("0.5")))
        .when(i == "4", put("mean_delta", number("$.gate.mean_delta") + 0.0003))
        .otherwise(F.regexp_replace(F.when(was.contains('"NOT GO"'), F.replace(was, F.lit('"NOT GO"'), F.lit('"GO"'))).otherwise(F.replace(was, F.lit('"GO"'), F.lit('"NOT GO"'))), F.lit('"pairs_complete":[0-9]+,'), F.lit("")))
    )
    rounded = lambda c: F.coalesce(F.round(F.col(c).try_cast("double"), 4).cast("string"), c).alias(c)
    return audits.audit(right.withColumn("json", spoiled), right, ["tier"]).select("tier", "path", "reason", rounded("published"), rounded("recomputed"))


CLAIMED = "t as (select doc_id, text || chr(10) || 'It has ' || doc_id % 50 || chr(10) || '  offline tests.' || chr(10) || 'Test suite: ' || (doc_id % 3 + 188) || chr(10) || ' green, ' || doc_id % 7 || '-test' || chr(10) || 'suite, 190 tests' || chr(10) || 'green' as text from documents)"


def _matches(place: int, pattern: str) -> str:
    """SQL: the gaps before a pattern's matches, and the matches."""
    return f"select doc_id, {place} as pattern, unnest(string_split_regex(text, '{pattern}')[:-2]) as gap, unnest(regexp_extract_all(text, '{pattern}', 0)) as whole, unnest(regexp_extract_all(text, '{pattern}', 1)) as claimed, unnest(range(len(regexp_extract_all(text, '{pattern}', 0)))) as i from t"


@query("with " + CLAIMED + ", m as (" + " union all ".join(_matches(i, p) for i, p in enumerate(audits.CLAIMS)) + "), n as (select *, length(gap) - length(replace(gap, chr(10), '')) as g, length(whole) - length(replace(whole, chr(10), '')) as w from m), l as (select *, 1 + sum(g) over o + coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0) as line from n window o as (partition by doc_id, pattern order by i)) select doc_id, pattern::int as pattern, line::int as line, claimed from l where claimed::bigint <> 190")
def stale_claims(spark, d):
    """Claims of five kinds added to every document, some across line ends: those that aren't 190."""
    x = F.col("doc_id")
    more = F.concat(F.lit("\nIt has "), x % 50, F.lit("\n  offline tests.\nTest suite: "), x % 3 + 188, F.lit("\n green, "), x % 7, F.lit("-test\nsuite, 190 tests\ngreen"))
    return audits.stale_claims(table(spark, d, "documents").select("doc_id", F.concat("text", more).alias("text")), 190)


@query("with " + CLAIMED + " select doc_id, sha256(replace(replace(replace(text, 'It has ' || doc_id % 50 || chr(10), 'It has 190' || chr(10)), 'suite: ' || (doc_id % 3 + 188) || chr(10), 'suite: 190' || chr(10)), 'green, ' || doc_id % 7 || '-test', 'green, 190-test')) as text_sha256 from t")
def corrected_claims(spark, d):
    """The same documents with the right number in place of each that is claimed."""
    x = F.col("doc_id")
    more = F.concat(F.lit("\nIt has "), x % 50, F.lit("\n  offline tests.\nTest suite: "), x % 3 + 188, F.lit("\n green, "), x % 7, F.lit("-test\nsuite, 190 tests\ngreen"))
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", more).alias("text"))
    return audits.corrected(docs, 190).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


# ---- endless streams ----------------------------------------------------------------------------------------------------


@query("with c as (select conv_id, row_number() over (order by conv_id) - 1 as task from (select distinct conv_id from conversations)), e as (select unnest(range(0, 3)) as epoch) select epoch::int as epoch, conv_id, ((task + epoch) % 8)::int as augmentation from c, e")
def streamed_epochs(spark, d):
    """Three epochs of conversations from the endless stream, which stops twice on
    the way, once within an epoch; the order within an epoch is tested."""
    at = scratch.folder(spark, "epochs")
    tasks = ranks.places(table(spark, d, "conversations").select("conv_id").distinct(), ["conv_id"], into="task")
    tasks.write.parquet(f"{at}/tasks")
    numbered = spark.read.parquet(f"{at}/tasks")
    n = numbered.count()
    for until in (n + n // 2, 2 * n, 3 * n):
        rows = epochs.examples(epochs.epochs(spark, n, 1, until=until), numbered)
        rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows").select("epoch", "conv_id", "augmentation")
