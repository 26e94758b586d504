"""Queries: votes, corpora, splits, resumption, counts over documents, conversations, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import candidate_key, is_number, normal_leaf
from ..operators import corpora, merges, ranks, splits, votes
from ..tables import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def completions(spark: SparkSession, d: str) -> DataFrame:
    """Five completions per order: id, ordinal, text, lp. Equal answers come in two
    formattings; every seventh order also has one that isn't JSON."""
    o = spread(table(spark, d, "orders"), "o_orderkey").selectExpr("o_orderkey as id", "explode(sequence(0, 4)) as ordinal")
    o = o.withColumn("answer", F.expr("(id * 3 + ordinal * ordinal) % 3"))
    text = F.when(F.expr("id % 7 = 0 and ordinal = 4"), F.lit("no json")).when(F.expr("ordinal % 2 = 0"), F.format_string('{"a": %d, "b": 1}', "answer")).otherwise(F.format_string('{"b":1,"a":%d}', "answer"))
    return o.withColumn("text", text).withColumn("lp", F.expr("-cast((id * 7 + ordinal * 11) % 50 as double) / 8"))


VOTES = "c as (select o_orderkey as id, j::int as ordinal, case when o_orderkey % 7 = 0 and j = 4 then 'no json' else '{\"a\":' || ((o_orderkey * 3 + j * j) % 3) || ',\"b\":1}' end as key, -((o_orderkey * 7 + j * 11) % 50)::double / 8 as lp from orders, range(0, 5) r(j)), v as (select id, key, count(*) as found_count, avg(lp) as mean_lp, min(ordinal) as first from c group by id, key)"


def _pool(spark, d):
    rows = completions(spark, d)
    keyed = rows.withColumn("key", candidate_key("text"))
    return votes.pool(keyed, ["id"], "key")


@query("with " + VOTES + " select id, key, found_count, round(mean_lp, 6) as mean_lp, first from v")
def vote_pool_text(spark, d):
    return _pool(spark, d).select("id", "key", "found_count", F.round("mean_lp", 6).alias("mean_lp"), "first")


@query("with " + VOTES + ", r as (select *, row_number() over (partition by id order by found_count + exp(mean_lp) desc, first) as i from v) select id, key from r where i = 1")
def vote_top1(spark, d):
    return votes.ranked_by_sum(_pool(spark, d), ["id"]).select("id", "key")


@query("with " + VOTES + ", r as (select *, row_number() over (partition by id order by found_count desc, mean_lp desc, first) as i from v) select id, key, i::int as attempt from r where i <= 2")
def vote_top2_lex(spark, d):
    return votes.ranked_by_count_then_lp(_pool(spark, d), ["id"]).select("id", "key", "attempt")


@query("with " + VOTES + ", r as (select id, key, row_number() over (partition by id order by found_count desc, mean_lp desc, first) as i from v), t as (select id, max(key) filter (where i = 1) as a, max(key) filter (where i = 2) as b from r group by id) select id, a as attempt_1, coalesce(b, a) as attempt_2 from t")
def two_attempts(spark, d):
    r = votes.ranked_by_count_then_lp(_pool(spark, d), ["id"])
    t = r.groupBy("id").agg(F.max(F.when(F.col("attempt") == 1, F.col("key"))).alias("attempt_1"), F.max(F.when(F.col("attempt") == 2, F.col("key"))).alias("b"))
    return t.select("id", "attempt_1", F.coalesce("b", "attempt_1").alias("attempt_2"))


@query("select source, sha256(text) as text_sha256, min(doc_id) as first from documents group by all")
def first_seen_distinct(spark, d):
    docs = table(spark, d, "documents").withColumn("text_sha256", F.sha2("text", 256))
    return votes.first_seen(docs, ["source"], "text_sha256", "doc_id")


@query("select conv_id, sha256(string_agg('<|' || role || '|>' || text, '' order by turn)) as chat_sha256 from conversations group by conv_id")
def chat_raw(spark, d):
    return corpora.chat_raw(table(spark, d, "conversations")).select("conv_id", F.sha2("chat", 256).alias("chat_sha256"))


@query("with t as (select conv_id, turn, case role when 'system' then 'user' else role end as role, text from conversations), m as (select *, coalesce((lag(role) over (partition by conv_id order by turn) <> role)::int, 1) as n from t), i as (select *, sum(n) over (partition by conv_id order by turn) - 1 as g from m) select conv_id, g::bigint as turn, role, sha256(string_agg(text, chr(10) order by turn)) as text_sha256 from i group by conv_id, g, role")
def chat_merge_roles(spark, d):
    turns = table(spark, d, "conversations").withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    return corpora.merge_roles(turns).select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


EX = "with n as (select *, lead(role) over o as r2, lead(text) over o as t2 from conversations window o as (partition by conv_id order by turn)), x as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as i, text as input, t2 as output from n where role = 'user' and r2 = 'assistant')"


@query(EX + " select a.conv_id, a.i as held, count(b.i) as context, sum(length(b.input) + length(b.output))::bigint as context_chars from x a join x b on a.conv_id = b.conv_id and a.i <> b.i group by a.conv_id, a.i")
def loo_context(spark, d):
    """What all but the held pair hold is the task's total less its own: no pair of pairs is made."""
    x = corpora.exchanges(table(spark, d, "conversations")).withColumn("chars", F.length("input") + F.length("output"))
    totals = x.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("all_chars"))
    return x.join(totals, "conv_id").where("n > 1").select("conv_id", F.col("index").alias("held"), (F.col("n") - 1).alias("context"), (F.col("all_chars") - F.col("chars")).cast("long").alias("context_chars"))


@query(EX + ", d as (select a.conv_id, a.i as held, row_number() over (partition by a.conv_id, a.i order by b.i) - 1 as n, b.input, b.output from x a join x b on a.conv_id = b.conv_id and a.i <> b.i), t as (select conv_id, held, 2 * n as turn, 'user' as role, input as text from d union all select conv_id, held, 2 * n + 1, 'assistant', output from d union all select conv_id, i, 2 * ((count(*) over (partition by conv_id)) - 1), 'user', input from x) select conv_id, held, turn::int as turn, role, sha256(text) as text_sha256 from t")
def demo_query_turns(spark, d):
    turns = corpora.demonstration_turns(corpora.exchanges(table(spark, d, "conversations")))
    return turns.select("conv_id", "held", F.col("turn").cast("int").alias("turn"), "role", F.sha2("text", 256).alias("text_sha256"))


@query(EX + " select conv_id, i as index, 0 as turn, 'user' as role, length(input)::int as chars from x union all select conv_id, i, 1, 'assistant', length(output)::int from x")
def doconly_pairs(spark, d):
    return corpora.document_pairs(corpora.exchanges(table(spark, d, "conversations"))).select("conv_id", "index", "turn", "role", F.length("text").alias("chars"))


@query(EX + ", s as (select conv_id, count(*) as n, sum(length(input)) as docs, sum(length(input) + length(output)) as whole from x group by conv_id) select conv_id, round((docs + (n - 1) * whole)::double / docs, 6) as ratio from s where docs > 0")
def payload_ratio(spark, d):
    """Characters sent with all other pairs as examples, over those of the documents alone."""
    s = corpora.exchanges(table(spark, d, "conversations")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("input")).alias("docs"), F.sum(F.length("input") + F.length("output")).alias("whole"))
    return s.where("docs > 0").select("conv_id", F.round((F.col("docs") + (F.col("n") - 1) * F.col("whole")) / F.col("docs"), 6).alias("ratio"))


@query("select source, max(n_chars) as longest, count(*) filter (where n_chars > 7900) as dropped, max(n_chars) <= 7900 as eligible from documents group by source")
def length_screen(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") > 7900).alias("dropped"), (F.max("n_chars") <= 7900).alias("eligible"))


@query("with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string(list_filter(string_split(x, ' '), lambda w: w <> ''), ' ')), lambda y: y <> '') as ls from documents) select doc_id, len(ls)::int as lines, sha256(array_to_string(ls, chr(10))) as text_sha256 from l")
def label_value_lines(spark, d):
    """Documents as lists of words per line, joined as OCR groups are."""
    words = F.transform(F.split("text", "\n"), lambda x: F.struct(F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct(w.alias("text"))).alias("words")))
    joined = corpora.ocr_lines(table(spark, d, "documents").select("doc_id", words.alias("valid_line")))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return joined.select("doc_id", lines.alias("lines"), F.sha2("text", 256).alias("text_sha256"))


@query("select l_orderkey as k, l_linenumber as n, floor(l_extendedprice)::bigint::varchar as plain, floor(l_extendedprice)::bigint::varchar as grouped, true as numeric from lineitem group by all")
def numeric_token_norm(spark, d):
    """A price as 12345.0 and as 12,345 has one normal form."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.floor("l_extendedprice").cast("long").alias("v")).distinct()
    grouped = F.format_number("v", 0)
    return rows.select("k", "n", normal_leaf(F.concat(F.col("v").cast("string"), F.lit(".0"))).alias("plain"), normal_leaf(F.concat(F.lit("  "), grouped)).alias("grouped"), is_number(grouped).alias("numeric"))


@query("with h as (select doc_id, row_number() over (order by sha256('split:' || doc_id), doc_id) as r from documents) select doc_id, case when r <= 100 then 'train' else 'holdout' end as split from h")
def hash_split(spark, d):
    return splits.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("with h as (select doc_id, text, row_number() over (order by sha256('split:' || doc_id), doc_id) <= 100 as train from documents) select count(*) as shared from h a where train and exists (select 1 from h b where not b.train and b.text = a.text)")
def split_disjoint(spark, d):
    """Training documents whose text is in the holdout too (a clean split has none)."""
    s = splits.hash_split(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 100)
    s = s.withColumn("h", F.xxhash64("text"))
    train = s.where("split = 'train'")  # 100 rows: their hashes find the few texts that are compared
    alike = s.where("split = 'holdout'").join(F.broadcast(train.select("h").distinct()), "h", "left_semi").select("h", "text")
    return train.join(alike, ["h", "text"], "left_semi").agg(F.count(F.lit(1)).alias("shared"))


@query("with d as (select distinct user_id, event_type from events where event_id % 3 = 0) select event_id from events e where not exists (select 1 from d where d.user_id = e.user_id and d.event_type = e.event_type)")
def resume_anti(spark, d):
    plan = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return splits.remaining(plan, plan.where("event_id % 3 = 0"), ["user_id", "event_type"]).select("event_id")


@query("select user_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def journal_latest(spark, d):
    return splits.latest(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("with t as (select event_type as mode, count(*) as docs, sum(((event_id * 37) % 1000) + 1)::bigint as millis from events group by 1) select mode, docs, round(millis / 1000.0 / docs, 6) as mean_seconds, round(3600.0 * docs / (millis / 1000.0), 6) as docs_per_hour from t")
def throughput(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.expr("(event_id * 37) % 1000 + 1")).alias("millis"))
    s = F.col("millis") / 1000.0
    return t.select("mode", "docs", F.round(s / F.col("docs"), 6).alias("mean_seconds"), F.round(3600.0 * F.col("docs") / s, 6).alias("docs_per_hour"))


@query("select o_orderkey as k, case when o_orderkey % 3 = 0 and o_orderkey % 9 <> 0 then 'part ' || o_orderstatus else '[[0]]' end as output from orders")
def part_merge_fallback(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    parts = o.where("k % 3 = 0").select("k", F.when(F.expr("k % 9 <> 0"), F.concat(F.lit("part "), "o_orderstatus")).alias("output"))
    return votes.with_fallback(o.select("k", F.lit("[[0]]").alias("output")), parts, "k", "output")


@query("with r as (select source, n_chars, row_number() over (partition by source order by n_chars, doc_id) as i, count(*) over (partition by source) as n from documents) select source, n_chars as threshold from r where i = (3 * n) // 4 + 1")
def quartile_threshold(spark, d):
    """The element at floor(3n/4) of the sorted sizes."""
    h = splits.counts_before(table(spark, d, "documents"), "source", "n_chars")
    return h.where("before <= floor(3 * n / 4) and floor(3 * n / 4) < before + m").select("source", F.col("n_chars").alias("threshold"))


@query("select doc_id, ((row_number() over (order by n_chars, doc_id) - 1) % 4)::int as shard from documents")
def stride_shards(spark, d):
    return splits.shards(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 4).select("doc_id", "shard")


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) + 1 as n from documents), c as (select doc_id, n, unnest(regexp_extract_all(line, '([0-9]{1,6}) ', 1)) as x from l) select doc_id, n::int as line, x as claimed from c where x::bigint <> 190")
def claimed_count_drift(spark, d):
    return merges.claimed_counts(table(spark, d, "documents"), "([0-9]{1,6}) ", 190)


@query("with s as (select event_type, sum(value) over (partition by event_type order by event_id rows unbounded preceding) as total, event_id from events) select event_id, event_type, round(total, 4) as running from s")
def running_totals(spark, d):
    sums = splits.binned_running_sums(table(spark, d, "events"), "event_type", "event_id", "value", 1 << 16, "running")
    return sums.select("event_id", "event_type", F.round("running", 4).alias("running"))


@query("select k, n_nationkey::int as seed, arm, row_number() over (order by case k when 30 then 0 else 1 end, n_nationkey, arm) - 1 as place from (select unnest([10, 30]) as k), nation, (select unnest(['adapted', 'kshot']) as arm)")
def arm_plan(spark, d):
    """Every k, seed (a nation) and arm, the deciding k first."""
    plan = splits.arm_plan(table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("seed")), [10, 30], ["adapted", "kshot"])
    return ranks.places(plan.withColumn("first", F.when(F.col("k") == 30, 0).otherwise(1)), ["first", "seed", "arm"]).drop("first")


@query("with a as (select doc_id, text from documents where doc_id % 2 = 0), b as (select doc_id, text from documents where doc_id % 3 = 0) select doc_id, 'left' as side from a where doc_id not in (select doc_id from b) union all select doc_id, 'right' from b where doc_id not in (select doc_id from a)")
def key_set_difference(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return merges.same_keys(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), ["doc_id"])
