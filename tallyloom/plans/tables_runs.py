"""Queries: what readers, sinks, banking, generators, verdict rules and predictors do, each with SQL that computes it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import grids
from ..operators import corpora, generate, merges, pairing, predictor, scoring, search, splits, verdicts, votes
from ..sources import files, readers, sinks
from ..streaming import journal
from ..tables import table
from . import arms
from .scores import W, all_scores, wide_scores
from .tables_grid import LOGITS, SWEEP, _steps, vectors
from .tables_text import EX

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- written and read again -------------------------------------------------------------------------------------


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Text tasks from conversations: all exchanges but the last train, the last is the test; some are spoiled."""
    x = corpora.exchanges(table(spark, d, "conversations"))
    pair = F.struct("index", "input", F.when(F.col("conv_id") % 7 != 0, F.col("output")).otherwise(F.lit(" ")).alias("output"))
    t = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    plain = lambda a: F.transform(a, lambda s: F.struct(s["input"].alias("input"), s["output"].alias("output")))
    name = F.when(F.col("conv_id") % 10 == 3, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("conv_id").cast("string")))
    return t.select("conv_id", name.alias("task_id"), plain(F.slice("p", F.lit(1), F.size("p") - 1)).alias("train"), plain(F.slice("p", -1, 1)).alias("test"))


TASKS = EX + ", p as (select conv_id, i, input, case when conv_id % 7 <> 0 then output else ' ' end as output, max(i) over (partition by conv_id) as last from x), t as (select conv_id, max(last) as last, count(*) filter (where i < last and trim(output) = '') > 0 as bad_train, count(*) filter (where i = last and trim(output) = '') > 0 as bad_test, count(*) filter (where trim(input) = '' and i < last) > 0 as bad_in, count(*) filter (where trim(input) = '' and i = last) > 0 as bad_test_in from p group by conv_id), d as (select conv_id, case when conv_id % 10 = 3 then 'same' else 't' || conv_id end as task_id, * exclude (conv_id) from t), twice as (select task_id from d group by task_id having count(*) > 1)"


@query(TASKS + ", e as (select unnest(list_filter([case when last = 0 then 'no train pairs' end, case when bad_in then 'bad train input' end, case when bad_train then 'bad train output' end, case when bad_test_in then 'bad test input' end, case when bad_test then 'bad test output' end, case when task_id in (select task_id from twice) then 'duplicate id' end], lambda x: x is not null)) as reason from d) select reason, count(*) as tasks from e group by reason")
def text_task_errors(spark, d):
    """Tasks written as JSON lines with blank ones between and read again: reasons against each."""
    at = scratch.folder(spark, "tasks")
    lines = _tasks(spark, d).select(F.explode(F.array(F.to_json(F.struct("task_id", "train", "test")), F.lit("  "))).alias("value"))
    lines.write.text(at)
    return readers.text_task_lines(spark, at).select(F.explode("_errors").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("tasks"))


@query("select p_partkey as part, (row_number() over (order by p_partkey) + coalesce(sum((p_partkey % 5 = 0)::int) over (order by p_partkey rows between unbounded preceding and 1 preceding), 0))::int as line_no from part")
def numbered_lines(spark, d):
    """Parts in one file, a blank line after every fifth: lines keep their numbers, blank ones count."""
    at = scratch.folder(spark, "lines")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.explode(F.when(F.col("p_partkey") % 5 == 0, F.array(F.col("p_partkey").cast("string"), F.lit(" "))).otherwise(F.array(F.col("p_partkey").cast("string")))).alias("value"))
    p.coalesce(1).sortWithinPartitions("part", F.desc("value")).select("value").write.text(at)
    return readers.numbered_lines(spark, at).select(F.col("text").cast("long").alias("part"), "line_no")


@query(W + " select k, tenant, case when missing then 0 else 5 - spoiled end as fifths from facts where arm = 'base'")
def labelled_and_predictions(spark, d):
    """Labelled rows and predictions written as JSON lines, read by their readers and scored by id; a missing one scores 0."""
    g = arms.wide(spark, d).withColumn("id", F.col("k").cast("string"))
    at = scratch.folder(spark, "labelled")
    sinks.json_lines(g.select("id", F.lit("text").alias("text"), "gold"), f"{at}/gold")
    sinks.json_lines(g.where("base_text is not null").select("id", F.regexp_replace("base_text", " trailing$", "").alias("prediction")), f"{at}/predictions")
    gold = readers.strict(readers.labelled(spark, f"{at}/gold"), "gold").select("id", "gold")
    found = scoring.protocol(gold, readers.predictions(spark, f"{at}/predictions"), "id").select("id", F.round(F.col("micro_f1") * 5).cast("int").alias("fifths"))
    return g.select("id", "k", "tenant").join(found, "id").select("k", "tenant", "fifths")


ARM_FILES = "a as (select n_nationkey as seed, n_regionkey % 2 as arm_no, case when n_nationkey % 6 = 5 then 'out of memory' end as error, case when n_nationkey % 4 <> 0 then 'cpu' end as device, n_regionkey as r from nation)"


def _arm_files(spark: SparkSession, d: str) -> str:
    """A run record per nation; nation 0 has none of the identity fields."""
    n = table(spark, d, "nation").selectExpr("n_nationkey as seed", "if(n_regionkey % 2 = 0, 'adapted', 'kshot') as arm", "n_regionkey as r", "if(n_nationkey % 6 = 5, 'out of memory', null) as error", "if(n_nationkey % 4 <> 0, 'cpu', null) as device")
    results = F.transform(F.sequence(F.lit(0), F.col("r").cast("int")), lambda i: F.struct(i.alias("index"), F.when(i % 2 == 0, (F.col("seed") + i) / 100.0).alias("micro_f1")))
    body = F.to_json(F.struct(F.when(F.col("seed") != 0, "0.5b").alias("rung"), F.lit(30).alias("k"), "seed", "arm", "device", F.lit("fp32").alias("dtype"), "error", results.alias("results")))
    at = scratch.folder(spark, "arms")
    n.select(body.alias("value"), F.format_string("run_%02d", "seed").alias("name")).repartition("name").write.partitionBy("name").text(at)
    return at


@query("with " + ARM_FILES + " select seed::int as seed, case arm_no when 0 then 'adapted' else 'kshot' end as arm, error, case when device is null then 'local' else 'kernel' end as env, (r // 2 + 1)::int as scored from a where seed <> 0")
def arm_records(spark, d):
    """Run records read from a file each: identity decides what is an arm, errors are kept, the environment comes from the device."""
    found, _ = readers.arms(spark, _arm_files(spark, d) + "/*", "*.txt")
    return found.select("seed", "arm", "error", "env", F.size(F.filter("results", lambda x: x["micro_f1"].isNotNull())).alias("scored"))


@query("with " + ARM_FILES + ", s as (select seed, unnest(range(0, r + 1)) as index from a where seed <> 0 and device = 'cpu') select seed::int as seed, index::int as index, round((seed + index) / 100.0, 6) as micro_f1 from s where index % 2 = 0")
def arm_scores(spark, d):
    """index and score of every scored result of the arms whose device is asserted."""
    found, _ = readers.arms(spark, _arm_files(spark, d) + "/*", "*.txt")
    cpu = found.where("device = 'cpu'")
    return cpu.select("seed", F.inline("results")).where("micro_f1 is not null").select("seed", "index", F.round("micro_f1", 6).alias("micro_f1"))


@query("with " + ARM_FILES + " select seed::int as seed, case arm_no when 0 then 'adapted' else 'kshot' end as arm, (r + 1)::int as results from a")
def arms_of_three_keys(spark, d):
    """The same records under an identity of three fields: that of nation 0, which has no rung, is an arm too."""
    found, _ = readers.arms(spark, _arm_files(spark, d) + "/*", "*.txt", ("k", "seed", "arm"))
    return found.select("seed", "arm", F.size("results").alias("results"))


@query("with " + ARM_FILES + ", s as (select unnest(range(0, r + 1)) as index from a where seed = 7) select index::int as index, round((7 + index) / 100.0, 6) as micro_f1 from s where index % 2 = 0")
def one_arm_scores(spark, d):
    """One arm's file, its environment asserted: scores by index."""
    arm = readers.one_arm(spark, _arm_files(spark, d) + "/name=run_07/*.txt", device="cpu", dtype="fp32", k=30)
    return readers.scores_by_index(arm, device="cpu").select("index", F.round("micro_f1", 6).alias("micro_f1"))


@query("select n_nationkey as part, sha256('{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"note\":null}' || chr(10)) as sha256 from nation")
def file_digests(spark, d):
    """JSON lines (null fields written), a file each, and their digests as a manifest holds them."""
    at = scratch.folder(spark, "files")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("part"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("note"))
    n.repartition("part").write.partitionBy("part").json(at, ignoreNullFields=False)
    files = sinks.file_hashes(spark, at).where("file like '%.json'")
    return files.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part"), "sha256")


@query("select k::int as k, seed::int as seed, count(*) as n from (select user_id % 3 as k, user_id % 5 as seed, event_type from events) group by all")
def streamed_journal(spark, d):
    """Events keyed by (k, seed, type) through the file stream into the journal,
    three times: again without new files, and with the same rows in other files. Each key is there once."""
    at = scratch.folder(spark, "journal")
    rows = table(spark, d, "events").selectExpr("cast(user_id % 3 as int) as k", "cast(user_id % 5 as int) as seed", "event_type", "event_id")
    rows.write.json(f"{at}/in")
    for again in (False, False, True):
        if again:
            rows.write.mode("append").json(f"{at}/in")
        journal.follow(spark, f"{at}/in", "k int, seed int, event_type string, event_id long", f"{at}/out", f"{at}/checkpoint", ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("k", "seed").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey as k, o_orderstatus || ' ' || o_orderpriority || chr(10) || o_orderkey as text, '{\"menu\":[{\"nm\":\"' || o_orderpriority || '\"}],\"total\":{\"k\":' || o_orderkey || '}}' as gold, case when o_orderkey % 5 = 0 then 'no allowed label' end as error from orders where o_orderkey % 5 <> 0 union all select o_orderkey, o_orderstatus || ' ' || o_orderpriority || chr(10) || o_orderkey, '{}', 'no allowed label' from orders where o_orderkey % 5 = 0")
def receipt_rows(spark, d):
    """Receipts: words as lines, blank ones dropped, labels of the kept classes as JSON with sorted keys."""
    o = table(spark, d, "orders")
    words = lambda *w: F.struct(F.array(*[F.struct(x.cast("string").alias("text")) for x in w]).alias("words"))
    label = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("k")).alias("total"), F.lit(1).alias("other"), F.array(F.struct(F.col("o_orderpriority").alias("nm"))).alias("menu")))
    rows = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 != 0, label).otherwise('{"other":1}').alias("gt_parse"), F.array(words(F.col("o_orderstatus"), F.col("o_orderpriority")), words(F.lit(" ")), words(F.col("o_orderkey"))).alias("valid_line"))
    return readers.receipts(rows).select("k", "text", "gold", F.get("_errors", F.lit(0)).alias("error"))


@query("select 'n' || n_nationkey as task_id, n_regionkey::int as answer from nation where n_nationkey % 2 = 0")
def answered_tasks(spark, d):
    """A map of grid tasks joined with the solutions of half of them."""
    at = scratch.folder(spark, "map")
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), "n_nationkey", F.col("n_regionkey").cast("int").alias("r"))
    grid = F.array(F.array("r"))
    one = F.struct(F.array(F.struct(grid.alias("input"), grid.alias("output"))).alias("train"), F.array(F.struct(grid.alias("input"))).alias("test"))
    as_map = lambda df, value, to: df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", value.alias("v"))))).alias("value")).write.text(f"{at}/{to}")
    as_map(n, one, "tasks")
    as_map(n.where("n_nationkey % 2 = 0"), F.array(grid), "solutions")
    found = readers.task_map(spark, f"{at}/tasks", f"{at}/solutions")
    return readers.pairs(found).where("split = 'test'").select("task_id", F.col("output")[0][0].alias("answer"))


@query("select n_nationkey::int as seed, (n_nationkey + n_regionkey)::int as j, n_nationkey // 2 as place from nation where n_nationkey % 2 = 1")
def cells_in_order(spark, d):
    """The cells of one addendum in the order of (seed, j), their environment asserted."""
    at = scratch.folder(spark, "cells")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("seed"), (F.col("n_nationkey") + F.col("n_regionkey")).alias("j"))
    body = F.to_json(F.struct(F.when(F.col("seed") % 2 == 1, "G-b").otherwise("G").alias("addendum"), "seed", "j", F.lit("cpu").alias("device")))
    n.select(body.alias("value"), "seed").repartition("seed").write.partitionBy("seed").text(at)
    found = readers.cells(spark, at + "/*", "G-b", "*.txt", device="cpu")
    order = Window.partitionBy().orderBy("seed", "j")  # a handful of cells, a file each
    return found.select("seed", "j", (F.row_number().over(order) - 1).cast("long").alias("place"))


@query("select conv_id, count(*) as turns from conversations where conv_id % 3 <> 0 group by conv_id")
def swept_documents(spark, d):
    """Documents below a folder, but for those marked as superseded: turns of a conversation, as a document each line of which is a turn."""
    at = scratch.folder(spark, "sweep")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    head = F.when(F.col("conv_id") % 3 == 0, "SUPERSEDED by another").otherwise("in force")
    lines = c.select("conv_id", F.concat_ws("\n", F.concat(head, F.lit(" "), F.col("conv_id")), F.array_repeat(F.lit("turn"), F.col("n").cast("int"))).alias("value"))
    files.file_each(lines, at, "conv_id", "value")
    found = readers.sweep(spark, at)
    return found.select(F.regexp_extract("text", r"^in force (\d+)", 1).cast("long").alias("conv_id"), (F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n")) - 1).cast("long").alias("turns"))


@query(W + " select k, missing or broken as is_null, case when missing or broken then 0 else 5 end as leaves from facts where arm = 'base'")
def written_predictions(spark, d):
    """Completions written as predictions: an object in canonical form, or null."""
    at = scratch.folder(spark, "predictions")
    sinks.predictions(arms.wide(spark, d).select(F.col("k").alias("id"), F.col("base_text").alias("completion")), at)
    p = readers.predictions(spark, at)
    return p.select(F.col("id").cast("long").alias("k"), F.col("prediction").isNull().alias("is_null"), F.coalesce(F.size(F.map_keys(F.from_json("prediction", "map<string,string>"))), F.lit(0)).alias("leaves"))


@query("select conv_id, i as index, length(input)::int as chars from (" + EX + " select * from x) where i < 2")
def export_limit(spark, d):
    """The first two exchanges of each conversation: the limit is the feature."""
    x = corpora.exchanges(table(spark, d, "conversations"))
    return readers.first_per_task(x, "conv_id", "index", 2).select("conv_id", "index", F.length("input").alias("chars"))


@query("select doc_id, (row_number() over (order by doc_id::varchar))::int as place from documents order by doc_id::varchar limit 10")
def first_by_text_id(spark, d):
    """The first ten ids, sorted as texts."""
    first = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("s")).orderBy("s").limit(10)
    return first.select("doc_id", F.row_number().over(Window.partitionBy().orderBy("s")).alias("place"))  # of ten rows


@query("select o_orderkey as k, i::int as index, case i when 0 then o_orderstatus else o_orderpriority end as word, o_orderkey + i as number from orders, range(0, 2) r(i)")
def positional_zip(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array("o_orderstatus", "o_orderpriority").alias("word"), F.array(F.col("o_orderkey"), F.col("o_orderkey") + 1).alias("number"))
    return readers.positional(o, "word", "number")


@query(SWEEP + "select vec_id, case when vec_id % 3 <> 0 then sha256(string_agg(t, chr(10) order by nr)) end as digest from y where rotations = 1 and flip group by vec_id")
def augmented_outputs(spark, d):
    """A task's outputs turned and mirrored; a hidden output stays null."""
    g = F.when(F.col("vec_id") % 3 != 0, F.col("grid"))
    same = F.array(*map(F.lit, range(10)))
    return vectors(spark, d).select("vec_id", F.sha2(grids.text(grids.augmented(g, F.lit(1), F.lit(True), same)), 256).alias("digest"))


# ---- arms and banking -------------------------------------------------------------------------------------------


@query("with r as (select n_regionkey as rung, n_nationkey % 2 as seed, 'a' || n_nationkey % 3 as arm, 'f' || lpad(n_nationkey::varchar, 2, '0') as file from nation), p as (select a.file, min(b.file) as partner_file from r a join r b on a.rung = b.rung and a.seed = b.seed and a.arm <> b.arm group by a.file) select r.file, p.partner_file, b.arm as partner_arm from r left join p using (file) left join r b on b.file = p.partner_file")
def partner_lookup(spark, d):
    runs = table(spark, d, "nation").selectExpr("n_regionkey as rung", "n_nationkey % 2 as seed", "concat('a', n_nationkey % 3) as arm", "concat('f', lpad(n_nationkey, 2, '0')) as file")
    return pairing.partners(runs, ["rung", "seed"]).select("file", "partner_file", "partner_arm")


@query("select o_orderkey as k, case when o_orderkey % 11 = 0 then 'not an arm' when o_orderkey % 3 = 0 then 'local' when o_orderkey % 7 = 0 then 'error' when o_orderkey % 4 = 0 then 'here' else 'seed' end as action from orders")
def seed_resume(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey as k", "if(o_orderkey % 11 = 0, null, o_orderkey) as id", "if(o_orderkey % 3 = 0, null, 'cpu') as device", "if(o_orderkey % 7 = 0, 'failed', null) as error")
    return merges.seeded(o.where("k % 4 = 0").select("id"), o, ["id"]).select("k", "action")


@query("select o_orderkey as k from orders where o_orderkey % 3 = 1 and o_orderkey % 5 <> 2")
def purged_stage(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey as k", "case o_orderkey % 3 when 0 then 'gpu' when 1 then 'cpu' end as device", "if(o_orderkey % 5 = 2, null, 'fp32') as dtype")
    return merges.purged(o, "cpu", "fp32").select("k")


@query("select k, n_nationkey::int as seed, arm from (select unnest([10, 30]) as k), nation, (select unnest(['adapted', 'kshot']) as arm) where (k = 30 and seed = 1 and arm = 'adapted') or (k = 10 and seed = 3)")
def requested_arms(spark, d):
    """What a list names of the plan of every nation as a seed; 99 is no nation."""
    plan = splits.arm_plan(table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("seed")), [10, 30], ["adapted", "kshot"])
    return merges.requested(plan, "30:1:adapted, 10:3:kshot,10:3:adapted,10:99:kshot")


@query("select o_orderkey as k, case when o_orderkey % 4 = 0 and o_orderkey % 5 <> 0 then 'conflict' when o_orderkey % 4 = 0 then 'skip' when o_orderkey % 5 = 0 then 'supersede environment' else 'skip' end as action from orders where not (o_orderkey % 4 = 0 and o_orderkey % 5 <> 0)")
def bank_without_conflicts(spark, d):
    """Conflicts apart, what banking would do; reading them would raise."""
    old = table(spark, d, "orders").selectExpr("o_orderkey as k", "cast(null as string) as error", "if(o_orderkey % 5 = 0 and o_orderkey % 4 <> 0, 'gpu', 'cpu') as device", "'fp32' as dtype", "0.5 as mean")
    new = old.withColumn("device", F.lit("cpu")).withColumn("mean", F.expr("if(k % 4 = 0 and k % 5 <> 0, 0.75, 0.5)"))
    actions = merges.bank(old, new, ["k"]).where("not (k % 4 = 0 and k % 5 <> 0)")
    return merges.refuse_conflicts(actions).select("k", "action")


@query(W + " select tenant, count(*) as pairs, string_agg(distinct case when k % 4 = 0 and tenant % 2 = 0 then 'local' else 'kernel' end, '+' order by case when k % 4 = 0 and tenant % 2 = 0 then 'local' else 'kernel' end) as pooled_across, count(distinct (k % 4 = 0 and tenant % 2 = 0)) = 1 as ci_is_authoritative from g group by tenant")
def mixed_pools(spark, d):
    g = arms.gold(spark, d).withColumn("env", F.expr("if(k % 4 = 0 and tenant % 2 = 0, 'local', 'kernel')"))
    return pairing.environments(g, ["tenant"]).withColumn("pooled_across", F.array_join("pooled_across", "+"))


@query("select o_orderkey as k, case when o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 then 'kernel/none' when o_orderkey % 2 <> 0 and o_orderkey % 3 = 0 then 'none/kernel' end as refused from orders")
def one_environment(spark, d):
    pairs = table(spark, d, "orders").selectExpr("o_orderkey as k", "if(o_orderkey % 2 = 0, 'kernel', null) as a", "if(o_orderkey % 3 = 0, 'kernel', null) as b")
    return pairing.one_environment(pairs, "a", "b").select("k", "refused")


@query("select o_orderkey as k, o_orderkey % 5 = 0 and o_orderkey % 2 = 0 as superseded, case when o_orderkey % 5 = 0 and o_orderkey % 2 = 0 then 'gpu' else 'cpu' end as device from orders where o_orderkey % 2 = 0 union all select o_orderkey, false, 'cpu' from orders where o_orderkey % 2 = 1 or o_orderkey % 10 = 0")
def banked_rows(spark, d):
    """After banking: what was superseded is kept aside, nothing is lost."""
    new = table(spark, d, "orders").selectExpr("o_orderkey as k", "cast(null as string) as error", "'cpu' as device", "'fp32' as dtype", "0.5 as mean")
    old = new.where("k % 2 = 0").withColumn("device", F.expr("if(k % 5 = 0, 'gpu', 'cpu')"))
    return merges.banked(old, new, ["k"]).select("k", "superseded", "device")


@query(W + ", s as (select b.k, b.f1 as base, t.f1 as tuned from scores b join scores t using (k) where b.arm = 'base' and t.arm = 'tuned') select k, round(base, 6) as base, round(tuned, 6) as tuned, round(1 - base, 6) as served, case when k % 4 = 0 then round(base, 6) end as extra from s where base is not null and k % 3 <> 0")
def three_arms(spark, d):
    """Three arms that must all have scored a row, and a fourth that may have."""
    x = wide_scores(spark, d).select("k", F.col("base.f1").alias("base"), F.col("tuned.f1").alias("tuned"))
    one = lambda arm, score: F.struct(F.lit(arm).alias("arm"), score.alias("micro_f1"))
    base = F.col("base")
    each = F.array(one("base", base), one("tuned", F.col("tuned")), F.when(F.col("k") % 3 != 0, one("served", 1 - base)), F.when(F.col("k") % 4 == 0, one("extra", base)))
    rows = x.select("k", F.inline(F.filter(each, lambda a: a.isNotNull())))  # a row is scored once for all arms
    return pairing.side_by_side(rows, ["k"], ["base", "tuned", "served"], ["extra"]).select("k", *[F.round(c, 6).alias(c) for c in ("base", "tuned", "served", "extra")])


@query(W + " select k from g where k % 3 = 1")
def unknown_ids(spark, d):
    """Predictions of ids that the gold doesn't have."""
    g = arms.gold(spark, d)
    return scoring.unknown_ids(g.where("k % 3 <> 1").select("k"), g.select("k"), "k")


# ---- roll-ups ---------------------------------------------------------------------------------------------------


@query(W + " select tenant, arm, count(f1) as n, round(avg(round(f1, 4)), 4) as mean_micro_f1, count(*) filter (where not broken and not missing) as valid_json from scores group by all")
def frontier_mean(spark, d):
    return scoring.rounded_rollup(all_scores(spark, d).where("micro_f1 is not null"), ["tenant", "arm"]).drop("exact_match")


@query(W + " select arm, sum(case when broken then 0 else 5 - spoiled end)::bigint as correct, 5 * count(*) as total, round(sum(case when broken then 0 else 5 - spoiled end) / (5.0 * count(*)), 9) as share from facts where not missing group by arm")
def fields_correct(spark, d):
    return scoring.fields_correct(arms.both(spark, d), ["arm"]).withColumn("share", F.round("share", 9))


@query("select role, count(*) as calls, sum(length(text))::bigint as input_tokens, sum(turn)::bigint as output_tokens from conversations group by role")
def token_usage(spark, d):
    c = table(spark, d, "conversations").withColumn("sent", F.length("text"))
    return scoring.token_usage(c, ["role"], "sent", "turn")


@query("select source, count(*) as sampled, round(avg(n_chars), 6) as mean_tokens, max(n_chars) as most_tokens from documents where doc_id % 7 = 0 group by source")
def sampled_tokens(spark, d):
    """Statistics of every seventh document: the sample is the feature."""
    return scoring.sampled_token_stats(table(spark, d, "documents"), ["source"], "doc_id", "n_chars").withColumn("mean_tokens", F.round("mean_tokens", 6))


@query("with b as (select l_orderkey as k, l_tax::double as x from lineitem where l_linenumber % 2 = 1), a as (select l_orderkey as k, l_discount::double as x from lineitem where l_linenumber % 2 = 0), s as (select k from b intersect select k from a) select (select count(*) from b where k in (select k from s) and x > 0) as n_before, (select round(avg(x), 9) from b where k in (select k from s) and x > 0) as mean_before, (select count(*) from a where k in (select k from s)) as n_after, (select round(avg(x), 9) from a where k in (select k from s)) as mean_after")
def both_measured(spark, d):
    """Odd lines of an order as before, even ones as after; a zero tax stands for a value that isn't finite."""
    li = table(spark, d, "lineitem")
    side = lambda odd, x: li.where(F.col("l_linenumber") % 2 == odd).groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(x).alias("lp"))
    tax = F.when(F.col("l_tax") > 0, F.col("l_tax").cast("double")).otherwise(float("-inf"))
    out = pairing.both_measured(side(1, tax), side(0, F.col("l_discount").cast("double")), ["k"], "lp")
    return out.select("n_before", F.round("mean_before", 9).alias("mean_before"), "n_after", F.round("mean_after", 9).alias("mean_after"))


@query("select c_custkey as k, case when c_custkey % 7 > c_custkey % 5 then round((c_nationkey + 1) / (c_custkey % 7 - c_custkey % 5)::double, 6) end as documents from customer")
def break_even(spark, d):
    c = table(spark, d, "customer")
    x = pairing.break_even(F.col("c_nationkey") + 1, F.col("c_custkey") % 7, F.col("c_custkey") % 5)
    return c.select(F.col("c_custkey").alias("k"), F.round(x, 6).alias("documents"))


@query(W + ", s as (select b.k, b.f1 as base, t.f1 as tuned, b.missing from scores b join scores t using (k) where b.arm = 'base' and t.arm = 'tuned') select case k % 4 when 0 then 'h-' when 1 then 'm-' when 2 then 'x-' else '' end || k as id, case k % 4 when 0 then 'hard' when 1 then 'medium' when 2 then 'mixed' else 'easy' end as tier, not missing as prompted, k % 5 <> 0 as adapted, round(base, 6) as sp, round(tuned, 6) as sa from s")
def field_audit(spark, d):
    """Two arms, gold, text and scores side by side; arm two lacks every fifth prediction."""
    named = F.concat(F.element_at(F.array(*map(F.lit, ("h-", "m-", "x-", ""))), (F.col("k") % 4 + 1).cast("int")), F.col("k").cast("string"))
    made = arms.wide(spark, d).select(named.alias("id"), "k", "gold", "base_text", "tuned_text")
    made.write.parquet(at := scratch.folder(spark, "audit"))  # the sources of an audit are files
    w = spark.read.parquet(at)
    scores = scoring.scored_arms(w, {"base": "base_text", "tuned": "tuned_text"}).select("id", F.col("base.f1").alias("sp"), F.col("tuned.f1").alias("sa"))
    two = {"prompted": w.select("id", F.col("base_text").alias("prediction")), "adapted": w.where("k % 5 <> 0").select("id", F.col("tuned_text").alias("prediction"))}
    out = scoring.field_audit(w.select("id", F.lit("text").alias("text")), w.select("id", "gold"), two, scores)
    return out.select("id", "tier", F.col("prompted").isNotNull().alias("prompted"), F.col("adapted").isNotNull().alias("adapted"), F.round("sp", 6).alias("sp"), F.round("sa", 6).alias("sa"))


# ---- verdict rules over every combination of what they read -------------------------------------------------------

CASES = "c as (select i, (i % 3)::int as trips, (i // 3 % 2)::int as blocked, [-0.06, -0.05, 0.04, 0.05, 0.3][(i // 6 % 5 + 1)::int] as mean, [-0.1, 0.0, 0.02][(i // 30 % 3 + 1)::int] as low, [0.001, 0.049, 0.05, 0.4][(i // 90 % 4 + 1)::int] as p, (i // 360 % 3)::int as wins, (i // 1080 % 3)::int as losses, [null, 0.1, 0.15, 0.95, 0.96, 0.98][(i // 3240 % 6 + 1)::int] as control from (select distinct (l_orderkey * 4 + l_linenumber) % 19440 as i from lineitem))"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """A case for every number that line items give, of 19,440."""
    pick = lambda every, values: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("i") / every) % len(values) + 1).cast("int"))
    c = table(spark, d, "lineitem").select(((F.col("l_orderkey") * 4 + F.col("l_linenumber")) % 19440).alias("i")).distinct()
    number = lambda every, n: (F.floor(F.col("i") / every) % n).cast("int")
    return c.select("i", number(1, 3).alias("trips"), number(3, 2).alias("blocked"), pick(6, [-0.06, -0.05, 0.04, 0.05, 0.3]).alias("mean"), pick(30, [-0.1, 0.0, 0.02]).alias("low"), pick(90, [0.001, 0.049, 0.05, 0.4]).alias("p"), number(360, 3).alias("wins"), number(1080, 3).alias("losses"), pick(3240, [None, 0.1, 0.15, 0.95, 0.96, 0.98]).alias("control"))


@query("with " + CASES + " select i, case when control is null then 'no mean' when control < 0.15 then 'floor' when control > 0.95 then 'ceiling' else 'ok' end as validity, case when trips > 0 then 'UNINFORMATIVE' when blocked > 0 then 'UNDECIDABLE' when mean >= 0.05 and low > 0 and p < 0.05 and wins > losses then 'GO' else 'PIVOT' end as gate, case when blocked > 0 then 'UNDECIDABLE' when mean >= 0.05 then 'PASS' else 'FAIL' end as receipts, case when mean >= -0.05 and wins >= losses then 'PASS' else 'FAIL' end as retention, case when mean >= 0.05 and low > 0 and wins > losses then 'PASS' else 'FAIL' end as unified, case when mean >= 0.05 and p < 0.05 and wins > losses then 'PASS' else 'FAIL' end as rehearsal, case when control >= 0.98 then 'saturated baseline' when mean <= 0 then 'no help' else 'helps' end as advice, case when i % 2 = 0 then 'secondary' else 'decision' end as role from c")
def verdict_rules(spark, d):
    """Every rule on both sides of each of its bounds."""
    c = F.col
    return _cases(spark, d).select(
        "i", verdicts.validity(c("control")).alias("validity"), verdicts.gate(c("trips"), c("blocked"), c("mean"), c("low"), c("p"), c("wins"), c("losses")).alias("gate"),
        verdicts.receipts_gate(c("blocked"), c("mean")).alias("receipts"), verdicts.retention(c("mean"), c("wins"), c("losses")).alias("retention"), verdicts.unified(c("mean"), c("low"), c("wins"), c("losses")).alias("unified"),
        verdicts.rehearsal(c("mean"), c("p"), c("wins"), c("losses")).alias("rehearsal"), verdicts.advice(c("control"), c("mean")).alias("advice"), verdicts.role(F.when(c("i") % 2 == 0, 10).otherwise(30)).alias("role"),
    )


@query("with c as (select i, (i % 4 + 8)::int as cells, [0.09, 0.1, 0.3][(i // 4 % 3 + 1)::int] as spread, [-0.9, -0.6, -0.59, 0.2][(i // 12 % 4 + 1)::int] as rho, [0.0, 0.099, 0.1, 0.2][(i // 48 % 4 + 1)::int] as gap from (select distinct c_custkey % 192 as i from customer)) select i, case when cells < 10 or spread < 0.1 then 'UNINFORMATIVE' when rho <= -0.6 and gap >= 0.1 then 'PASS' when rho <= -0.6 or gap >= 0.1 then 'PARTIAL' else 'REFUTED' end as verdict from c")
def difficulty_rule(spark, d):
    pick = lambda every, values: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("i") / every) % len(values) + 1).cast("int"))
    c = table(spark, d, "customer").select((F.col("c_custkey") % 192).alias("i")).distinct()
    return c.select("i", verdicts.difficulty(pick(1, [8, 9, 10, 11]), pick(4, [0.09, 0.1, 0.3]), pick(12, [-0.9, -0.6, -0.59, 0.2]), pick(48, [0.0, 0.099, 0.1, 0.2])).alias("verdict"))


# ---- search, votes, predictors ------------------------------------------------------------------------------------


@query("with " + LOGITS + ", r as (select *, row_number() over (partition by vec_id, step order by nll, token) as i from n where nll < 4.2) select vec_id, step, token, round(nll, 6) as nll from r where i <= 3")
def capped_expansions(spark, d):
    """Of each step's expansions the three cheapest, after sorting."""
    x = search.cheapest(search.expansions(_steps(spark, d), ["vec_id", "step"], 4.2), ["vec_id", "step"], 3)
    return x.select("vec_id", "step", "token", F.round("nll", 6).alias("nll"))


class FirstRow:
    """A predictor for tests: a grid's log-probability is minus the sum of its first row, over ten."""

    def predict(self, prompts: pd.DataFrame) -> pd.Series:
        return prompts["input"].str.slice(0, 8)

    def log_probability(self, pairs: pd.DataFrame) -> pd.Series:
        return pairs["output"].map(lambda t: -sum(map(int, t.split("\n", 1)[0])) / 10)


@query(SWEEP.replace("string_agg(nv::varchar, '' order by nq) as t", "sum(nv) as t") + "select vec_id, round(avg(-t / 10.0), 6) as mean_lp from y where nr = 0 group by vec_id")
def rescored_candidates(spark, d):
    """Each grid scored in all eight frames by one vectorised predictor."""
    frames = generate.augmentations(spark, 1, 0)
    out = predictor.rescored(vectors(spark, d), frames, FirstRow, ["vec_id"])
    return out.select("vec_id", F.round("mean_lp", 6).alias("mean_lp"))


@query("select conv_id, turn, substr(text, 1, 8) as completion from conversations where trim(substr(text, 1, 8), ' ') <> ''")
def kept_completions(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("input"))
    return predictor.kept(predictor.completions(c, FirstRow)).select("conv_id", "turn", "completion")


@query("with s as (select o_orderkey as id, j::int as ordinal, 'c' || ((o_orderkey + j) % 4) as key from orders, range(0, 3) r(j)), u as (select * from s union all select o_orderkey, 1073741824, 'c' || (o_orderkey % 5) from orders) select id, key, min(ordinal)::int as first from u group by id, key")
def union_of_pools(spark, d):
    """Search results and the greedy one, which comes last if it is new."""
    o = table(spark, d, "orders").selectExpr("o_orderkey as id")
    searched = o.withColumn("ordinal", F.explode(F.array(*map(F.lit, range(3))))).withColumn("key", F.concat(F.lit("c"), ((F.col("id") + F.col("ordinal")) % 4).cast("string")))
    return votes.union_of_pools(searched, o.withColumn("key", F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))), ["id"], "key")


# ---- generated ----------------------------------------------------------------------------------------------------


@query("select n_nationkey as seed, n_nationkey % 4 <> 3 as fits, n_nationkey % 3 = 0 and n_nationkey % 4 <> 3 as is_fixed from nation")
def resolved_geometries(spark, d):
    """Stored schema texts of three geometries and tampered ones: whether a
    geometry yields each, and whether it is the fixed one (the two drawn ones may
    agree on a seed, and then the first is named)."""
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed"))

    def texts(frames):
        for pdf in frames:
            made = [generate.describe(generate.schema(int(s), generate.GEOMETRIES[s % 3])) + ("x" if s % 4 == 3 else "") for s in pdf["seed"]]
            yield pdf.assign(schema_text=made)

    stored = seeds.mapInPandas(texts, "seed long, schema_text string")
    return generate.resolve_geometry(stored).select(F.col("seed").cast("int").alias("seed"), F.col("geometry").isNotNull().alias("fits"), F.col("geometry").eqNullSafe("fixed").alias("is_fixed"))


@query("with r as (select n_nationkey as seed, unnest(range(0, 6)) as index from nation) select seed, count(*) filter (where (seed + index) % 4 <> 1) as rescored, count(*) filter (where (seed + index) % 4 = 2 or (seed + index) % 4 = 3 and seed % 5 = 0) as mismatched, case when seed % 7 = 6 then 'schema mismatch' when count(*) filter (where (seed + index) % 4 = 2 or (seed + index) % 4 = 3 and seed % 5 = 0) > 0 then 'mismatches' else 'verified' end as status from r where seed % 7 <> 6 group by seed union all select n_nationkey, 0, 0, 'schema mismatch' from nation where n_nationkey % 7 = 6")
def primary_audit(spark, d):
    """Stored predictions scored again against regenerated gold. Right ones are
    stamped 1, of every fourth the stamp is wrong; every fifth seed also has
    unreadable predictions stamped 1; every seventh schema was tampered with."""
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed"))

    def runs(frames):
        for pdf in frames:
            yield pdf.assign(arm="adapted", k=4, eval_n=6, schema_text=[generate.describe(generate.schema(int(s), generate.GEOMETRIES[s % 3])) + ("x" if s % 7 == 6 else "") for s in pdf["seed"]])

    made = seeds.mapInPandas(runs, "seed long, arm string, k int, eval_n int, schema_text string")
    kinds = F.element_at(F.array(*map(F.lit, generate.GEOMETRIES)), (F.col("seed") % 3 + 1).cast("int"))
    gold = generate.records(seeds.withColumn("geometry", kinds), 4, 6).where("split = 'test'").withColumn("index", F.col("index") - 4)
    case = (F.col("seed") + F.col("index")) % 4
    prediction = F.when(case == 1, F.lit("")).when((case == 3) & (F.col("seed") % 5 == 0), F.lit("{")).otherwise(F.col("target"))
    results = gold.select("seed", F.lit("adapted").alias("arm"), "index", prediction.alias("prediction"), F.when(case == 2, 0.9).otherwise(1.0).alias("micro_f1"))
    return merges.primary_audit(made, results).select(F.col("seed").cast("int").alias("seed"), "rescored", "mismatched", "status")


@query("with t as (select unnest(range(0, (select count(distinct conv_id) from conversations))) as task), e as (select unnest(range(0, 9)) as epoch) select epoch, task::int as task, ((task + epoch) % 8)::int as augmentation from t, e")
def epoch_stream(spark, d):
    """Every task once per epoch, one dihedral element further each time; the order within an epoch is tested by golden values."""
    n = table(spark, d, "conversations").agg(F.count_distinct("conv_id")).first()[0]
    return generate.epochs(spark, n, 9, 1).select("epoch", "task", "augmentation")


@query("with c as (select conv_id, count(*) as n from conversations group by conv_id), h as (select conv_id, n, unnest(range(0, n)) as held from c), o as (select conv_id, held, unnest(range(0, n)) as index from h) select conv_id::varchar as key, held::int as held, index::int as index from o where held <> index")
def held_out_orders(spark, d):
    n = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return generate.leave_one_out_orders(n, 5).select("key", "held", "index")
