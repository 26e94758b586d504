"""Queries: grids and bounded search over ``embeddings`` (64 numbers as an 8 x 8 grid)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids
from ..operators import generate, search, votes
from ..tables import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


PALETTE = [0, 3, 1, 9, 4, 2, 7, 5, 8, 6]
CELLS = "c as (select vec_id, (i // 8)::int as r, (i % 8)::int as q, (floor(abs(embedding[i + 1]::double) * 100)::bigint % 10)::int as v from embeddings, range(0, 64) t(i))"
TEXT = "array_to_string(list(array_to_string(row_text, '') order by r), chr(10))"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", "label", grids.from_vector(F.col("embedding"), 8).alias("grid"))


def _digest(g):
    return F.sha2(grids.text(g), 256)


def _sql_text(r: str, q: str, value: str = "v") -> str:
    """Digest of the grid whose cell (r, q) is at new row ``r`` and column ``q``."""
    return f"x as (select vec_id, {r} as nr, {q} as nq, {value} as nv from c), y as (select vec_id, nr, string_agg(nv::varchar, '' order by nq) as t from x group by vec_id, nr) select vec_id, sha256(string_agg(t, chr(10) order by nr)) as digest from y group by vec_id"


@query("with " + CELLS + " select vec_id, true as valid, count(*)::int as cells, sum(v)::bigint as total from c group by vec_id")
def grid_from_vec(spark, d):
    g = F.col("grid")
    return vectors(spark, d).select("vec_id", grids.valid(g).alias("valid"), grids.cells(g).alias("cells"), F.aggregate(F.flatten(g), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("with " + CELLS + ", " + _sql_text("r", "q"))
def grid_text(spark, d):
    return vectors(spark, d).select("vec_id", _digest(F.col("grid")).alias("digest"))


@query("with " + CELLS + ", " + _sql_text("q", "7 - r"))
def grid_turned(spark, d):
    return vectors(spark, d).select("vec_id", _digest(grids.turned(F.col("grid"))).alias("digest"))


# The eight elements: quarter turns r, then the mirror f; the SQL gives the new row and column of a cell.
PLACES = {0: ("r", "q"), 1: ("q", "7 - r"), 2: ("7 - r", "7 - q"), 3: ("7 - q", "r")}
SWEEP = "with " + CELLS + ", x as (" + " union all ".join(f"select vec_id, {k} as rotations, {'true' if f else 'false'} as flip, {r} as nr, {'7 - (' + q + ')' if f else q} as nq, v as nv from c" for f in (False, True) for k, (r, q) in PLACES.items()) + "), y as (select vec_id, rotations, flip, nr, string_agg(nv::varchar, '' order by nq) as t from x group by all) "


@query(SWEEP + "select vec_id, rotations, flip, sha256(string_agg(t, chr(10) order by nr)) as digest from y group by vec_id, rotations, flip")
def dihedral_sweep(spark, d):
    elements = spark.createDataFrame([(k, f) for f in (False, True) for k in range(4)], "rotations int, flip boolean")
    rows = vectors(spark, d).crossJoin(F.broadcast(elements))  # eight rows, always
    return rows.select("vec_id", "rotations", "flip", _digest(grids.dihedral(F.col("grid"), F.col("rotations"), F.col("flip"))).alias("digest"))


def _augmentations(spark, palettes):
    return spark.createDataFrame([(k, f, p) for f in (False, True) for k in range(4) for p in palettes], "rotations int, flip boolean, palette array<int>")


@query(SWEEP + ", t as (select vec_id, rotations, flip, string_agg(t, chr(10) order by nr) as g from y group by vec_id, rotations, flip), i as (select vec_id, g from t where rotations = 0 and not flip) select vec_id, count(*) as same, count(*) filter (where t.g = i.g) as symmetries from t join i using (vec_id) group by vec_id")
def dihedral_roundtrip(spark, d):
    """How many of the eight elements are undone exactly, and how many leave the grid as it is."""
    a = _augmentations(spark, [list(range(10))])
    rows = vectors(spark, d).crossJoin(F.broadcast(a))
    moved = grids.dihedral(F.col("grid"), F.col("rotations"), F.col("flip"))
    back = grids.undo_dihedral(moved, F.col("rotations"), F.col("flip"))
    return rows.groupBy("vec_id").agg(F.count_if(back == F.col("grid")).alias("same"), F.count_if(moved == F.col("grid")).alias("symmetries"))


@query("with " + CELLS + ", p as (select *, [0, 3, 1, 9, 4, 2, 7, 5, 8, 6][v + 1] as w from c) select vec_id, 16::bigint as same, sum(w)::bigint as painted from p group by vec_id")
def palette_roundtrip(spark, d):
    a = _augmentations(spark, [PALETTE, PALETTE[::-1]])
    args = (F.col("rotations"), F.col("flip"), F.col("palette"))
    back = grids.restored(grids.augmented(F.col("grid"), *args), *args)
    same = vectors(spark, d).crossJoin(F.broadcast(a)).groupBy("vec_id").agg(F.count_if(back == F.col("grid")).alias("same"))
    painted = vectors(spark, d).select("vec_id", F.aggregate(F.flatten(grids.painted(F.col("grid"), F.array(*map(F.lit, PALETTE)))), F.lit(0).cast("long"), lambda s, x: s + x).alias("painted"))
    return same.join(painted, "vec_id")


@query("with " + CELLS + ", y as (select vec_id, r, string_agg(v::varchar, '' order by q) as t from c group by vec_id, r), g as (select vec_id, sha256(string_agg(t, chr(10) order by r)) as digest from y group by vec_id) select vec_id, digest, (select count(*) from range(0, 8) o(i) where (vec_id + i) % 3 <> 0) as found_count from g")
def grid_vote(spark, d):
    """Predictions in eight frames, two or three of them wrong, each differently; brought back to the original frame before they are counted."""
    a = _augmentations(spark, [list(range(10))]).withColumn("ordinal", F.col("rotations") + 4 * F.col("flip").cast("int"))
    rows = vectors(spark, d).crossJoin(F.broadcast(a))
    seen = grids.dihedral(F.col("grid"), F.col("rotations"), F.col("flip"))
    wrong = F.transform(seen, lambda r: F.transform(r, lambda c: F.pmod(c + 1 + F.col("ordinal"), F.lit(10)).cast("int")))
    predicted = F.when((F.col("vec_id") + F.col("ordinal")) % 3 == 0, wrong).otherwise(seen)
    back = grids.undo_dihedral(predicted, F.col("rotations"), F.col("flip"))
    pooled = votes.pool(rows.select("vec_id", "ordinal", F.lit(0.0).alias("lp"), grids.text(back).alias("text")), ["vec_id"], "text", "ordinal")
    return votes.ranked_by_count_then_lp(pooled.drop("ordinal"), ["vec_id"], 1).select("vec_id", F.sha2("text", 256).alias("digest"), "found_count")


@query("select vec_id, coalesce(label in (vec_id % 10, (vec_id + 1) % 10), false) as solved from embeddings")
def any_of_two(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    attempts = F.array(F.col("vec_id") % 10, (F.col("vec_id") + 1) % 10, F.col("label"))
    return e.select("vec_id", F.coalesce(grids.any_of_first_two(attempts, F.col("label")), F.lit(False)).alias("solved"))


LOGITS = "t as (select vec_id, (i // 16)::int as step, (i % 16)::int as token, embedding[i + 1]::double * 4 as x from embeddings, range(0, 64) r(i)), m as (select *, max(x) over w as top from t window w as (partition by vec_id, step)), n as (select vec_id, step, token, -(x - top - ln(sum(exp(x - top)) over (partition by vec_id, step))) as nll from m)"


def _steps(spark, d):
    e = spread(table(spark, d, "embeddings"), "vec_id").where(F.size("embedding") == 64).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step"))
    return e.select("vec_id", "step", F.slice("v", F.col("step") * 16 + 1, F.lit(16)).alias("logits"))


@query("with " + LOGITS + " select vec_id, step, count(*) as n, round(min(nll), 6) as best from n where nll < 2.5 group by vec_id, step")
def softmax_cutoff(spark, d):
    x = search.expansions(_steps(spark, d), ["vec_id", "step"], 2.5)
    return x.groupBy("vec_id", "step").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("nll"), 6).alias("best"))


@query("with " + LOGITS + ", p as (select a.vec_id, a.nll + b.nll as nll, 2 as depth from n a join n b using (vec_id) where a.step = 0 and b.step = 1 and a.nll < 4.2 and a.nll + b.nll < 4.2 union all select vec_id, nll, 1 from n where step = 0 and nll < 4.2) select vec_id, depth, count(*) as n, round(min(nll), 6) as best from p group by vec_id, depth")
def bounded_paths_depth2(spark, d):
    x = search.expansions(_steps(spark, d), ["vec_id", "step"], 4.2)
    p = search.bounded_paths(x, ["vec_id"], 4.2, 2)
    return p.groupBy("vec_id", F.size("path").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("nll"), 6).alias("best"))


@query("with " + LOGITS + ", s as (select vec_id, step, token, nll from n where step < 3 and nll < 6.0), p as (select vec_id, [] as path, nll from s where step = 0 and token = 15 union all select a.vec_id, [a.token], a.nll + b.nll from s a join s b using (vec_id) where a.step = 0 and b.step = 1 and a.token <> 15 and b.token = 15 union all select a.vec_id, [a.token, b.token], a.nll + b.nll + c.nll from s a join s b using (vec_id) join s c using (vec_id) where a.step = 0 and b.step = 1 and c.step = 2 and a.token <> 15 and b.token <> 15 and c.token = 15) select vec_id, array_to_string(list_transform(list_filter(path, lambda x: x < 10), lambda x: x::varchar), '') as digits, len(path) as tokens, round(nll, 6) as nll from p where nll < 6.0 and len(list_filter(path, lambda x: x > 10)) = 0 and len(list_filter(path, lambda x: x < 10)) > 0")
def completed_search(spark, d):
    """Sequences that the stop token (15) completes within three steps; 0 to 9
    are colours, 10 a line feed, and what isn't a grid is dropped."""
    x = search.expansions(_steps(spark, d), ["vec_id", "step"], 6.0)
    p = search.completed_paths(x, ["vec_id"], 6.0, 3, 15)
    text = F.array_join(F.transform("path", lambda t: F.when(t < 10, t.cast("string")).when(t == 10, "\n").otherwise("?")), "")
    grid = grids.from_text(text)
    return p.where(F.coalesce(grids.valid(grid), F.lit(False))).select("vec_id", F.replace(text, F.lit("\n"), F.lit("")).alias("digits"), F.size("path").alias("tokens"), F.round("nll", 6).alias("nll"))


@query("with " + LOGITS + ", p as (select a.vec_id from n a join n b using (vec_id) where a.step = 0 and b.step = 1 and a.nll < 4.2 and a.nll + b.nll < 4.2 union all select vec_id from n where step = 0 and nll < 4.2), f as (select e.vec_id, count(p.vec_id) as candidates from embeddings e left join p using (vec_id) group by e.vec_id) select case when candidates >= 20 then 'candidate_cap' else 'exhausted' end as reason, count(*) as frames, sum(candidates)::bigint as candidates from f group by reason")
def stop_reason_counts(spark, d):
    """Why each frame's bounded search ended: all candidates found, or as many as the cap."""
    p = search.bounded_paths(search.expansions(_steps(spark, d), ["vec_id", "step"], 4.2), ["vec_id"], 4.2, 2)
    frames = table(spark, d, "embeddings").select("vec_id")
    return search.stop_reasons(frames, p, ["vec_id"], 20).groupBy("reason").agg(F.count(F.lit(1)).alias("frames"), F.sum("candidates").alias("candidates"))


@query()
def schema_generate(spark, d):
    """Records of a seed for each nation; golden values and invariants are tested."""
    seeds = table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("seed"))
    return generate.records(seeds, 10, 5, "diverse").select("seed", "index", "split", F.length("text").alias("chars"), "target")
