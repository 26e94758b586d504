"""Queries: searches whose scores depend on the prefix, and voted decoding of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import grids
from ..operators import frontier, voted
from ..tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- a predictor over a vector: tokens 0 to 2 are colours, 3 a line feed, 4 the end ---------------------------------

TOKENS, LINE_FEED, STOP, CUTOFF, DEPTH, CAP = 5, 3, 4, 4.0, 12, 6


class VectorTokens:
    """Logits of five tokens from the frame's vector, at places that the whole prefix chooses."""

    def next_logits(self, prefixes: pd.DataFrame) -> np.ndarray:
        vectors = np.stack(prefixes["embedding"].to_numpy()).astype(float)
        state = np.array([sum((t + 1) * (i + 2) for i, t in enumerate(path)) for path in prefixes["path"]])
        at = (7 * np.arange(TOKENS)[None] + 5 * state[:, None]) % 64
        return 40 * np.take_along_axis(vectors, at, 1)


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", "embedding")


def _text(path):
    return F.array_join(F.transform(path, lambda t: F.when(t == LINE_FEED, "\n").otherwise(t.cast("string"))), "")


def _searched(spark: SparkSession, d: str, at: str) -> DataFrame:
    is_grid = lambda path: grids.valid(grids.from_text(_text(path)))
    return frontier.completions(_frames(spark, d), ["vec_id"], VectorTokens, at, CUTOFF, DEPTH, [STOP], accept=is_grid, cap=CAP)


#: All prefixes, each with its place among its siblings, and the completions that are grids.
PREFIXES = f"""with recursive e as (select vec_id, embedding from embeddings where len(embedding) = 64),
n(vec_id, path, places, nll, state, ended) as (
    select vec_id, []::int[], []::int[], 0.0::double, 0::bigint, false from e
    union all
    select vec_id, list_append(path, s.token), list_append(places, place::int), s.total, state + (s.token + 1) * (len(path) + 2), s.token = {STOP} from (
        select vec_id, path, places, state, unnest(list_filter(options, lambda o: o.total < {CUTOFF})) as s, unnest(range(len(list_filter(options, lambda o: o.total < {CUTOFF})))) as place from (
            select *, list_sort(list_transform(range({TOKENS}), lambda t: {{'total': nll + z - logits[t + 1], 'token': t::int}})) as options from (
                select *, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) as z from (
                    select n.*, list_transform(range({TOKENS}), lambda t: 40 * embedding[((7 * t + 5 * state) % 64 + 1)::int]::double) as logits from n join e using (vec_id)
                    where not ended and len(path) < {DEPTH}))))),
t as (select vec_id, path[:-2] as path, places, nll, array_to_string(list_transform(path[:-2], lambda x: case when x = {LINE_FEED} then chr(10) else x::varchar end), '') as t from n where ended),
l as (select *, list_filter(string_split(t, chr(10)), lambda x: x <> '') as lines from t),
c as (select * from l where len(lines) > 0 and len(list_distinct(list_transform(lines, lambda x: length(x)))) = 1)
"""


@query(PREFIXES + f", f as (select * from c qualify row_number() over (partition by vec_id order by places) <= {CAP}) select vec_id, (row_number() over (partition by vec_id order by nll, places))::int as rank, t as text, len(path)::int as tokens, round(nll, 6) as nll from f")
def prefix_search(spark, d):
    """Grids of up to eleven tokens below the cutoff: of each frame the first six
    that a search of the best sibling first meets, the likeliest first."""
    found = frontier.capped(_searched(spark, d, scratch.folder(spark, "search")), ["vec_id"], CAP)
    return found.select("vec_id", "rank", _text(F.col("path")).alias("text"), F.size("path").alias("tokens"), F.round("nll", 6).alias("nll"))


@query(PREFIXES + f", k as (select e.vec_id, least(count(c.vec_id), {CAP}) as candidates from e left join c using (vec_id) group by e.vec_id) select vec_id, candidates, case when candidates >= {CAP} then 'candidate_cap' else 'exhausted' end as reason from k")
def prefix_search_reasons(spark, d):
    """Why the search of each frame ended, and with how many candidates."""
    frames = _frames(spark, d)
    return frontier.reasons(frames, _searched(spark, d, scratch.folder(spark, "search")), ["vec_id"], CAP)


@query(PREFIXES + ", k as (select len(path) as n, ended from n where len(path) > 0) select (n - 1)::int as level, count(*) filter (where not ended) as prefixes, count(*) filter (where ended) as ended from k group by n")
def prefix_search_levels(spark, d):
    """The search without a cap: prefixes and completions, grids or not, by level."""
    at = scratch.folder(spark, "search")
    frontier.completions(_frames(spark, d), ["vec_id"], VectorTokens, at, CUTOFF, DEPTH, [STOP])
    return frontier.levels(spark, at)


# ---- voted decoding ---------------------------------------------------------------------------------------------------

SAMPLES = 5


class OrderTexts:
    """Completions of an order that agree up to their spacing or not at all, and
    log-probabilities that depend on the text."""

    def predict(self, prompts: pd.DataFrame) -> pd.Series:
        k, i = prompts["k"].to_numpy(), prompts["ordinal"].to_numpy()
        answer = (k * (i + 1) * 7) % 3
        forms = np.where(i % 2 == 0, "{\"a\": %d, \"b\": null}", "{\"b\":null,\"a\":%d}")
        texts = pd.Series([f % a for f, a in zip(forms, answer.tolist(), strict=True)], index=prompts.index)
        return texts.mask((k % 11 == 0) & (i == 3), "no json").mask((k % 13 == 0) & (i > 0))

    def log_probability(self, pairs: pd.DataFrame) -> pd.Series:
        answer = pairs["output"].str.extract(r"(\d)", expand=False).fillna("7").astype(int)
        return -((answer * 13 + pairs["output"].str.len() * 7 + pairs["k"]) % 97) / 64.0


VOTED = f"""with o as (select o_orderkey as k, i::int as i, (o_orderkey * (i + 1) * 7) % 3 as answer from orders, range(0, {SAMPLES}) r(i) where not (o_orderkey % 13 = 0 and i > 0)),
p as (select k, i, case when k % 11 = 0 and i = 3 then 'no json' when i % 2 = 0 then '{{"a": ' || answer || ', "b": null}}' else '{{"b":null,"a":' || answer || '}}' end as text, case when k % 11 = 0 and i = 3 then 'no json' else '{{"a":' || answer || ',"b":null}}' end as key from o),
s as (select *, -((case when text = 'no json' then 7 else regexp_extract(text, '[0-9]')::int end * 13 + length(text) * 7 + k) % 97) / 64.0::double as lp from p),
v as (select k, key, count(*) as found_count, avg(lp) as mean_lp, min(i) as first, arg_max(text, (lp, -i)) as text from s group by all)
"""


def _decoded(spark: SparkSession, d: str, cache: str) -> DataFrame:
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return voted.decode(prompts, ["k"], OrderTexts, SAMPLES, cache, most_chars=4096)


@query(VOTED + "select k, text, key, found_count, round(mean_lp, 6) as mean_lp from v qualify row_number() over (partition by k order by found_count + exp(mean_lp) desc, first) = 1")
def voted_decode(spark, d):
    """The first choice of a vote over five completions for each order."""
    return _decoded(spark, d, scratch.folder(spark, "scores")).select("k", "text", "key", "found_count", F.round("mean_lp", 6).alias("mean_lp"))


@query(VOTED + ", x as (select distinct k, text, length(text) as chars from s) select count(*) as texts, sum(chars)::bigint as chars, 0::bigint as asked_again from x")
def voted_calls(spark, d):
    """How often the predictor is asked: once for each different text of a task, and
    not at all when the vote is held again."""
    cache = scratch.folder(spark, "scores")
    _decoded(spark, d, cache)
    first = voted.calls(spark, cache).first()
    _decoded(spark, d, cache)
    again = voted.calls(spark, cache).first()
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    chars = voted.pool(prompts, OrderTexts, SAMPLES).select("k", "text").distinct().agg(F.sum(F.length("text")).alias("chars"))
    return chars.select(F.lit(first["texts"]).cast("long").alias("texts"), "chars", F.lit(again["texts"] - first["texts"]).cast("long").alias("asked_again"))
