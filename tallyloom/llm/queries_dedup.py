"""Queries of the duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table
from .exact_dedup import exact_groups
from .line_dedup import drop_repeated_lines
from .simhash import simhash_groups
from .suffix_dedup import cut_repeats


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents"))


def op10_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_suffix_repeats": op3_suffix_repeats, "op4_chunk_recipes": op4_chunk_recipes, "op6_line_windows": op6_line_windows, "op10_simhash_variants": op10_simhash_variants}
SQL = {
    "op4_chunk_recipes": f"""
        with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as s from documents)
        select doc_id, max(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
               doc_id = max(doc_id) over (partition by s) as kept, sha256(s) as text_sha256
        from t""",
    "op6_line_windows": """
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from d),
        w as (select doc_id, pos, line || chr(10) || lead(line) over o || chr(10) || lead(line, 2) over o as win from l window o as (partition by doc_id order by pos)),
        later as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by win order by doc_id, pos) as k from w where win is not null) where k > 1),
        gone as (select distinct doc_id, pos + j as pos from later, (select unnest(range(3)) as j)),
        flagged as (select l.doc_id, l.pos, l.line, gone.pos is not null as gone from l left join gone using (doc_id, pos)),
        edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as begins from flagged)
        select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text, count(*) as n_lines,
               count(*) filter (where gone) as n_removed, count(*) filter (where begins) as n_spans
        from edges group by doc_id""",
}
