"""Query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import label_weights, mix


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = label_weights(table(spark, sf_dir, "labels"))
    return mix(table(spark, sf_dir, "documents"), weights).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_source_mix": op8_source_mix}
SQL = {
    "op8_source_mix": r"""
        with lab as (select doc_id, max(quality) as quality from labels group by doc_id),
        d as (select d.doc_id, d.source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                -ln((cast('0x' || substr(md5('mix:' || d.doc_id), 1, 13) as bigint) + 0.5) / 4503599627370496.0::double)
                / case when quality = 1 then 2.0 when quality = 0 then 0.5 else 1.0 end::double as k
              from documents d left join lab using (doc_id)),
        s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (select *, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as w, source_size * 2.0::double as cap from s),
        l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
                / (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0)) as lev
              from w window o as (order by cap / w, source is null, source)),
        m as (select *, max(case when cap / w > lev then lev end) over () as level from l),
        t as (select source, source_size, least(cap, coalesce(level * w, cap)) as target from m),
        e as (select *, coalesce(floor(target / source_size), 0)::int as epochs from t),
        r as (select *, target - epochs * source_size as rest from e),
        p as (select d.*, r.source_size, r.target, r.epochs, r.rest, sum(d.size) over (partition by d.source order by k, doc_id rows unbounded preceding) - d.size as ahead
              from d join r on d.source is not distinct from r.source)
        select doc_id, size, source_size, target, ((epochs + case when rest > 0 and ahead + size / 2.0::double <= rest then 1 else 0 end) * size)::bigint as taken from p"""
}
