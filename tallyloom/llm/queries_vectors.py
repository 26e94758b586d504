"""Queries of the vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import CLUSTERS, ROUNDS, clustered
from .common import table
from .negatives import mine
from .neighbours import search


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, clusters = clustered(table(spark, sf_dir, "embeddings"))
    digests = clusters.select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return vectors.join(F.broadcast(digests), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _rounds() -> str:
    """The clustering as one row for each vector and component, a step after the other."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
        d{i} as materialized (select x.row, c.cluster, sum((x.c - c.c) * (x.c - c.c))::bigint as d from x join c{i} c using (i) group by all),
        a{i} as materialized (select row, arg_min(cluster, (d, cluster)) as cluster, min(d) as d from d{i} group by row)""")
        if i < ROUNDS:
            steps.append(f"""
        m{i} as (select a.cluster, x.i, sum(x.c)::bigint as s, count(*) as n from a{i} a join x using (row) group by all),
        c{i + 1} as materialized (select cluster, i, coalesce((s - ((s % n + n) % n)) // n, c)::bigint as c from c{i} left join m{i} using (cluster, i))""")
    return ",".join(steps)


QUERIES = {"op7_nn_descent": op7_nn_descent, "op11_annulus_clusters": op11_annulus_clusters, "op13_hard_negatives": op13_hard_negatives}
SQL: dict[str, str] = {
    "op11_annulus_clusters": f"""
        with kept as materialized (
            select row_number() over () as row, vec_id, embedding from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
        x as materialized (select row, unnest(range(64)) as i, floor(256 * unnest(embedding)::double)::bigint as c from kept),
        start as (select row, row_number() over (order by sha256('2:' || vec_id)) - 1 as cluster from kept qualify cluster < {CLUSTERS}),
        c0 as materialized (select cluster, i, c from start join x using (row)),{_rounds()},
        digest as (select cluster, sha256(string_agg(c::varchar, ',' order by i)) as centroid_sha256 from c{ROUNDS} group by cluster),
        sums as (select cluster, sum(d)::bigint as cluster_inertia from a{ROUNDS} group by cluster)
        select vec_id, cluster::int as cluster, d as distance, cluster_inertia, (select sum(d)::bigint from a{ROUNDS}) as inertia, centroid_sha256
        from a{ROUNDS} join kept using (row) join sums using (cluster) join digest using (cluster)""",
    "op13_hard_negatives": """
        with r as materialized (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda e: floor(256 * e::double)) as v
            from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
        p as materialized (
            select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
            from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
        positive as (select anchor_id, vec_id as positive_id, score as positive_score from p where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by p.score desc, p.vec_id)::int as rank, p.vec_id as negative_id, positive_score, p.score as negative_score
        from positive join p using (anchor_id) where not same and 30 * positive_score <= 100 * p.score and 100 * p.score <= 90 * positive_score
        qualify rank <= 10""",
}
