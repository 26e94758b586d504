"""Centroid clustering by annulus search, in exact integer arithmetic.

Centroids are sorted by norm. A vector's distance to the centroid of the nearest
norm bounds that to its nearest centroid from above, and no centroid whose norm
differs from the vector's by more than the bound can be nearer. Those within
this annulus stand side by side in the order of norms, so two binary searches
find them; they are then compared exactly, ties on the annulus' edge included.
Vectors never move: a round reads them where they were written and gives a row
of sums for each task and cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SIZE, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Components from here on don't fit the sums of squares of 64-bit integers.
LARGEST = 1 << 27
#: Vectors that are compared at once; neighbours by norm, so that their annuli are much the same.
_PIECE = 512


def integers(embeddings: DataFrame, size: int | None = SIZE, scale: int = SCALE, largest: int = LARGEST) -> DataFrame:
    """``embeddings`` without embedding but with v array<int>: floor(scale * x)
    of each component as a double. Rows whose vector is null, holds a null or a
    non-finite component or one of ``largest`` or more after scaling, or hasn't
    ``size`` components (None: any number) are left out."""
    scaled = embeddings.withColumn("v", F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))).drop("embedding")
    fits = f"v is not null and forall(v, x -> x is not null and not isnan(x) and x >= {-largest}D and x < {largest}D)"
    return scaled.where(fits + (f" and size(v) = {size}" if size is not None else "")).withColumn("v", F.transform("v", lambda x: F.floor(x).cast("int")))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column of vectors of ``size`` as a matrix of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``x`` the number of its nearest centroid (of equally near
    ones the smallest), the squared distance, and how many comparisons all rows took."""
    squares = (centroids * centroids).sum(1)
    norms = np.sqrt(squares.astype(np.float64))
    by_norm = np.argsort(norms, kind="stable")
    sorted_norms = norms[by_norm]
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    own = np.sqrt((x * x).sum(1).astype(np.float64))
    order = np.argsort(own, kind="stable")
    # Floats carry the products where these and their sums are exact in them.
    exact = max(np.abs(x).max(initial=0), 1) * max(np.abs(centroids).max(initial=0), 1) * max(x.shape[1], 1) < 1 << 53
    right = centroids[by_norm].astype(np.float64 if exact else np.int64)
    compared = 0
    for i in range(0, len(x), _PIECE):
        at = order[i : i + _PIECE]
        part, norm = x[at], own[at]
        near = np.clip(np.searchsorted(sorted_norms, norm), 1, max(len(norms) - 1, 1))
        near = np.minimum(near - (norm - sorted_norms[near - 1] <= np.abs(sorted_norms[np.minimum(near, len(norms) - 1)] - norm)), len(norms) - 1)
        apart = part - centroids[by_norm[near]]
        bound = np.sqrt((apart * apart).sum(1).astype(np.float64))
        slack = (bound + norm + 1) * 1e-9  # more than roots can be off: the edge itself is inside
        low = np.searchsorted(sorted_norms, norm - bound - slack, side="left")
        high = np.searchsorted(sorted_norms, norm + bound + slack, side="right")
        a, b = int(low.min()), int(high.max())
        products = (part.astype(right.dtype) @ right[a:b].T).astype(np.int64)
        d = (part * part).sum(1)[:, None] + squares[by_norm[a:b]][None] - 2 * products
        column = np.arange(a, b)[None]
        inside = (column >= low[:, None]) & (column < high[:, None])
        compared += int(inside.sum())
        d[~inside] = np.iinfo(np.int64).max
        least = d.min(1)
        number = np.where(d == least[:, None], by_norm[a:b][None], len(centroids)).min(1)
        cluster[at], distance[at] = number, least
    return cluster, distance, compared


def starts(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors of the ``clusters`` rows (vec_id, v) with the smallest SHA-256
    of ``seed:vec_id``; rows without an id come last, equal ids by their vectors."""
    named = rows.select(F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    first = named.orderBy(F.asc_nulls_last("hash"), "v").limit(clusters).collect()  # ``clusters`` rows at most
    return np.array([r["v"] for r in first], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the exact mean of each one's
    vectors; one without vectors stays. Tasks add up what they have, so a row for
    each task and cluster is shuffled, and one for each cluster collected."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), size)
            cluster, _, _ = nearest_centroids(x, centroids)
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(x[order], first, axis=0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.select("v").mapInArrow(run, "cluster long, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    # As decimals, so that no number of vectors overflows.
    total = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s"))
    following = centroids.copy()
    for r in total.collect():  # clusters times components
        following[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return following


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, v) as vec_id, cluster, distance (squared)."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest_centroids(matrix(batch.column("v"), size), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of each vector of ``embeddings`` (vec_id,
    embedding; other columns are left out) that ``integers`` keeps, and (cluster,
    centroid array<long>, n_vectors, cluster_inertia, inertia) of each cluster.

    Rows that repeat a vec_id, or have none, are vectors like any other. Fewer
    vectors than ``clusters`` give as many clusters; copies of a start leave
    empty ones (the smallest number takes ties), whose inertia is zero. No
    vectors give two empty tables. An inertia beyond 64 bits is null."""
    spark = embeddings.sparkSession
    rows = written(integers(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), size), "integers")
    centroids = starts(rows, clusters, seed).reshape(-1, size)
    if not len(centroids):
        return rows.selectExpr("vec_id", "0 as cluster", "0L as distance"), spark.createDataFrame([], "cluster int, centroid array<long>, n_vectors long, cluster_inertia long, inertia long")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = written(assigned(rows, centroids), "assigned")
    sums = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(28,0)")).alias("s"))
    by_cluster = {r["cluster"]: (r["n"], int(r["s"])) for r in sums.collect()}  # a row for each cluster
    total = sum(s for _, s in by_cluster.values())
    long = lambda x: x if x < 1 << 63 else None
    described = [(i, c.tolist(), by_cluster.get(i, (0, 0))[0], long(by_cluster.get(i, (0, 0))[1]), long(total)) for i, c in enumerate(centroids)]
    return found, spark.createDataFrame(described, "cluster int, centroid array<long>, n_vectors long, cluster_inertia long, inertia long")

