"""Approximate nearest neighbours by NN-descent and greedy graph search.

The graph starts from leaves of a few random-projection trees. Each round joins
every node with its neighbours' vectors (those it points to and the nearest that
point to it), compares them with each other and keeps each one's nearest. Pairs
that met in an earlier round aren't compared again, and only what improves a
node's list leaves the task, so rounds become cheap and end when no list changes.
Queries walk the graph: the nearest unexpanded nodes of each query's list are
joined with the graph until no list changes. Equal vectors are one node, so a
vector that very many rows share costs as much as any other. What the rounds
and walks move are the vectors themselves, in the precision of the column, and
all distances are taken in double precision, so no row's size changes those of others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

DEGREE, BACK, PASSED_ON = 32, 32, 5
TREES, LEAF, SEED = 6, 512, 7
#: How many of its leaf's nodes each node starts with, per tree.
FROM_LEAF = 16
BEAM = 160
#: NN-descent's rule for ending: a round that adds no more than this part of all edges is the last.
SETTLED = 0.01
_EDGES = "u long, c long, d double"
_PIECE = 128


def taking_part(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v array<double>: rows with an id and a vector that isn't null,
    empty or zero and whose components are all there and finite. Of several
    lengths the most frequent takes part (of those the longest)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return rows.join(F.broadcast(size.select("n")), F.size("v") == F.col("n")).drop("n")


def packed(rows: DataFrame, keep: list[str], kind: str) -> DataFrame:
    """``keep`` and v of ``rows`` with h, the vector as bytes of a numpy ``kind`` that holds it exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = v.flatten().to_numpy().astype(kind).reshape(len(v), -1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], v, pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "v", "h"])

    return rows.select(*keep, "v").mapInArrow(run, ", ".join(f"{c} long" for c in keep) + ", v array<double>, h binary")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)


def _edges(u: np.ndarray, c: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["u", "c", "d"])


def _pairwise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances within the last two axes' points, and by how much each
    may be off: points are moved to their middle so that little cancels (a
    median, as one far point would move a mean). They only choose candidates,
    whose distances are then taken from differences."""
    x = x - np.median(x, axis=-2, keepdims=True)
    n = (x * x).sum(-1)
    sums = n[..., :, None] + n[..., None, :]
    return np.maximum(sums - 2 * (x @ np.swapaxes(x, -1, -2)), 0), 1e-13 * sums


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a - b
    return (x * x).sum(-1)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest distances of each u; needs one shuffle, by u. An edge
    that comes twice is new only if it is new each time."""
    order = Window.partitionBy("u").orderBy("d", "c")
    one = edges.repartition("u").groupBy("u", "c").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def first_graph(nodes: DataFrame, rows: int, kind: str, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """u, c, d: near pairs from leaves of random-projection trees. A leaf of many
    nodes is dealt to chunks of about ``leaf``, so every task is bounded."""
    size = len(nodes.select("h").first()[0]) // np.dtype(kind).itemsize

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(np.median(_matrix(batch.column("h"), kind), 0))], ["i", "x"])

    # A median of the batches' medians: no single vector moves it.
    middle = np.array(nodes.select("h").mapInArrow(centre, "i int, x double").groupBy("i").agg(F.percentile_approx("x", 0.5).alias("m")).orderBy("i").toPandas()["m"])
    depth = max(0, math.ceil(math.log2(max(1, rows / leaf))))
    planes = np.random.default_rng(SEED).standard_normal((trees, depth, size))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = np.einsum("tds,ns->ntd", planes, _matrix(batch.column("h"), kind) - middle) > 0
            code = (side * (1 << np.arange(depth, dtype=np.int64))).sum(2) if depth else np.zeros((batch.num_rows, trees), np.int64)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t)), pa.array(code[:, t]), batch.column("id"), batch.column("h")], ["tree", "leaf", "id", "h"])

    def compare(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _matrix(table.column("h"), kind)
        x = x - np.median(x, 0) if len(x) else x
        out = []
        for i in range(0, len(ids), _PIECE):  # rows of the distance matrix, not all at once
            part = x[i : i + _PIECE]
            d = np.maximum((part * part).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * part @ x.T, 0)
            d[np.arange(len(part)), np.arange(i, i + len(part))] = np.inf
            m = min(FROM_LEAF, len(ids) - 1)
            if m < 1:
                break
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            out.append(_edges(np.repeat(ids[i : i + len(part)], m), ids[near].ravel(), _squared(part[:, None], x[near]).ravel()))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_edges(*[np.zeros(0)] * 3)])

    dealt = nodes.mapInArrow(deal, "tree long, leaf long, id long, h binary")
    chunks = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("id") / leaf).alias("chunks"))
    salted = dealt.join(chunks, ["tree", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("id", "tree"), F.col("chunks")))
    return salted.select("tree", "leaf", "chunk", "id", "h").groupBy("tree", "leaf", "chunk").applyInArrow(compare, _EDGES)


def _local_join(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (hub, m, new, worst, h) sorted by hub: for every member of a hub's
        list the nearest others there that it hasn't met and that are nearer than
        the worst of its own list."""

        def compare(hub: np.ndarray, m: np.ndarray, new: np.ndarray, worst: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.concatenate(([True], hub[1:] != hub[:-1])))
            sizes = np.diff(np.append(begin, len(hub)))
            for i in range(0, len(begin), _PIECE):
                b, n = begin[i : i + _PIECE], sizes[i : i + _PIECE]
                wide = int(n.max())
                if wide < 2:
                    continue
                at = b[:, None] + np.minimum(np.arange(wide)[None], n[:, None] - 1)
                d, off = _pairwise(x[at])
                real = np.arange(wide)[None] < n[:, None]
                ok = real[:, :, None] & real[:, None, :] & (new[at][:, :, None] | new[at][:, None, :])
                ids = m[at]
                ok &= ids[:, :, None] != ids[:, None, :]  # itself; a node that both points to the hub and is pointed to comes twice
                ok &= d - off <= worst[at][:, :, None]
                d[~ok] = np.inf
                k = min(PASSED_ON, wide - 1)
                near = np.argpartition(d, k - 1, axis=2)[:, :, :k]
                g, row, _ = found = np.nonzero(np.take_along_axis(ok, near, 2))
                u, c = at[g, row], at[g, near[found]]
                dist = _squared(x[u], x[c])
                better = dist < worst[u]
                yield _edges(m[u[better]], m[c[better]], dist[better])

        columns = ("hub", "m", "new", "worst")
        rest = None
        for batch in batches:
            now = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in columns), _matrix(batch.column("h"), kind)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            cut = np.searchsorted(now[0], now[0][-1])  # the last hub may go on in the next batch
            yield from compare(*(x[:cut] for x in now)) if cut else ()
            rest = [x[cut:] for x in now]
        if rest is not None:
            yield from compare(*rest)

    return join


def descend(nodes: DataFrame, graph: DataFrame, kind: str, k: int = DEGREE, back: int = BACK) -> DataFrame:
    """One round: u, c, d, new after neighbours of neighbours have been compared."""
    closest = Window.partitionBy("hub").orderBy("d", "m")
    reverse = graph.selectExpr("c as hub", "u as m", "d", "new").withColumn("r", F.row_number().over(closest)).where(F.col("r") <= back).select("hub", "m", "new")
    members = graph.selectExpr("u as hub", "c as m", "new").union(reverse)
    lists = graph.groupBy("u").agg(F.when(F.count("c") >= k, F.max("d")).otherwise(float("inf")).alias("worst"))
    points = nodes.join(lists, nodes["id"] == lists["u"], "left").select("id", "h", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    rows = members.join(points, members["m"] == points["id"]).select("hub", "m", "new", "worst", "h").repartition("hub").sortWithinPartitions("hub")
    found = rows.mapInArrow(_local_join(kind), _EDGES).withColumn("new", F.lit(True))
    return nearest(found.union(graph.select("u", "c", "d", F.lit(False).alias("new"))), k)


def build(nodes: DataFrame, kind: str, k: int = DEGREE) -> DataFrame:
    """The neighbour graph u, c, d (squared distance), new of ``nodes`` (id, h:
    bytes of a ``kind``; vectors distinct), each round written to the shared
    folder. Ends when a round adds no more than ``SETTLED`` of all edges. A
    pair's distance is the same in every round and a list only takes what is
    nearer, so it does end."""
    graph = written(nearest(first_graph(nodes, nodes.count(), kind).withColumn("new", F.lit(True)), k), "graph")
    while graph.agg(F.count_if("new") > SETTLED * F.count("new")).first()[0]:
        following = written(descend(nodes, graph, kind, k), "graph")
        forget(graph)
        graph = following
    return graph


def _distances(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _squared(_matrix(batch.column("h"), kind), _matrix(batch.column("qh"), kind))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(d)], ["query", "node", "d"])

    return run


def walk(starts: DataFrame, graph: DataFrame, vectors: DataFrame, kind: str, beam: int = BEAM) -> DataFrame:
    """query, node: for each row of ``starts`` (query, qh, node: an entry
    point) the ``beam`` nearest nodes that a greedy walk finds. ``graph`` is
    walked both ways; ``vectors``: id, h. A query ends when all of its list is expanded."""
    back = graph.selectExpr("c as u", "u as c", "d").withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("d", "c"))).where(F.col("r") <= BACK).select("u", "c")
    steps_from = written(graph.select("u", "c").union(back).distinct(), "steps")
    queries = starts.select("query", "qh").distinct()
    best = Window.partitionBy("query").orderBy("d", "node")
    now = starts.join(vectors, starts["node"] == vectors["id"]).select("query", "node", "h", "qh")
    now = written(now.mapInArrow(_distances(kind), "query long, node long, d double").withColumn("done", F.lit(False)), "beam")
    while not (fresh := now.where("not done")).isEmpty():
        found = fresh.join(steps_from, fresh["node"] == steps_from["u"]).select("query", F.col("c").alias("node")).distinct()
        found = found.join(now.select("query", "node"), ["query", "node"], "left_anti")
        scored = found.join(vectors, found["node"] == vectors["id"]).join(queries, "query").select("query", "node", "h", "qh").mapInArrow(_distances(kind), "query long, node long, d double")
        merged = now.withColumn("done", F.lit(True)).union(scored.withColumn("done", F.lit(False)))
        following = written(merged.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"), "beam")
        forget(now)
        now = following
    return now.select("query", "node")


def search(embeddings: DataFrame, is_query: Column, k: int = 10, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows that were
    found for each row of ``embeddings`` (vec_id, embedding) for which
    ``is_query`` (of vec_id) holds; score is the Euclidean distance in double
    precision, ties go to the smaller vec_id. Null, zero and non-finite vectors
    take no part; fewer rows give fewer results; an empty table gives none.
    Rows that repeat a vec_id are candidates like any other; of query rows that
    share one the smallest vector is searched.
    """
    rows = written(taking_part(embeddings), "vectors")
    kind = "f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    nodes = written(packed(rows.groupBy("v").agg(F.min("vec_id").alias("id")), ["id"], kind), "nodes")
    if nodes.isEmpty():
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0D as score")
    graph = build(nodes.select("id", "h"), kind)
    key = F.xxhash64("v")  # of its own, so that a vector of many rows can be split
    named = rows.withColumn("key", key).join(nodes.withColumn("key", key), ["key", "v"]).select("vec_id", F.col("id").alias("node"), "v", "h")
    asked = named.where(is_query).groupBy(F.col("vec_id").alias("query")).agg(F.min(F.struct(F.col("v").alias("qv"), F.col("h").alias("qh"), "node")).alias("a"))
    queries = written(asked.select("query", "a.*"), "queries")
    found = walk(queries.drop("qv"), graph, nodes.select("id", "h"), kind, beam)
    exact = F.expr("sqrt(aggregate(zip_with(qv, v, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
    found = found.join(nodes.select(F.col("id").alias("node"), "v"), "node").join(queries.select("query", "qv"), "query").select("query", "node", exact.alias("d"))
    # Of equal vectors no more than k + 1 rows, the smallest, can be among the k nearest others.
    members = named.select("node", F.col("vec_id")).withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    order = Window.partitionBy("query").orderBy("d", "vec_id")
    ranked = found.join(members, "node").where("vec_id <> query").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", F.col("d").alias("score"))
