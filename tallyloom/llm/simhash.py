"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at
most three bits, one half differs in at most one. Each different half is
therefore indexed under its 32 variants with one bit wild; an equality join of
the variants finds the halves that differ in one bit, and the fingerprints that
have such halves, or share one, meet and are verified on all 64 bits. Only
distinct fingerprints are compared, so copies never multiply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, pieces, written

WORDS, DISTANCE, SEED = 3, 3, 42
#: Places of more fingerprints are cut again by variants of the other half.
HOT = 2000
_NARROW = 64


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp long: a bit is set if it is set in over half the XXH64 values
    of the text's word shingles. Null and wordless texts have fingerprint zero;
    a text of fewer words is one shingle."""

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            hashes, sizes = [], []
            digest = xxhash.xxh64_intdigest
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                parts = (text or b"").lower().split()  # of bytes: A-Z; 20, 09 to 0D
                line = b" ".join(parts)
                ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
                if len(parts) > words:
                    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
                    hashes += [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
                    sizes.append(len(starts))
                else:
                    hashes += [digest(line, SEED)] * bool(parts)
                    sizes.append(int(bool(parts)))
            n = np.array(sizes, np.int64)
            fp = np.zeros(len(n), np.int64)
            if len(hashes):
                bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                full = n > 0
                starts = (np.cumsum(n) - n)[full]
                counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                fp[full] = np.packbits(counts * 2 > n[full][:, None], axis=1).view(">i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _halves(nodes: DataFrame) -> DataFrame:
    """id, fp, side, value, other: both halves of every fingerprint."""
    high, low = "shiftrightunsigned(fp, 32)", "fp & 4294967295L"
    return nodes.selectExpr("id", "fp", f"inline(array(struct(0L as side, {high} as value, {low} as other), struct(1L as side, {low} as value, {high} as other)))")


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """By a number of partitions that small inputs keep: what follows makes many rows of one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def places(values: DataFrame, hot: int = HOT) -> DataFrame:
    """key, side, value, crowded: where fingerprints meet. ``values``: side,
    value, n, a row for every different half. A half that several fingerprints
    share is a place, and so are two halves that differ in one bit: both have
    the same variant with that bit wild, which no third half has, so no key is
    ever hot. A place of more than ``hot`` fingerprints is crowded."""
    variants = "transform(sequence(0L, 31L), i -> struct((shiftleft(2L * (i + 1) + side, 32) | (value & ~shiftleft(1L, int(i)))) as key, cast(shiftleft(1, int(shiftright(value, int(i)) & 1)) as tinyint) as seen))"
    met = _dealt(values, "side", "value").selectExpr(f"inline({variants})").groupBy("key").agg(F.bit_or("seen").alias("seen")).where("seen = 3")
    first, bit = "key & 4294967295L", "shiftleft(1L, int(shiftright(key, 33) - 1))"
    near = met.selectExpr("key", "shiftright(key, 32) & 1 as side", f"explode(array({first}, ({first}) | {bit})) as value")
    own = values.where("n > 1").selectExpr("shiftleft(side, 32) | value as key", "side", "value")
    sized = own.union(near).join(values, ["side", "value"])
    return sized.withColumn("crowded", F.sum("n").over(Window.partitionBy("key")) > hot).select("key", "side", "value", "crowded")


def close_pairs(fps: np.ndarray, bucket: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), a < b, of the fingerprints of one bucket that differ in
    at most ``distance`` bits, block by block. Rows are sorted by bucket."""
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(begin, len(bucket)))
    narrow = np.repeat(sizes <= _NARROW, sizes)
    for s in range(1, int(sizes[sizes <= _NARROW].max(initial=1))):  # neighbours s apart, of all narrow buckets at once
        at = np.flatnonzero(narrow[s:] & (bucket[s:] == bucket[:-s]) & (np.bitwise_count(fps[s:] ^ fps[:-s]) <= distance))
        yield at, at + s
    for lo, n in zip(begin[sizes > _NARROW].tolist(), sizes[sizes > _NARROW].tolist(), strict=True):
        step = max(1, (1 << 20) // n)
        for i in range(lo, lo + n, step):  # rows of the matrix, not all at once
            a, b = np.nonzero(np.bitwise_count(fps[i : min(i + step, lo + n), None] ^ fps[None, i : lo + n]) <= distance)
            yield a[a < b] + i, b[a < b] + i


def first_connected(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` positions the first one that pairs connect it with."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _verified(distance: int, all_pairs: bool):
    """Of rows (key, sub, id, fp) sorted by key and sub: the links inside each bucket."""

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, sub, ids = (rows.column(c).to_numpy() for c in ("key", "sub", "id"))
        bucket = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))))
        pairs = close_pairs(rows.column("fp").to_numpy().view(np.uint64), bucket, distance)
        if not all_pairs:
            root = first_connected(len(ids), pairs)
            at = np.flatnonzero(root != np.arange(len(ids)))
            pairs = iter([(at, root[at])])
        for a, b in pairs:
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rest = (now if rest is None else pa.concat_tables([rest, now])).combine_chunks()
            key, sub = rest.column("key").to_numpy(), rest.column("sub").to_numpy()
            cut = int(np.argmax((key == key[-1]) & (sub == sub[-1])))  # the last bucket may go on
            if cut:
                yield from compare(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None:
            yield from compare(rest)

    return run


def _wild(value: str, bits: int, part: int) -> str:
    """SQL: the keys of a value of so many bits: itself and each variant with one bit wild."""
    return f"transform(sequence(0L, {bits}L), i -> shiftleft(2 * i + {part}, {bits}) | if(i = 0, {value}, {value} & ~shiftleft(1L, int(i) - 1)))"


def links(nodes: DataFrame, distance: int = DISTANCE, hot: int = HOT, all_pairs: bool = True) -> DataFrame:
    """Pairs (a, b) of nodes (id, fp; fp distinct) whose fingerprints differ in
    at most ``distance`` (3 at most) bits; without ``all_pairs`` only what
    connects the same nodes: a member of a bucket is linked to the first one
    that it is connected with there, so that links never outnumber the rows.

    In a crowded place the other half differs in at most three bits too: again
    one of two parts in one at most, and members are dealt to buckets by the
    variants of both. Such a bucket has at most 2^18 fingerprints, compared in blocks.
    """
    if distance > 3:
        raise ValueError("two halves with one wild bit find differences of three bits at most")
    halves = _halves(nodes)
    values = written(halves.groupBy("side", "value").agg(F.count(F.lit(1)).alias("n")), "halves")
    members = halves.join(places(values, hot), ["side", "value"])
    subs = f"concat({_wild('(other & 65535L)', 16, 0)}, {_wild('shiftright(other, 16)', 16, 1)})"
    rows = members.selectExpr("key", f"explode(if(crowded, {subs}, array(-1L))) as sub", "id", "fp")
    found = _dealt(rows, "key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_verified(distance, all_pairs), "a long, b long")
    return found.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct() if all_pairs else found


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b)
    reaches. Alternates large-star and small-star steps; each round is written
    to the shared folder, so a lost executor costs one round at most. Joins to
    the least neighbour shuffle for themselves alone, so that the rows of a node
    with very many edges can be split."""
    mark = F.expr("struct(count(1) as n, sum(cast(xxhash64(u, v) as decimal(20, 0))) as x)")
    key = F.xxhash64("u")

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.withColumn("k", key).join(least.withColumn("k", key), ["k", "u"])

    now = written(edges.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), "edges")
    seen = None
    while (state := now.agg(mark.alias("m")).first()["m"]) != seen:
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = with_least(both, least).where("v > u and v <> m").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, least).where("v <> m").selectExpr("v as u", "m as v").union(least.selectExpr("u", "m as v"))
        following = written(small.distinct(), "stars")
        forget(now)
        now = following
    return now.selectExpr("u as node", "v as component")


def simhash_groups(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``
    (doc_id, text; other columns are left out). component_id is the smallest
    doc_id reachable over fingerprints that differ in at most ``distance`` bits.
    Null and empty texts have fingerprint zero and are linked like any other;
    rows that repeat a doc_id come back as often. Rows of a null doc_id link and
    are linked; component_id is null where no row of a component has an id."""
    prints = written(fingerprints(docs, words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    nodes = written(nodes, "nodes")
    found = components(links(nodes.select(F.col("fp").alias("id"), "fp"), distance, hot, all_pairs=False))
    # A fingerprint that is linked is named by its component's smallest id; any other by its own.
    named = found.union(found.select(F.col("component").alias("node"), "component").distinct())
    linked = nodes.join(named, nodes["fp"] == named["node"]).select("fp", "id", "component")
    smallest = linked.groupBy(F.col("component").alias("of")).agg(F.min("id").alias("component_id")).withColumn("of_key", F.xxhash64("of"))
    renamed = linked.withColumn("key_", F.xxhash64("component")).join(smallest, (F.col("key_") == F.col("of_key")) & (F.col("component") == F.col("of"))).select(F.col("fp").alias("linked_fp"), "component_id")
    named = nodes.join(renamed, nodes["fp"] == renamed["linked_fp"], "left").select("fp", F.when(F.col("linked_fp").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    # A key of its own makes both sides shuffle for this join alone, so that a fingerprint of many copies can be split.
    key = F.xxhash64("fp")
    return (
        prints.withColumn("key", key)
        .join(named.withColumn("key", key), ["key", "fp"])
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document with the
    smallest doc_id. Rows that repeat a doc_id stay together, if any of them is
    that document; rows of a null doc_id all stay, as nothing names them."""
    groups = simhash_groups(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = groups.where("not stays").select(F.col("doc_id").alias("gone_id_"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id_"], "left_anti")
