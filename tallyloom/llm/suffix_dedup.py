"""Removal of repeated byte strings by externally sorted, induced suffixes.

Every string of ``length`` bytes has an anchor: the gram in it with the smallest
hash. Equal strings have equal anchors at equal offsets, so texts are compared
around anchors whose gram occurs more than once, and nowhere else.

The suffixes that begin at anchors are sorted by Spark's external sorter (sorted
runs on disk, merged through a priority queue), which gives each its rank and
the common prefix with its neighbour. All other suffixes are induced from
these: the suffixes one byte further left are the same ones, dealt stably by the
byte before them, and so on byte by byte. A suffix tuple is (preceding bytes'
class, rank); its common prefix with the next in its class is the number of
bytes gone left plus the least common prefix between their ranks. A string
repeats if that reaches ``length``. A task holds whole groups of tuples: those
of one gram at first. A group that is too large is induced recursively: its
range of distances is halved, and in each half the tuples are grouped by all the
bytes that equal strings of that half must share, and those without any
difference left there become one. Strings of one distance are equal or apart,
so the recursion ends, and no task grows with a passage that very many share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pieces, utf8, written

LENGTH, GRAM = 400, 64
#: Groups of more tuples than this are induced recursively.
CROWDED = 500
_ROWS = 8192
_SPANS = "key binary, lo int, hi int"
#: What names a row: its doc_id (null: 0) and a hash of its text. Rows that share both have equal results.
_ROW = ["did", "mark"]
_TUPLE = "g long, lo int, hi int, n long, most int, least int, before binary, after binary"


def _gears() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


GEARS = _gears()


def anchors_of(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts at offsets ``at``: positions of anchors, the hashes of their
    grams, and how far left of each the first and the last string begins that it
    is the anchor of (the larger distance, the smaller)."""
    none = np.zeros(0, np.int64)
    n, wide = len(data), length - gram + 1
    begins = np.zeros(n + 1, np.int64)
    long = np.diff(at) >= length
    np.add.at(begins, at[:-1][long], 1)
    np.add.at(begins, at[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(begins[:n]) > 0)  # of strings that lie in one text
    if not len(starts):
        return none, none, none, none
    h = GEARS[data]
    step = 1
    while step < gram:  # h[i]: of the gram that begins at i
        h[:-step] = (h[:-step] << np.uint64(step)) + h[step:] if step < 64 else h[:-step]
        step *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    step = 1
    while step * 2 <= wide:
        low[: n - step] = np.minimum(low[: n - step], low[step:])
        step *= 2
    if wide > step:
        low[: n - wide + step] = np.minimum(low[: n - wide + step], low[wide - step :])
    chosen = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]))))
    last = np.append(first[1:], len(chosen)) - 1
    p = chosen[first]
    return p, h[p].view(np.int64), p - starts[first], p - starts[last]


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            data, at = utf8(batch.column("text"))
            data, at = data[at[0] : at[-1]], at - at[0]
            p, h, most, least = anchors_of(data, at, length, gram)
            doc = np.searchsorted(at, p, side="right") - 1
            ids = [batch.column(c).take(pa.array(doc)) for c in _ROW]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(p - at[doc]), pa.array(h), pa.array(most, pa.int32()), pa.array(least, pa.int32())], [*_ROW, "p", "h", "most", "least"])

    return run


def _surroundings(length: int):
    """Rows (key, h, often, most, least, before, after, did, mark, p): the bytes on both sides of each anchor; key: their MD5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 19):
            keys, hs, oftens, mosts, leasts, befores, afters, rows, ps = [], [], [], [], [], [], [], [], []
            for i, (text, found) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found"), strict=True)):
                found = found.values
                rows += [i] * len(found)
                for p, h, often, most, least in zip(*(found.field(k).to_pylist() for k in ("p", "h", "often", "most", "least")), strict=True):
                    before, after = text[p - most : p], text[p : p + length - least]
                    keys.append(hashlib.md5(b"%d:" % most + before + after).digest())
                    hs.append(h), oftens.append(often), mosts.append(most), leasts.append(least), befores.append(before), afters.append(after), ps.append(p)  # noqa: E702
            names = [batch.column(c).take(pa.array(rows, pa.int64())) for c in _ROW]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hs, pa.int64()), pa.array(oftens, pa.bool_()), pa.array(mosts, pa.int32()), pa.array(leasts, pa.int32()), pa.array(befores, pa.binary()), pa.array(afters, pa.binary()), *names, pa.array(ps, pa.int64())], ["key", "h", "often", "most", "least", "before", "after", *_ROW, "p"])

    return run


def _padded(column: pa.Array, width: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    data = np.frombuffer(b"".join(v.rjust(width, b"\0") if right else v.ljust(width, b"\0") for v in values), np.uint8)
    return data.reshape(len(values), width), sizes


def _least_between(prefix: np.ndarray) -> list[np.ndarray]:
    """Tables of range minima over powers of two."""
    out = [prefix]
    step = 1
    while 2 * step <= len(prefix):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
        step *= 2
    return out


def induce(h: np.ndarray, before: np.ndarray, most: np.ndarray, after: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (h, after), h being the group: the farthest and nearest distance left of
    the anchor at which a string begins that another row has too (-1: none)."""
    n = len(h)
    far, near = np.full(n, -1), np.full(n, 1 << 30)
    same = np.zeros((n, after.shape[1] + 1), bool)
    same[1:, :-1] = after[1:] == after[:-1]
    prefix = np.argmin(same, axis=1)
    prefix[1:] = np.minimum(np.minimum(prefix[1:], sizes[1:]), sizes[:-1]) * (h[1:] == h[:-1])
    tables = _least_between(prefix.astype(np.int32))
    now = np.arange(n)
    kind = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
    for d in range(int(most.max()) + 1):
        if d:
            stay = most[now] >= d
            now, kind = now[stay], kind[stay]
            byte = before[now, before.shape[1] - d]
            order = np.argsort(byte, kind="stable")
            now, kind, byte = now[order], kind[order], byte[order]
            new = np.ones(len(now), bool)
            new[1:] = (byte[1:] != byte[:-1]) | (kind[1:] != kind[:-1])
        else:
            new = np.ones(n, bool)
            new[1:] = kind[1:] != kind[:-1]
        alone = new & np.append(new[1:], True)
        if alone.any():  # what nothing else has in common stays alone further left
            now, new = now[~alone], new[~alone]
        if not len(now):
            break
        kind = np.cumsum(new)
        pair = np.flatnonzero(~new)
        a, b = now[pair - 1], now[pair]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        common = np.empty(len(pair), np.int32)
        for k in np.unique(level):
            at = level == k
            common[at] = np.minimum(tables[k][a[at] + 1], tables[k][b[at] - (1 << k) + 1])
        hit = common >= length - d
        for x in (a[hit], b[hit]):
            x = x[(least[x] <= d) & (most[x] >= d)]
            far[x] = d
            near[x] = np.minimum(near[x], d)
    return far, near


def _induced(length: int):
    def compare(rows: pa.Table) -> pa.RecordBatch:
        most, least = rows.column("most").to_numpy(), rows.column("least").to_numpy()
        before, _ = _padded(rows.column("before"), max(1, int(most.max())), True)
        after, sizes = _padded(rows.column("after"), length, False)
        far, near = induce(rows.column("g").to_numpy(), before, most, after, sizes, least, length)
        whole = rows.column("n").to_numpy() > 1  # the same surroundings elsewhere: every string repeats
        far, near = np.where(whole, most, far), np.where(whole, least, near)
        found = np.flatnonzero(far >= 0)
        keys = rows.column("key").combine_chunks().take(pa.array(found))
        return pa.RecordBatch.from_arrays([keys, pa.array(-far[found], pa.int32()), pa.array(length - near[found], pa.int32())], ["key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows >= _ROWS:
                g = rest.column("g").to_numpy()
                cut = int(np.argmax(g == g[-1]))  # the last group may go on
                if cut:
                    yield compare(rest.slice(0, cut))
                    rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield compare(rest)

    return run


def _halved(length: int):
    """Each tuple in both halves of its range of distances: (part, key, tuple),
    the tuple cut to the half, part naming its contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, lo, hi, n, most, least, before, after in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "n", "most", "least", "before", "after")), strict=True):
                for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)):
                    near, far = max(least, a), min(most, b - 1)
                    if near <= far:
                        left, right = before[len(before) - far :], after[: length - near]
                        core = b"%d,%d:" % (a, b) + left[far - a :] + right[: length - b + 1]
                        part = hashlib.md5(b"%d,%d,%d,%d:" % (a, b, near, far) + left + right).digest()
                        out.append((part, key, xxhash.xxh3_64_intdigest(core) - (1 << 63), a, b, n, far, near, left, right))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "key", "g", "lo", "hi", "n", "most", "least", "before", "after"])

    return run


def _own_key(df: DataFrame, on: str) -> DataFrame:
    """With a hash of the join key as a key of its own: both sides shuffle for the join alone, so a hot key can be split."""
    return df.withColumn("k", F.xxhash64(on))


def induced_spans(tuples: DataFrame, often: DataFrame, length: int, crowded: int) -> DataFrame:
    """key, lo, hi: what repeated strings cover, counted from the anchor.
    ``tuples``: key and the columns of ``_TUPLE``, of groups that aren't crowded;
    ``often``: the same of groups that may be. Crowded groups are halved until
    none is crowded; each level is written, and its spans go back along the
    names of its parts."""
    levels, names = [tuples], []
    while True:
        crowd = often.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowded).select("g")
        if crowd.isEmpty():
            levels[-1] = levels[-1].unionByName(often)
            break
        levels[-1] = levels[-1].unionByName(_own_key(often, "g").join(_own_key(crowd, "g"), ["k", "g"], "left_anti").drop("k"))
        cut = _own_key(often, "g").join(_own_key(crowd, "g"), ["k", "g"], "left_semi").drop("k")
        cut = written(cut.mapInArrow(_halved(length), f"part binary, key binary, {_TUPLE}"), "cut")
        names.append(cut.select("part", "key").distinct())
        merged = cut.groupBy("part").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("g", "lo", "hi", "most", "least", "before", "after")])
        often = written(merged.withColumnRenamed("part", "key"), "tuples")
        levels.append(often.limit(0))

    def spans(rows: DataFrame) -> DataFrame:
        return rows.select("g", "key", "n", "most", "least", "before", "after").repartition("g").sortWithinPartitions("g", "after", "before").mapInArrow(_induced(length), _SPANS)

    out = spans(levels.pop())
    while levels:
        back = _own_key(names.pop(), "part").join(_own_key(out.withColumnRenamed("key", "part"), "part"), ["k", "part"]).select("key", "lo", "hi")
        out = spans(levels.pop()).union(back)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """did, mark, spans array<struct<start,stop>> (byte offsets, not merged) of the
    bytes that repeated strings cover. ``docs``: did, mark (together they name a text), text."""
    found = written(docs.mapInArrow(_anchors(length, gram), "did long, mark long, p long, h long, most int, least int"), "anchors")
    # A gram in no more places than fit a group can't be crowded; only the others' tuples are counted once copies are one.
    again = found.groupBy("h").count().where("count > 1").select("h", (F.col("count") > crowded).alias("often"))
    places = _own_key(found, "h").join(_own_key(again, "h"), ["k", "h"]).groupBy(*_ROW).agg(F.collect_set(F.struct("p", "h", "often", "most", "least")).alias("found"))
    places = written(places, "places")
    forget(found)
    around = docs.join(places, _ROW).mapInArrow(_surroundings(length), "key binary, h long, often boolean, most int, least int, before binary, after binary, did long, mark long, p long")
    around = written(around, "around")
    forget(places)
    distinct = around.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("h", "often", "most", "least", "before", "after")])
    distinct = written(distinct.withColumnRenamed("h", "g").withColumns({"lo": F.lit(0), "hi": F.lit(length - gram + 1)}), "distinct")
    spans = induced_spans(distinct.where("not often").drop("often"), distinct.where("often").drop("often"), length, crowded)
    out = _own_key(around.select("key", *_ROW, "p"), "key").join(_own_key(spans, "key"), ["k", "key"])
    out = out.groupBy(*_ROW).agg(F.collect_set(F.struct((F.col("p") + F.col("lo")).alias("start"), (F.col("p") + F.col("hi")).alias("stop"))).alias("spans"))
    out = written(out, "spans")
    forget(around)
    forget(distinct)
    return out


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """doc_id, kept binary (the remaining bytes), n_bytes, n_removed, n_spans,
    kept_sha256 for each row of ``docs`` (doc_id, text; other columns are left out).

    A byte goes if a string of ``length`` bytes that covers it also begins at
    another place, of the same text or another. Null and empty texts have no
    bytes. Every row comes back, with a null doc_id or one that others have too;
    rows that repeat a text repeat its strings.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("did", F.coalesce("doc_id", F.lit(0))).withColumn("mark", F.xxhash64("text"))
    joined = docs.join(repeated_spans(docs.select(*_ROW, "text"), length, gram, crowded), _ROW, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            out: dict[str, list] = {c: [] for c in ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, parts, end, runs = text or b"", [], 0, 0
                for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if s[0] > end or not runs:
                        parts.append(text[end : s[0]])
                        runs += 1
                    end = max(end, s[1])
                parts.append(text[end:])
                kept = b"".join(parts)
                for c, v in zip(out, (kept, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()), strict=True):
                    out[c].append(v)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], ["doc_id", *out])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
