"""Exact duplicates by content-defined chunk recipes.

Texts are cut where a rolling hash of the last 32 bytes meets a condition, so
equal texts have equal chunks. Each distinct chunk body is moved once, to
verify that no two bodies share an identifier; after that a text is its ordered
list of identifiers (its recipe), and only recipes are grouped and joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, pieces, utf8, written

#: Chunk sizes in bytes: none is shorter but the last of a text, the usual one, none is longer.
SHORTEST, USUAL, LONGEST = 512, 2048, 16384
_RECIPES = "doc_id long, text_sha256 string, recipe array<bigint>"
_BODIES = "id_a long, id_b long, n long, body binary"


def _gear() -> np.ndarray:
    """A 32-bit number for each byte value, from a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cuts(data: np.ndarray, at: np.ndarray) -> Iterator[list[int]]:
    """For each text (``at``: offsets into ``data``) the ends of its chunks. The
    hash of 32 bytes comes from five doublings over the whole buffer; the
    shortest chunk is longer than that, so no text sees its neighbour's bytes."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    marks = np.flatnonzero((h >> np.uint32(32 - USUAL.bit_length() + 1)) == 0) + 1
    for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out, last = [], start
        for m in marks[np.searchsorted(marks, start) : np.searchsorted(marks, end)].tolist():
            while m - last > LONGEST:
                last += LONGEST
                out.append(last)
            if m - last >= SHORTEST and m < end:
                out.append(m)
                last = m
        while end - last > LONGEST:
            last += LONGEST
            out.append(last)
        if end > last:
            out.append(end)
        yield out


def _identifier(body: bytes, bits: int) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(body) & ((1 << bits) - 1)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _chunks(column: pa.Array) -> Iterator[tuple[bytes, list[bytes]]]:
    data, at = utf8(column)
    low = data[at[0] : at[-1]].tobytes().lower()  # of bytes: A-Z only
    at = at - at[0]
    for start, ends in zip(at[:-1].tolist(), cuts(np.frombuffer(low, np.uint8), at), strict=True):
        bounds = [start, *ends]
        yield low[start : bounds[-1]], [low[i:j] for i, j in zip(bounds, ends, strict=False)]


def _recipes(bits: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            shas, recipes = [], []
            for text, chunks in _chunks(batch.column("text")):
                shas.append(hashlib.sha256(text).hexdigest())
                recipes.append([x for c in chunks for x in (*_identifier(c, bits), len(c))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.int64()))], ["doc_id", "text_sha256", "recipe"])

    return run


def _bodies(bits: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            found = {(*_identifier(c, bits), c) for _, chunks in _chunks(batch.column("text")) for c in chunks}
            a, b, body = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(map(len, body), pa.int64()), pa.array(body, pa.binary())], ["id_a", "id_b", "n", "body"])

    return run


def _numbered(docs: DataFrame, clashes: DataFrame, bits: int) -> DataFrame:
    """Recipes where bodies that share an identifier are told apart by a number.
    ``clashes``: each such body with its number. Runs only after a clash, so it
    may move the bodies again."""

    def run(batches):
        number = TaskContext.get().partitionId() << 40  # rows of one task, in the order of its split
        for batch in pieces(batches, "text"):
            for doc, (text, chunks) in zip(batch.column("doc_id").to_pylist(), _chunks(batch.column("text")), strict=True):
                number += 1
                rows = [(number, doc, hashlib.sha256(text).hexdigest(), k, *_identifier(c, bits), len(c), c) for k, c in enumerate(chunks or [b""])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["row", "doc_id", "text_sha256", "k", "id_a", "id_b", "n", "body"])

    rows = docs.mapInArrow(run, "row long, doc_id long, text_sha256 string, k long, " + _BODIES)
    rows = rows.join(clashes, ["id_a", "id_b", "n", "body"], "left").withColumn("which", F.coalesce("which", F.lit(0)))
    return (
        rows.groupBy("row", "doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_list(F.struct("k", "id_a", "id_b", "n", "which"))).alias("x"))
        .select("doc_id", "text_sha256", F.flatten(F.transform("x", lambda e: F.array(e["id_a"], e["id_b"], e["n"], e["which"].cast("long")))).alias("recipe"))
    )


def exact_groups(docs: DataFrame, identifier_bits: int = 128) -> DataFrame:
    """For each document its group of texts that are equal after lower-casing A-Z.

    ``docs``: doc_id, text; other columns are left out. Returns doc_id, keep_id,
    group_size, kept, text_sha256. A null text counts as empty, and empty texts
    are equal. Every row comes back, and group_size counts rows; those that
    repeat doc_id and text of the one that stays are all marked as kept
    (``drop_exact`` leaves one). A null doc_id is smaller than any other. An empty
    table gives an empty result. ``identifier_bits`` (1 to 128) is for tests: few
    bits make clashes, which are resolved exactly.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bodies = docs.mapInArrow(_bodies(identifier_bits), _BODIES)
    clashing = bodies.groupBy("id_a", "id_b", "n", "body").agg(F.lit(1).alias("one")).groupBy("id_a", "id_b", "n").agg(F.count("one").alias("c")).where("c > 1").drop("c")
    if clashing.isEmpty():
        recipes = docs.mapInArrow(_recipes(identifier_bits), _RECIPES)
    else:
        number = Window.partitionBy("id_a", "id_b", "n").orderBy("body")
        clashes = bodies.join(clashing, ["id_a", "id_b", "n"], "left_semi").distinct().withColumn("which", F.row_number().over(number))
        recipes = _numbered(docs, clashes, identifier_bits)
    recipes = written(recipes, "recipes")  # read twice, and a hundredth of the texts
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Joined on the recipe and a hash of it: with a key of its own each side is
    # shuffled for the join, and a large group's partition can be split at run time.
    key = F.xxhash64("recipe")
    return (
        recipes.withColumn("key", key)
        .join(groups.withColumn("key", key), ["key", "recipe"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the row with the largest
    doc_id (null is the smallest), once; all columns are kept. Of rows that
    share doc_id and text one stays, whatever their other columns hold."""
    kept = exact_groups(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").cast("string").alias("id_"), F.col("text_sha256").alias("sha_"))
    kept = kept.withColumn("id_", F.coalesce("id_", F.lit("null")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumn("id_", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))).withColumn("sha_", F.sha2(lower_ascii(text), 256))
    return named.join(kept, ["id_", "sha_"], "left_semi").dropDuplicates(["id_", "sha_"]).select(*[f"`{c}`" for c in docs.columns])
