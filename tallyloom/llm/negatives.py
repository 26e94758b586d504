"""Hard negatives by bit-sliced integer products.

Every anchor is compared with all rows, a block of anchors after the other: a
block is broadcast (its size is a parameter) and the rows are read where they
lie. A row's components are cut into bit planes, the most significant first.
After each plane the score lies in an interval as wide as what the planes to come
can add; pairs whose interval no longer reaches what they would have to beat are
dropped, and only the others see the next plane. What is left after the last
plane has its exact score.

What there is to beat is known early: rows are dealt by a hash to shells of
which each is eight times the one before. A shell is compared against the best
of the smaller ones, so few rows of any shell leave a task, and each row is
compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import integers
from .common import folder, written

POSITIVES, NEGATIVES, LOW, HIGH, OUT_OF = 5, 10, 30, 90, 100
#: Anchors that are broadcast at once, and rows of the first shell.
BLOCK, FIRST_SHELL, SHELL = 8192, 4096, 8
_ANCHORS, _ROWS = 128, 2048
#: Below this part of all pairs the rest are followed one by one.
_SPARSE = 1 / 16
_FAR = 1 << 62
_FOUND = "anchor_id long, window int, score long, vec_id long"
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Block:
    """Anchors (sorted by label), and for each the windows that scores may fall
    in: ``low`` and ``high`` with a column for each window, ``beat`` the score of
    the last of ``k`` found there so far."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same: bool
    k: int
    low: np.ndarray
    high: np.ndarray
    beat: np.ndarray


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None] < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def planes(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, bits) of each bit plane of ``x`` in two's complement, the most
    significant first; its weight is negative."""
    top = max(int(x.max(initial=0)).bit_length(), int(~x.min(initial=0)).bit_length())
    return [((-1 if j == top else 1) << j, (x >> j) & 1) for j in range(top, -1, -1)]


def qualifying(x: np.ndarray, sliced: list[tuple[int, np.ndarray]], anchors: np.ndarray, pairs: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, anchors and scores of the ``pairs`` (a mask, rows by anchors) whose
    product may lie in one of the anchor's windows, and how many plane products
    of a pair were taken. ``sliced``: the planes of ``x``."""
    largest = int(np.abs(x).max(initial=0)) + 1
    kind = np.float64 if int(np.abs(anchors).sum(1).max(initial=0)) * largest * 2 < 1 << 53 else np.int64  # floats are exact up to there
    a = anchors.astype(kind)
    plus, minus = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)  # what a plane of weight one adds at most and at least
    floor, ceiling = low.min(1), high.max(1)
    so_far, active, taken = np.zeros(pairs.shape, kind), pairs.copy(), 0
    row = anchor = score = None
    for weight, bits in sliced:
        rest = abs(weight) - 1  # of all planes to come
        if row is None:
            so_far += weight * (bits.astype(kind) @ a.T)
            taken += active.size
            active &= (so_far + rest * plus >= floor) & (so_far + rest * minus <= ceiling)
            if np.count_nonzero(active) < _SPARSE * active.size:
                row, anchor = np.nonzero(active)
                score = so_far[row, anchor]
        else:
            score = score + weight * np.einsum("pi,pi->p", bits[row], anchors[anchor])
            taken += len(row)
        if row is not None:
            stays = np.zeros(len(row), bool)
            for w in range(low.shape[1]):
                stays |= (score + rest * plus[anchor] >= low[anchor, w]) & (score + rest * minus[anchor] <= high[anchor, w])
            row, anchor, score = row[stays], anchor[stays], score[stays]
    if row is None:
        row, anchor = np.nonzero(active)
        score = so_far[row, anchor]
    return row, anchor, score.astype(np.int64), taken


def _first(k: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of (anchor, window, score, vec_id) the ``k`` best of each anchor and window."""
    anchor, window, score, vec_id = columns
    order = np.lexsort((vec_id, -score, window, anchor))
    anchor, window, score, vec_id = (c[order] for c in columns)
    begins = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])))) if len(anchor) else np.zeros(0, np.int64)
    rank = np.arange(len(anchor)) - np.repeat(begins, np.diff(np.append(begins, len(anchor))))
    keep = rank < k
    return anchor[keep], window[keep], score[keep], vec_id[keep]


def compared(rows: DataFrame, block: Block) -> DataFrame:
    """anchor_id, window, score, vec_id: of ``rows`` (vec_id, label, v) the best
    ``k`` of each task for each anchor and window of ``block``."""
    width, n = block.vectors.shape[1], len(block.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.maximum(block.low, block.beat)
        found = {i: tuple(np.zeros(0, np.int64) for _ in range(4)) for i in range(0, n, _ANCHORS)}
        for batch in batches:
            for j in range(0, batch.num_rows, _ROWS):
                part = batch.slice(j, _ROWS)
                ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                every = vectors_of(part.column("v"), width)
                every_sliced = planes(every)
                for i, before in found.items():
                    here = slice(i, i + _ANCHORS)
                    at = np.flatnonzero(np.isin(labels, block.labels[here])) if block.same else np.arange(len(ids))
                    pairs = ((labels[at][:, None] == block.labels[here][None]) == block.same) & (ids[at][:, None] != block.ids[here][None])
                    if not pairs.any():
                        continue
                    x, sliced = (every, every_sliced) if len(at) == len(ids) else (every[at], [(w, b[at]) for w, b in every_sliced])
                    row, anchor, score, _ = qualifying(x, sliced, block.vectors[here], pairs, low[here], block.high[here])
                    hit, window = np.nonzero((score[:, None] >= low[here][anchor]) & (score[:, None] <= block.high[here][anchor]))
                    if not len(hit):
                        continue
                    new = (anchor[hit] + i, window, score[hit], ids[at][row[hit]])
                    found[i] = best = _first(block.k, *(np.concatenate(c) for c in zip(before, new, strict=True)))
                    last = np.flatnonzero(np.concatenate(((best[0][1:] != best[0][:-1]) | (best[1][1:] != best[1][:-1]), [True])))
                    full = last[np.diff(last, prepend=-1) == block.k]
                    low[best[0][full], best[1][full]] = np.maximum(low[best[0][full], best[1][full]], best[2][full])
        for anchor, window, score, vec_id in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[anchor]), pa.array(window, pa.int32()), pa.array(score), pa.array(vec_id)], ["anchor_id", "window", "score", "vec_id"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, _FOUND)


def _best(rows: DataFrame, shells: list[str], block: Block) -> DataFrame:
    """anchor_id, window, rank, vec_id, score: the ``k`` best of all ``rows``,
    one of ``shells`` (conditions) after the other."""
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    at = {int(i): n for n, i in enumerate(block.ids)}
    best = None
    for shell in shells:
        if best is not None:
            last = best.groupBy("anchor_id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == block.k)
            for r in last.toLocalIterator():  # a row for each anchor of the block and window
                block.beat[at[r["anchor_id"]], r["window"]] = r["score"]
        found = compared(rows.where(shell), block)
        found = found if best is None else found.union(best.select("anchor_id", "window", "score", "vec_id"))
        best = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block.k), "best")
    return best


def _block(anchors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = anchors.orderBy("label", "vec_id").toArrow()  # about BLOCK rows
    return rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), vectors_of(rows.column("v"), width)


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, first_shell: int = FIRST_SHELL) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for each anchor (a row of ``embeddings`` (vec_id, embedding, label; other
    columns are left out) for which ``is_anchor``, of vec_id, holds) and each of
    the ``positives`` best rows of its label the ``negatives`` best rows of
    another label that score between ``low`` and ``high`` hundredths of the
    positive. A score is the product of the vectors as ``integers`` has them;
    ties go to the smaller vec_id.

    Rows without an id or label, or with a vector that ``integers`` leaves out,
    take no part, nor do those with components so large that a score might pass
    2^56. A shorter vector counts as if it ended in zeros. Rows that repeat a
    vec_id are candidates each for itself, but never for their own id; of
    anchors that share one the smallest (label, vector) counts. Positives that
    score below zero have no negatives. No anchors give an empty table.
    """
    spark = embeddings.sparkSession
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id is not null and label is not null")
    width = max(ids.agg(F.max(F.size("embedding"))).first()[0] or 1, 1)
    uniform = (F.pmod(F.xxhash64("vec_id", F.lit("shell")), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    depth = F.least(F.floor(-F.ln(uniform) / math.log(SHELL)), F.lit(12)).cast("int")
    rows = written(integers(ids, None, largest=math.isqrt((1 << 56) // width)).withColumn("depth", depth), "integers", by="depth")
    sizes = {r["depth"]: r["n"] for r in rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = next((d for d in range(12, 0, -1) if sum(n for x, n in sizes.items() if x >= d) >= first_shell), 0)
    shells = [f"depth >= {small}", *(f"depth = {d}" for d in range(small - 1, -1, -1))]
    anchors = written(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v"), "anchors")
    blocks = -(-anchors.count() // block)
    out = folder(spark, "negatives")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    for i in range(max(blocks, 1)):
        a = _block(anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1))) == i), width)
        open_ended = [np.full((len(a[0]), 1), x, np.int64) for x in (-_FAR, _FAR, -_FAR)]
        near = _best(rows, shells, Block(*a, True, positives, *open_ended)).select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        lows, highs = np.full((len(a[0]), positives), _FAR, np.int64), np.full((len(a[0]), positives), -_FAR, np.int64)
        at = {int(v): n for n, v in enumerate(a[0])}
        for r in near.toLocalIterator():  # ``positives`` rows for each anchor of the block
            score, place = r["positive_score"], (at[r["anchor_id"]], r["window"])
            lows[place], highs[place] = -(-low * score // OUT_OF), high * score // OUT_OF
        hard = _best(rows, shells, Block(*a, False, negatives, lows, highs, np.full_like(lows, -_FAR)))
        hard.join(near, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/block={i}", compression="zstd")
    return spark.read.schema(_MINED + ", block int").parquet(out).drop("block")
