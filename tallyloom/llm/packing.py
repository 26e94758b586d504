"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A sequence is filled greedily with the longest pieces that fit; then its
shortest piece gives way to two unpacked ones that fill the wider gap more
tightly, if there are such. How a sequence is filled depends on nothing but how
many pieces of each length are left, so the filling is planned on the histogram
of lengths (as many rows as a sequence has tokens at most), and the same filling
is repeated while the counts last: that is what filling one sequence after
another gives. Pieces are then numbered within their length and find their place
in the plan by that number, each in its own task; no sequence is put together
before it is asked for (``sequences``).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, written

MOST, END = 1024, 2
#: Pieces up to this part of a sequence may be held back for the end; the plan
#: of the fewest sequences is taken (of those the first).
HELD = (0, 6, 12)
#: A space that stands alone between two other characters begins a slice, whatever surrounds it.
_LONE = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how byte-level vocabularies of this family split text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every version of Unicode puts in the same class: the libraries' tables can't differ on them.
_OTHER = re.compile("[^\t\n\r -~\u00a1-\u024f\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u2010-\u2027\u3001\u3002\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]")
#: Runs without a space, and of white space, that one search of the split pattern gets.
LONG_WORD, LONG_SPACE = 10_000, 500
_IDS = "ids array<int>"


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    ones stand for themselves, the others follow from 256 on in their order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)}.difference(own)))}


class Encoder:
    """Ids by a tokenizer file of the tokenizers library. Where the file is plain
    byte-level BPE whose ids follow its merges, text of undisputed characters is
    merged by those ranks (tiktoken), several times faster; all other text goes
    through the library, in slices between lone spaces, which no token crosses."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = self._by_ranks()

    def _by_ranks(self):
        import tiktoken

        form = json.loads(self.tokenizer.to_str())
        model, split = form["model"], form["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not (plain and level) or form["normalizer"] or form["truncation"] or form["padding"] or not all(t["special"] for t in form["added_tokens"]):
            return None
        letters, special = _letters(), {t["content"] for t in form["added_tokens"]}
        tokens = {t: i for t, i in model["vocab"].items() if t not in special}
        merged = [tokens["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(c not in letters for t in tokens for c in t) or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 != len(tokens):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in tokens.items()}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4")

    def _undisputed(self, text: str) -> bool:
        words = text.split()
        return not _OTHER.search(text) and max(map(len, words), default=0) <= LONG_WORD and len(text) - sum(map(len, words)) - len(words) < LONG_SPACE

    def encode(self, text: str) -> np.ndarray:
        if self.fast and self._undisputed(text):
            return np.array(self.fast.encode_ordinary(text), "<i4")
        out, first = [np.zeros(0, "<i4")], True
        for fast, parts in groupby(_LONE.split(text), lambda x: self.fast is not None and self._undisputed(x)):
            run = ("" if first else " ") + " ".join(parts)
            out.append(np.array(self.fast.encode_ordinary(run), "<i4") if fast else self._library(run))
            first = False
        return np.concatenate(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _ENCODERS[path]


def cut(docs: DataFrame, tokenizer: str, most: int = MOST, end: int = END, keep_ids: bool = True) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text; other columns are left
    out): doc_id, piece (from 0), start, length, ids, or without ``keep_ids``
    ids_crc32 (of the ids as little-endian unsigned 32-bit numbers); part and
    nth number the pieces of one length within a task. A document's ids end with
    ``end``; a null or empty text has that id alone. Longer ones than ``most``
    are cut so that all pieces but the first have ``most`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        for batch in pieces(batches, "text"):
            ids = [np.append(encode(t or ""), np.int32(end)) for t in batch.column("text").to_pylist()]
            total = np.array([len(x) for x in ids])
            count = -(-total // most)
            row = np.repeat(np.arange(len(ids)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = total - most * (count - 1)
            start = np.where(piece == 0, 0, first[row] + most * (piece - 1))
            length = np.where(piece == 0, first[row], most)
            order = np.argsort(length, kind="stable")
            among = np.empty(len(row), np.int64)
            among[order] = np.arange(len(row)) - np.searchsorted(length[order], length[order])
            nth = seen[length] + among
            seen += np.bincount(length, minlength=most + 1)
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "part": pa.array(np.full(len(row), part), pa.int32()), "nth": pa.array(nth),
            }
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(np.concatenate(ids)))
            else:
                out["ids_crc32"] = pa.array([zlib.crc32(ids[r][s : s + n].tobytes()) for r, s, n in zip(row, start, length, strict=True)], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, piece int, start long, length long, part int, nth long, {_IDS if keep_ids else 'ids_crc32 long'}")


def _fill(left: np.ndarray, most: int) -> dict[int, int]:
    """How the next sequence is filled (length: how often) when ``left`` pieces
    of each length are unpacked."""
    chosen: dict[int, int] = {}
    gap = most
    for n in np.flatnonzero(left)[::-1].tolist():
        if times := min(int(left[n]), gap // n):
            chosen[n] = times
            gap -= times * n
        if not gap:
            return chosen
    if sum(chosen.values()) < 2:
        return chosen
    shortest = min(chosen)
    free = left.copy()
    for n, times in chosen.items():
        free[n] -= times
    have = np.where(free > 0, np.arange(len(free)), 0)
    upto = np.maximum.accumulate(have)  # the longest unpacked one of at most so many ids
    a = np.flatnonzero(free)
    b = np.minimum(a, shortest + gap - a)
    a, b = a[b > 0], b[b > 0]
    if not len(a):
        return chosen
    other = upto[b]
    alone = (other == a) & (free[a] < 2)
    other = np.where(alone, upto[np.maximum(a - 1, 0)], other)
    sums = np.where(other > 0, a + other, 0)
    best = int(len(sums) - 1 - np.argmax(sums[::-1]))
    if sums[best] > shortest:
        chosen[shortest] -= 1
        for n in (int(a[best]), int(other[best])):
            chosen[n] = chosen.get(n, 0) + 1
    return {n: times for n, times in chosen.items() if times}


def _fillings(counts: np.ndarray, held: int) -> list[tuple[dict[int, int], int]]:
    """(filling, how many sequences in a row have it), for ``counts`` pieces of
    each length. Those of up to ``held`` ids only enter once a sequence of the
    others is filled, and fill what it leaves."""
    most, left, out = len(counts) - 1, counts.astype(np.int64), []
    small = np.arange(len(left)) <= held
    while left.any():
        long = np.where(small, 0, left)
        filling = _fill(long if long.any() else left, most)
        if held and long.any():
            gap = most - sum(n * t for n, t in filling.items())
            for n in range(min(held, gap), 0, -1):
                if times := min(int(left[n]), gap // n):
                    filling[n] = times
                    gap -= times * n
        times = min(int(left[n]) // t for n, t in filling.items())
        for n, t in filling.items():
            left[n] -= t * times
        out.append((filling, times))
    return out


def plan(counts: np.ndarray) -> np.ndarray:
    """Where the pieces go, given how many there are of each length (``counts``:
    by length, from 0 to the longest allowed): rows (length, first, each,
    sequence, offset) sorted by length and first. Pieces number ``first`` and
    after of a length go to sequence ``sequence`` and after, ``each`` to a
    sequence, from ``offset`` there."""
    most = len(counts) - 1
    chosen = min((_fillings(counts, most // part if part else 0) for part in HELD), key=lambda x: sum(t for _, t in x))
    used, rows, sequence = np.zeros(most + 1, np.int64), [], 0
    for filling, times in chosen:
        offset = 0
        for n, each in sorted(filling.items(), reverse=True):
            rows.append((n, used[n], each, sequence, offset))
            used[n] += each * times
            offset += n * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(cut_pieces: DataFrame, most: int = MOST) -> DataFrame:
    """``cut_pieces`` (written, with length, part and nth as ``cut`` gives them)
    with sequence_id and offset instead of part and nth. What is joined to the
    pieces is a row for each task and length; the plan that every task gets has
    at most a row for each sequence filling and length in it, however many
    pieces there are."""
    counts = cut_pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    histogram = np.zeros(most + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():  # ``most`` rows at most
        histogram[row["length"]] = row["n"]
    steps = plan(histogram)
    key = (steps[:, 0] << 44) + steps[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            n, first, each, sequence, offset = steps[np.searchsorted(key, (length << 44) + rank, side="right") - 1].T
            at = rank - first
            kept = {c: batch.column(c) for c in kept_columns}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence + at // each), "offset": pa.array(offset + n * (at % each))})

    kept_columns = [c for c in cut_pieces.columns if c not in ("part", "nth")]
    ranked = cut_pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth")).select(*kept_columns, "rank")
    kinds = ", ".join(f"{c} {cut_pieces.schema[c].dataType.simpleString()}" for c in kept_columns)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, most: int = MOST, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id, text) and where it is
    packed: doc_id, piece, start, length, ids (or ids_crc32, see ``cut``),
    sequence_id, offset. No sequence has more than ``most`` ids or a hole.

    ``tokenizer``: a file of the tokenizers library that every executor finds at
    that path or under its name among the session's files. Null texts count as
    empty; rows that repeat a doc_id, or have none, are packed each for itself;
    an empty table gives no rows. Tasks number their pieces, so which of two
    pieces of one length goes where depends on how the input is split; how many
    sequences there are doesn't.
    """
    return place(written(cut(docs, tokenizer, most, end, keep_ids), "pieces"), most)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, lengths (of its pieces, in order) from what ``pack`` gave."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).selectExpr("sequence_id", "flatten(p.ids) as ids", "p.length as lengths")
