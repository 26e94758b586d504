"""What the two classifiers share: their bounded training sample, and word hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents for which
    ``train`` (a condition on doc_id) holds, chosen by a hash of doc_id. The
    choice has at most ``rows`` rows, so it is broadcast to the documents. Of
    documents that share a doc_id the smallest text is taken."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & train)
        .groupBy(F.col("doc_id").cast("long").alias("chosen_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("chosen_id"), "chosen_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _spans_hashed(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """For each of ``ends`` the hashes of the byte spans that begin at ``starts``:
    prefix sums of a polynomial give all of them at once."""
    n = len(data)
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((_ODD, _INVERSE)):
            p = np.full(n + (1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[data] + np.uint64(1)) * _POWERS[0][:n])))
    return [mixed((prefix[e] - prefix[starts]) * _POWERS[1][starts]) for e in ends]


def stem_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Of words (``starts``, ``ends``) the hashes of their first so many
    characters, for each of ``lengths``; a shorter word is its own stem."""
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), np.full(max(lengths) + 1, len(data)))
    first = np.searchsorted(lead, starts)
    return _spans_hashed(data, starts, *[np.minimum(ends, lead[np.minimum(first + k, len(lead) - 1)]) for k in lengths])


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts at offsets ``at`` in ``data``: for every word (letters,
    digits, bytes above 127; A-Z lowered) its start, its end and its hash."""
    n = len(data)
    letter = _LETTER[data]
    before = np.concatenate(([False], letter[:-1]))
    begins = at[(at < n)]
    before[begins] = False
    starts = np.flatnonzero(letter & ~before)
    after = np.concatenate((letter[1:], [False]))
    last = at[(at > 0) & (at <= n)] - 1
    after[last] = False
    ends = np.flatnonzero(letter & ~after) + 1
    return starts, ends, _spans_hashed(data, starts, ends)[0]
