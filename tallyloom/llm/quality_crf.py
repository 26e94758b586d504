"""Document quality from a linear-chain conditional random field over lines.

Every line has two states, bad and good. A line's emission looks at its own
features and at those of the lines before and after it; transitions tie
neighbouring states. Forward-backward gives each line's probability of being
good, and the document's score is their mean weighted by line length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8
from .learning import labelled_sample, word_hashes

#: The training sample has at most so many labelled documents, dealt to shards of about SHARD.
TRAIN_ROWS, SHARD = 4_000, 1_000
STEPS, RATE, L2 = 200, 0.2, 5e-4
_KIND = np.zeros(256, np.uint8)  # 0 other mark, 1 upper, 2 lower or non-ASCII, 3 digit, 4 blank, 5 ! ? * # % & $ and the like, 6 bars of tables
_KIND[65:91], _KIND[48:58] = 1, 3
_KIND[[*range(97, 123), *range(128, 256)]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in "!?*#%&$@^~=+<>{}[]\\/_"]] = 5
_KIND[[ord(c) for c in "|\t;"]] = 6
OWN = 15
WIDTH = 3 * OWN + 3


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the lines of the texts at offsets ``at``: ``first``
    holds where each text's lines begin, one more for the end. Lines end at a line
    feed; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    # A break at a text's very end begins an empty line of that text, not of the next.
    owner = np.concatenate((np.arange(len(at) - 1), np.searchsorted(at, breaks, side="right") - 1))
    starts = np.concatenate((at[:-1], breaks + 1))
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(at)))
    ends = np.append(starts[1:] - 1, at[-1])
    ends[first[1:] - 1] = at[1:]
    return starts, ends, first


def own_features(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The ``OWN`` features of each line, one column after the other."""
    n = (ends - starts).astype(np.float64)
    kind = _KIND[data]

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.int32), np.cumsum(flags, dtype=np.int32)))
        return (sums[ends] - sums[starts]) / np.maximum(n, 1)

    yield share(kind == 0)
    upper = share(kind == 1)
    yield upper
    letters = share((kind == 1) | (kind == 2))
    yield letters
    yield share(kind == 3)
    yield share(kind == 4)
    yield share(kind == 5)
    yield upper / np.maximum(letters, 1e-3)
    w_start, w_end, h = word_hashes(data, at)
    line = np.searchsorted(starts, w_start, side="right") - 1  # of lines that begin at the same byte only the last has words
    words = np.bincount(line, minlength=len(starts)).astype(np.float64) if len(line) else np.zeros(len(starts))
    per_word = lambda at_line, weight: np.bincount(at_line, weight, len(starts)) / np.maximum(words, 1) if len(line) else np.zeros(len(starts))
    yield per_word(line, w_end - w_start) / 10
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    yield per_word(line, same)
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    yield np.where(words > 0, per_word(line[order], new), 1) ** 2
    yield np.log1p(words) / 5
    yield np.log1p(n) / 7
    yield (n == 0).astype(np.float64)
    tail = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8)
    yield ((n > 0) & np.isin(tail, [ord(c) for c in ".!?:;"])).astype(np.float64)
    yield share(kind == 6)


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, first) of the lines: a line's own features, those of the
    lines before and after it in its text, whether it is the first or last, and 1.
    For training, whose texts are a bounded sample."""
    starts, ends, first = lines_of(data, at)
    f = np.stack(list(own_features(data, at, starts, ends)), axis=1)
    final = first[1:] - 1
    x = np.zeros((len(starts), WIDTH))
    x[:, :OWN] = f
    x[1:, OWN : 2 * OWN] = f[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = f[1:]
    x[first[:-1], OWN : 2 * OWN] = 0
    x[final, 2 * OWN : 3 * OWN] = 0
    x[first[:-1], 3 * OWN] = 1
    x[final, 3 * OWN + 1] = 1
    x[:, 3 * OWN + 2] = 1
    return x, (ends - starts).astype(np.float64), first


def emissions(data: np.ndarray, at: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(emission, lengths, first): ``line_features`` times the emission weights. A
    column is added up as it is made and then dropped, so a line takes a few
    numbers however many features there are."""
    starts, ends, first = lines_of(data, at)
    own, before, after = (np.zeros(len(starts)) for _ in range(3))
    for k, column in enumerate(own_features(data, at, starts, ends)):
        own += theta[k] * column
        before += theta[OWN + k] * column
        after += theta[2 * OWN + k] * column
    own[1:] += before[:-1]
    own[first[1:-1]] -= before[first[1:-1] - 1]  # a text's first line has none before it
    final = first[1:] - 1
    own[:-1] += after[1:]
    own[final[:-1]] -= after[final[:-1] + 1]
    own[first[:-1]] += theta[3 * OWN]
    own[final] += theta[3 * OWN + 1]
    return own + theta[3 * OWN + 2], (ends - starts).astype(np.float64), first


def forward_backward(emission: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line the probability of good, the summed probabilities of each
    transition, and the log partition of each text. ``emission``: log weight of
    good against bad; ``step``: log weights of transitions (2 x 2). Texts go
    through in step, longest first, so that each position is one vector operation."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, begin = sizes[order], first[:-1][order]
    e = np.exp(np.clip(emission, -30, 30))
    m = np.exp(step)
    lines, longest = len(emission), int(sizes.max())
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts of more than t lines
    alpha, beta = np.empty((lines, 2)), np.ones((lines, 2))
    log_z = np.zeros(len(sizes))
    for t in range(longest):
        k = active[t]
        i = begin[:k] + t
        a = np.ones((k, 2)) if t == 0 else alpha[i - 1] @ m
        a[:, 1] *= e[i]
        z = a.sum(1)
        log_z[:k] += np.log(z)
        alpha[i] = a / z[:, None]
    for t in range(longest - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        b = beta[i + 1].copy()
        b[:, 1] *= e[i + 1]
        b = b @ m.T
        beta[i] = b / b.sum(1)[:, None]
    good = alpha * beta
    good = good[:, 1] / good.sum(1)
    inner = np.ones(lines, bool)
    inner[first[:-1]] = False
    i = np.flatnonzero(inner)
    right = beta[i].copy()
    right[:, 1] *= e[i]
    pair = alpha[i - 1][:, :, None] * m[None] * right[:, None, :]
    pair /= np.maximum(pair.sum((1, 2)), 1e-300)[:, None, None]
    out = np.empty(len(sizes))
    out[order] = log_z
    return good, pair.sum(0), out


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Parameters (emission weights, then the transitions) that maximise the
    likelihood of the documents' labels, each line having its document's; Adam
    on the whole shard, each document weighing the same per line."""
    sizes = np.diff(first)
    target = np.repeat(label, sizes).astype(np.float64)
    seen = np.array([[(sizes[label == 0] - 1).sum(), 0], [0, (sizes[label == 1] - 1).sum()]], np.float64)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    total = float(len(target))
    for t in range(1, steps + 1):
        good, pairs, _ = forward_backward(x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2), first)
        g = np.concatenate(((target - good) @ x, (seen - pairs).ravel())) / total
        g -= L2 * theta * np.append(np.full(WIDTH, 0.1), np.full(4, 10.0))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - 0.9 * t / steps)
    return theta


def document_scores(data: np.ndarray, at: np.ndarray, theta: np.ndarray) -> np.ndarray:
    emission, n, first = emissions(data, at, theta)
    good, _, _ = forward_backward(emission, theta[WIDTH:].reshape(2, 2), first)
    weight = n + 1
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def train(sample: DataFrame, shard_rows: int = SHARD) -> np.ndarray | None:
    """The mean of the parameters that shards of ``sample`` (doc_id, text,
    label) learn on their own; None without a sample."""
    rows = sample.count()
    if not rows:
        return None
    shards = max(1, math.ceil(rows / shard_rows))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        data, at = utf8(pa.array(pdf["text"].tolist(), pa.string()))
        x, _, first = line_features(data, at)
        return pd.DataFrame({"k": np.arange(WIDTH + 4), "value": fit(x, first, pdf["label"].to_numpy())})

    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    parts = dealt.groupBy("shard").applyInPandas(shard, "k int, value double").groupBy("k").agg(F.avg("value").alias("value"))
    return parts.orderBy("k").toPandas()["value"].to_numpy()


def quality(docs: DataFrame, labels: DataFrame, train_if: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs`` (doc_id, text; other
    columns are left out): the score of a text is the length-weighted mean of
    its lines' probabilities of being good.

    Learns from at most ``rows`` rows of ``labels`` (doc_id, quality) for which
    ``train_if`` holds; without any, every score is 0.5. A null or empty text is
    one empty line. Repeated rows come back as often.
    """
    theta = train(labelled_sample(docs, labels, "quality", train_if, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            if theta is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                data, at = utf8(batch.column("text"))
                scores = document_scores(data[at[0] : at[-1]], at - at[0], theta)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.clip(scores, 0, 1))], ["doc_id", "score"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, train_if: Column) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their
    columns. Whether a text stays depends on the text, so the score is computed
    beside the row and nothing is joined."""
    theta = train(labelled_sample(docs, labels, "quality", train_if, TRAIN_ROWS))
    if theta is None:
        return docs
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            data, at = utf8(batch.column("text"))
            yield batch.filter(pa.array(document_scores(data[at[0] : at[-1]], at - at[0], theta) >= 0.5))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, docs.schema)
