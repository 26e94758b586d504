"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features are hashed words, word pairs and triples, skip-grams (one word left
out) and, so that inflected forms share a weight, the beginnings of words.
FTRL-proximal keeps a learning rate per coordinate and its L1 term sets most
weights to exactly zero, so that the model is a few rows (index, weight) which
every scoring task gets.
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
from .learning import labelled_sample, mixed, stem_hashes, word_hashes

BITS = 20
#: Characters of the beginnings of words.
STEMS = (4, 6, 8)
#: The training sample has at most so many labelled rows, dealt to shards of about SHARD rows.
TRAIN_ROWS, SHARD = 24_000, 12_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 1.0, 6


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, feature index) for the n-grams, skip-grams and stems of all texts."""
    starts, ends, h = word_hashes(data, at)
    doc = np.searchsorted(at, starts, side="right") - 1
    docs, found = [doc], [h]
    for k, stem in zip(STEMS, stem_hashes(data, starts, ends, STEMS), strict=True):
        docs.append(doc)
        found.append(mixed(stem + np.uint64(k)))
    for step, salt in ((1, 1), (2, 2)):
        if len(h) > step:
            same = doc[:-step] == doc[step:]
            pair = mixed(h[:-step] * np.uint64(3 + 2 * salt) + h[step:] + np.uint64(salt))
            docs.append(doc[:-step][same])
            found.append(pair[same])
    if len(h) > 2:
        same = doc[:-2] == doc[2:]
        three = mixed(mixed(h[:-2] * np.uint64(11) + h[1:-1]) * np.uint64(13) + h[2:])
        docs.append(doc[:-2][same])
        found.append(three[same])
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over (distinct feature indices, label)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        return w

    for _ in range(epochs):
        for index, label in examples:
            i = np.append(index, size)  # the bias is a coordinate that every example has
            w = weights(i)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], float(w[size])


def _examples(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the distinct feature indices."""
    out: list[np.ndarray] = []
    for batch in pieces([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], "text", 1 << 19):
        doc, index = features(*_whole(batch))
        both = np.unique((doc << BITS) | index)
        parts = np.split((both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(1, batch.num_rows)))
        out += [x.copy() for x in parts]
    return out


def _whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(batch.column("text"))
    return data[at[0] : at[-1]], at - at[0]


def train(sample: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """index, weight (index 2^BITS: the bias) from ``sample`` (doc_id, text,
    label): each shard trains alone in an order fixed by a hash of doc_id, and
    the shards' weights are averaged. A sample of one label gives its bias."""
    rows = sample.count()
    shards = max(1, round(rows / shard_rows))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"])[["text", "label"]]
        w, bias = ftrl(list(zip(_examples(pdf["text"].tolist()), pdf["label"].tolist(), strict=True)))
        at = np.flatnonzero(w)
        return pd.DataFrame({"index": np.append(at, 1 << BITS), "weight": np.append(w[at], bias)})

    dealt = sample.withColumn("order", F.xxhash64("doc_id")).withColumn("shard", F.pmod(F.col("order"), F.lit(shards)))
    out = dealt.groupBy("shard").applyInPandas(shard, "index long, weight double")
    return out.groupBy("index").agg((F.sum("weight") / shards).alias("weight"))


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, score for each row of ``docs`` (doc_id, text). The model is
    collected: it has at most 2^BITS + 1 rows, and L1 leaves far fewer."""
    known = model.orderBy("index").toPandas()
    index, weight = known["index"].to_numpy(np.int64), known["weight"].to_numpy(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1, np.float32)
        w[index] = weight
        bias = float(weight[index == 1 << BITS].sum())
        for batch in pieces(batches, "text"):
            doc, found = features(*_whole(batch))
            hit = w[found] != 0
            both = np.unique((doc[hit] << BITS) | found[hit])
            sums = np.bincount(both >> BITS, w[both & ((1 << BITS) - 1)], batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, train_if: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs`` (doc_id, text; other
    columns are left out): the score of a text is its probability of being toxic.

    Learns from at most ``rows`` rows of ``labels`` (doc_id, toxic) for which
    ``train_if`` holds. Null and empty texts get the score of no features; so
    does every text if there are no labels (then 0.5). Repeated rows come back
    as often; a document labelled twice counts as toxic if either label says so.
    """
    model = train(labelled_sample(docs, labels, "toxic", train_if, rows))
    return score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
