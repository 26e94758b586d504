"""The figures of the README that the check tool doesn't give:

    python -m tallyloom.llm.measure repeats|planted|recall|packing|held_out FOLDER

``repeats`` holds op3 against the hash of every 400-byte window, ``planted`` against
passages of 51 to 100 words put into documents that lose nothing, ``recall`` op7
against all distances, ``packing`` op12 against the least possible number of
sequences, ``held_out`` the classifiers against labels that they didn't learn from.
Each compares in one process and is meant for folders of up to a gigabyte.
"""

from __future__ import annotations

import hashlib
import json
import random
import sys
import tempfile
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .common import table, utf8
from .registry import queries

LENGTH, ODD = 400, 0x9E3779B97F4A7C15


def window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every ``LENGTH`` bytes that follow each other: two polynomials
    modulo 2^64, each multiplied by the inverse power of its place, mixed."""
    n = len(data) - LENGTH + 1
    out = np.zeros(max(n, 0), np.uint64)
    for base in (ODD, 0xBF58476D1CE4E5B9) if n > 0 else ():
        powers = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(len(data), b, np.uint64)
            p[0] = 1
            powers.append(np.cumprod(p))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0])))
        h = (sums[LENGTH:] - sums[:n]) * powers[1][:n]
        out = (out ^ h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return out


def repeats(spark: SparkSession, folder: str) -> dict:
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").cast("string").alias("text")).toArrow()
    data, at = utf8(docs.column("text"))
    texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    by_text = {}
    for t in texts:
        by_text.setdefault(t.tobytes(), None)
    hashes = {k: window_hashes(np.frombuffer(k, np.uint8)) for k in by_text}
    every = np.concatenate([hashes[t.tobytes()] for t in texts] or [np.zeros(0, np.uint64)])
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    want = {}
    for k, h in hashes.items():
        gone = np.zeros(len(k) + 1, np.int32)
        found = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h) if len(twice) else np.zeros(0, np.int64)
        np.add.at(gone, found, 1)
        np.add.at(gone, found + LENGTH, -1)
        covered = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
        kept = np.frombuffer(k, np.uint8)[~covered].tobytes()
        want[k] = (len(k), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    expected = sorted((i, *want[t.tobytes()]) for i, t in zip(docs.column("doc_id").to_pylist(), texts, strict=True))
    got = sorted(map(tuple, queries()["op3_suffix_repeats"](spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    return {"documents": len(got), "differ": sum(a != b for a, b in zip(got, expected, strict=True)), "bytes removed": sum(r[2] for r in got)}


def planted(spark: SparkSession, folder: str) -> dict:
    def removed(at: str) -> dict[int, int]:
        return {r.doc_id: r.n_removed for r in queries()["op3_suffix_repeats"](spark, at).select("doc_id", "n_removed").collect()}

    before = removed(folder)
    ids, texts = table(spark, folder, "documents").select("doc_id", F.col("text").cast("string").alias("text")).toArrow().to_pydict().values()
    r = random.Random(11)
    words = [w for t in r.sample(texts, min(len(texts), 3000)) for w in (t or "").split() if len(w) < 20]
    free = [i for i, d in enumerate(ids) if before[d] == 0 and len((texts[i] or "").split()) >= 20]
    r.shuffle(free)
    holders = {}  # words of the passage, bytes that both documents share
    for n in [*range(51, 101)] * max(1, len(free) // 2000):
        passage, sides = " ".join(r.choice(words) for _ in range(n)), []
        pair = [free.pop(), free.pop()]
        for i in pair:
            own = texts[i].split(" ")
            k = r.randint(0, len(own))
            left, right = "".join(w + " " for w in own[:k]), "".join(" " + w for w in own[k:])
            texts[i] = left + passage + right
            sides.append((left.encode()[::-1], right.encode()))
        shared = len(passage.encode()) + sum(len(commonprefix(side)) for side in zip(*sides, strict=True))
        holders |= {ids[i]: (n, shared) for i in pair}
    with tempfile.TemporaryDirectory(prefix="spark-") as at:
        pq.write_table(pa.table({"doc_id": ids, "text": texts}), f"{at}/documents.parquet", row_group_size=2000)
        after = removed(at)
    out = {"documents": len(after), "by words": {}}
    for a in range(51, 101, 10):
        some = [(shared, after[d]) for d, (n, shared) in holders.items() if a <= n < a + 10]
        out["by words"][f"{a} to {a + 9}"] = {"holders": len(some), "share 400 bytes": sum(s >= LENGTH for s, _ in some), "caught": sum(g > 0 for _, g in some), "exact": sum(g == s * (s >= LENGTH) for s, g in some)}
    clean = [d for d, g in before.items() if g == 0 and d not in holders]
    others = [d for d, g in before.items() if g]
    return out | {"clean": len(clean), "left alone": sum(after[d] == 0 for d in clean), "others": len(others), "as before": sum(after[d] == before[d] for d in others)}


def recall(spark: SparkSession, folder: str) -> dict:
    rows = table(spark, folder, "embeddings").where("embedding is not null").orderBy("vec_id").toArrow()
    ids, x = rows.column("vec_id").to_numpy(), rows.column("embedding").combine_chunks().flatten().to_numpy().astype(float).reshape(len(rows), -1)
    found = {}
    for r in queries()["op7_nn_descent"](spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in found:
        d = ((x - x[np.searchsorted(ids, q)]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(found[q] & {*ids[np.lexsort((ids, d))[:10]].tolist()})
    return {"queries": len(found), "recall": hits / (10 * len(found))}


def packing(spark: SparkSession, folder: str) -> dict:
    rows = queries()["op12_best_two_fit"](spark, folder).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    n, tokens, fullest = rows.agg(F.count("n"), F.sum("n"), F.max("n")).first()
    return {"sequences": n, "least possible": -(-tokens // 1024), "tokens": tokens, "fullest": fullest}


def held_out(spark: SparkSession, folder: str) -> dict:
    out = {}
    labels = table(spark, folder, "labels")
    for name, label in (("op2_toxicity_ftrl", "toxic"), ("op9_quality_crf", "quality")):
        rows = queries()[name](spark, folder).where("held_out").join(labels.select("doc_id", F.col(label).alias("y")).where("y is not null"), "doc_id").select("score", "predicted", "y").toPandas()
        good, bad = rows[rows.y == 1], rows[rows.y == 0]
        rank = rows["score"].rank()
        auc = (rank[rows.y == 1].sum() - len(good) * (len(good) + 1) / 2) / max(len(good) * len(bad), 1)
        out[label] = {"rows": len(rows), "auc": round(auc, 4), "accuracy": round((rows.predicted == rows.y).mean(), 4), "recall": round(good.predicted.mean(), 4), "false alarms": int(bad.predicted.sum())}
    return out


if __name__ == "__main__":
    what, at = sys.argv[1:]
    session = SparkSession.builder.master("local[*]").config("spark.driver.memory", "12g").config("spark.driver.maxResultSize", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    print(json.dumps({what: {"repeats": repeats, "planted": planted, "recall": recall, "packing": packing, "held_out": held_out}[what](session, at), "folder": at}))
