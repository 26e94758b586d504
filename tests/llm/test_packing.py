import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import packing

pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
PATH = vocabularies.path("byte_bpe_50k.json")
ALPHABET = ["a", "B", "s", "re", "ll", "'", "'s", "'ve", " ", " ", "\n", "\t", "1", "٣", "é", "漢", "!", "…", "\x1c", "\x85", "😀", "-", "²", "　", " ", "\xa0", "​", " ", " ", "<|endoftext|>", "\0"]


def library(text):
    return packing.encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    e = packing.encoder(PATH)
    for s in range(3000):
        r = random.Random(s)
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40)))
        assert e.encode(text).tolist() == library(text)


def one_by_one(counts):
    """Best-two-fit of a sequence after the other, with a scan of all pairs."""
    left, out, most = {n: int(c) for n, c in enumerate(counts) if c}, 0, len(counts) - 1
    while left:
        chosen, gap = [], most
        while fits := [n for n in left if n <= gap]:
            n = max(fits)
            chosen.append(n)
            gap -= n
            left[n] -= 1
            left = {k: v for k, v in left.items() if v}
        if gap and len(chosen) > 1:
            s = min(chosen)
            pairs = [(a + b, a) for a in left for b in left if b <= a and s < a + b <= s + gap and (a != b or left[a] > 1)]
            if pairs:
                total, a = max(pairs)
                chosen.remove(s)
                for n in (a, total - a):
                    left[n] -= 1
                left[s] = left.get(s, 0) + 1
                left = {k: v for k, v in left.items() if v}
        out += 1
    return out


def first_fit(lengths, most):
    bins = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, x in enumerate(bins) if x + n <= most), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_one_sequence_after_the_other(seed):
    r = np.random.default_rng(seed)
    counts = np.bincount(r.integers(1 + 5 * seed, 60, 300), minlength=65)
    fillings = packing._fillings(counts, 0)
    assert sum(t for _, t in fillings) == one_by_one(counts)
    assert all(sum(n * t for n, t in f.items()) <= 64 for f, _ in fillings)
    least = -(-int((np.arange(65) * counts).sum()) // 64)
    assert least <= min(sum(t for _, t in packing._fillings(counts, h)) for h in (0, 10, 5)) <= first_fit(np.repeat(np.arange(65), counts).tolist(), 64) + 1


def texts():
    r = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "Sit", "amet,", "x\ny", "漢字", "12.5"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 20, 60, 200])))) for i in range(150)]
    return [*rows, (200, None), (201, ""), (300, "again"), (300, "again"), (None, "no id"), (202, "lorem ipsum " * 3000), (203, "a" * 5000)]


@pytest.mark.parametrize("most", [64, 1024])
def test_every_piece_is_placed_once(spark, most):
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in texts()], "doc_id long, text string, piece int, sequence_id string").repartition(5)
    packed = packing.pack(docs, PATH, most).cache()
    rows = packed.collect()
    whole, seen = {}, {}
    for x in rows:
        assert x.length == len(x.ids) <= most and (x.piece == 0 or x.length == most)
        seen.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for spans in seen.values():
        spans.sort()
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= most
    want = sorted([(-1 if i is None else i, [*library(t or ""), 2]) for i, t in texts()])
    for x in sorted(rows, key=lambda x: x.piece):
        whole.setdefault(-1 if x.doc_id is None else x.doc_id, []).append((x.start, x.ids))
    for i, ids in want:
        if i != 300:
            assert [t for _, p in sorted(whole[i]) for t in p] == ids and [s for s, _ in sorted(whole[i])][0] == 0
            assert len(whole[i]) == -(-len(ids) // most)
    assert sorted(p for _, p in whole[300]) == [[*library("again"), 2]] * 2
    assert len(seen) <= first_fit([x.length for x in rows], most)
    put = packing.sequences(packed).collect()
    assert sorted(t for s in put for t in s.ids) == sorted(t for _, ids in want for t in ids) and all(sum(s.lengths) == len(s.ids) for s in put)
    digests = packing.pack(docs, PATH, most, keep_ids=False).select("length", "ids_crc32").collect()
    assert sorted(map(tuple, digests)) == sorted((x.length, zlib.crc32(np.array(x.ids, "<u4").tobytes())) for x in rows)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0


def test_one_task_numbers_a_hot_length(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text")).coalesce(1)
    found = packing.pack(docs, PATH, 64, keep_ids=False).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.count("n"), F.max("n")).first()
    n = len(library("same words here")) + 1
    assert found[0] == -(-3000 // (64 // n)) and found[1] == n * (64 // n)
