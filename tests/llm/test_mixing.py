import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.mixing import mix, take_mix, targets

SCHEMA = "doc_id long, text string, source string, size string, key int"


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight; cap those above; share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, fixed = share * sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(fixed.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return fixed | {s: level * w[s] for s in open_}
        fixed |= {s: most * sizes[s] for s in over}
        open_ -= over
    return fixed


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_repeated_sharing(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}" if i else None: r.choice([0, 1, 10, 100, 5000, 100000]) * r.randint(1, 9) for i in range(r.randint(1, 12))}
    got = {x.source: x.target for x in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def rows(n=400, seed=1):
    r = random.Random(seed)
    out = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60))), "hot" if i % 3 == 0 else r.choice(["a", "b", None]), "clash", 0) for i in range(n)]
    return [*out, (n, None, "a", "clash", 0), (n + 1, "", "wordless", "clash", 0)]


def test_taken_words_come_near_the_target(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mix(docs).collect()
    assert len(got) == 402
    assert sum(x.size for x in got) == sum(len((t or "").split()) for _, t, *_ in rows())
    by = {}
    for x in got:
        assert x.taken in (0, x.size, 2 * x.size)
        by.setdefault(x.source, []).append(x)
    for source in by.values():
        assert abs(sum(x.taken for x in source) - source[0].target) <= max(x.size for x in source)
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_few_bins_and_many_bins_agree(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    one, many = (sorted((x.doc_id, x.taken) for x in mix(docs, bins=b).collect()) for b in (1, 4096))
    assert one == many


def test_better_documents_are_taken_more_often(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i % 4 else "t", "x", 0) for i in range(2000)], SCHEMA)
    weights = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 20.0).otherwise(1.0).alias("weight"))
    got = mix(docs, weights).where("source = 's'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("c")).collect()
    means = {x.odd: x.c for x in got}
    assert means[0] > means[1]


def test_mix_repeats_whole_rows_and_keeps_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    taken = {x.doc_id: x.copies for x in mix(docs).collect()}
    got = take_mix(docs)
    assert got.columns == docs.columns
    counts = {x.doc_id: x["count"] for x in got.groupBy("doc_id").count().collect()}
    assert counts == {k: c for k, c in taken.items() if c}


def test_null_and_repeated_ids_are_rows_like_any_other(spark):
    docs = spark.createDataFrame([(i // 2 if i % 5 else None, f"w {i} x y", "s" if i % 3 else None, "clash", 0) for i in range(60)], SCHEMA)
    assert mix(docs).count() == 60
    copies = {(x.doc_id, x.source): x.n for x in mix(docs).groupBy("doc_id", "source").agg(F.max("copies").alias("n")).collect()}
    got = {(x.doc_id, x.text): x["count"] for x in take_mix(docs).groupBy("doc_id", "text").count().collect()}
    assert got == {(x.doc_id, x.text): copies[x.doc_id, x.source] for x in docs.collect() if copies[x.doc_id, x.source]}


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
