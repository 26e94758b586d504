"""The pipeline's stages, each against brute force on its own input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm.bpe import read_ranks
from tallyloom.llm.learning import fold
from tallyloom.llm.mixing import label_weights, mix
from tallyloom.llm.quality_crf import quality

from .test_dedup import ASCII_LOWER, brute_components, brute_print
from .test_learning import corpus

tiktoken = pytest.importorskip("tiktoken")
vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs, labels = corpus(400)
    r = random.Random(6)
    good = [t for i, t, *_ in docs if i % 4]
    rows = [(i, t, "en", r.choice(["a", "b", None]), len(t)) for i, t, *_ in docs]
    rows += [(1000 + k, t.upper() if k % 2 else t, "en", "a", len(t)) for k, t in enumerate(good[:40])]
    rows += [(2000 + k, t[:-1] + "!", "en", "b", len(t)) for k, t in enumerate(good[:30])]
    rows += [(3000, None, None, None, None), (3001, "", "", "", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda df: {x.doc_id: x.text for x in df.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"]

    kept = stage["quality"](spark, docs, folder).persist()
    scores = quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), fold(F.col("doc_id"), 3) != 1)
    assert set(texts(kept)) == {x.doc_id for x in scores.where("predicted = 1").collect()} and kept.columns == docs.columns

    exact = stage["exact"](spark, kept, folder).persist()
    best = {}
    for i, t in texts(kept).items():
        key = (t or "").translate(ASCII_LOWER)
        best[key] = max(i, best.get(key, i))
    assert set(texts(exact)) == set(best.values()) and exact.columns == docs.columns

    near = stage["near"](spark, exact, folder).persist()
    groups = brute_components({i: brute_print(t) for i, t in texts(exact).items()})
    assert set(texts(near)) == set(groups.values()) and near.columns == docs.columns

    mixed = stage["mix"](spark, near, folder).persist()
    want = {x.doc_id: x.copies for x in mix(near, label_weights(spark.read.parquet(f"{folder}/labels.parquet"))).collect() if x.copies}
    assert Counter(x.doc_id for x in mixed.collect()) == want and mixed.columns == docs.columns

    coding = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=read_ranks(vocabularies.path("byte_bpe_50k.tiktoken")), special_tokens={})
    body = texts(mixed)
    out = stage["encode"](spark, mixed, folder).collect()
    assert Counter(x.doc_id for x in out) == want
    for x in out:
        assert x.ids == coding.encode_ordinary(body[x.doc_id] or "") and x.n_tokens == len(x.ids)
    assert sorted((x.doc_id, x.n_tokens) for x in corpus_pipeline.run(spark, folder).collect()) == sorted((x.doc_id, x.n_tokens) for x in out)
