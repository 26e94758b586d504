import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import quality_crf
from tallyloom.llm.common import utf8
from tallyloom.llm.learning import fold, word_hashes
from tallyloom.llm.quality_crf import WIDTH, forward_backward, keep_good, line_features, quality
from tallyloom.llm.toxicity import ALPHA, BETA, BITS, L1, L2, ftrl, toxicity

SCHEMA = "doc_id long, text string, score string, label string"


def test_word_hashes_depend_on_the_word_alone():
    data, at = utf8(pa.array(["Ann saw ann", "", "saw", "xAnn", None, "ann"]))
    starts, ends, h = word_hashes(data, at)
    words = [bytes(data[a:b]).lower() for a, b in zip(starts, ends, strict=True)]
    assert words == [b"ann", b"saw", b"ann", b"saw", b"xann", b"ann"]
    assert len(set(h.tolist())) == 3 and h[0] == h[2] == h[5]


def test_ftrl_equals_a_plain_loop_over_coordinates():
    r = random.Random(4)
    rows = [(sorted(r.sample(range(40), r.randint(0, 12))), r.randint(0, 1)) for _ in range(300)]
    z, n = dict.fromkeys([*range(40), "bias"], 0.0), dict.fromkeys([*range(40), "bias"], 0.0)

    def weight(i):
        if abs(z[i]) <= L1:
            return 0.0
        return -(z[i] - math.copysign(L1, z[i])) / ((BETA + math.sqrt(n[i])) / ALPHA + L2)

    for _ in range(3):
        for index, label in rows:
            w = {i: weight(i) for i in [*index, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got, bias = ftrl([(np.array(i, np.int32), y) for i, y in rows], epochs=3)
    assert np.allclose(got[:40], [weight(i) for i in range(40)], atol=1e-9) and not got[40:].any() and len(got) == 1 << BITS
    assert abs(bias - weight("bias")) < 1e-9
    assert 0 < np.count_nonzero(got) < 40


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(1)
    sizes = [1, 4, 2, 5]
    first = np.concatenate(([0], np.cumsum(sizes)))
    e, step = r.normal(size=first[-1]), r.normal(size=(2, 2))
    good, pairs, log_z = forward_backward(e, step, first)
    want_pairs = np.zeros((2, 2))
    for k, n in enumerate(sizes):
        z, marginal = 0.0, np.zeros(n)
        these = np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e[first[k] + i] * y for i, y in enumerate(ys)) + sum(step[a, b] for a, b in itertools.pairwise(ys)))
            z += w
            marginal += w * np.array(ys)
            for a, b in itertools.pairwise(ys):
                these[a, b] += w
        assert np.allclose(good[first[k] : first[k + 1]], marginal / z)
        assert log_z[k] == pytest.approx(math.log(z))
        want_pairs += these / z
    assert np.allclose(pairs, want_pairs)


def test_line_features_do_not_depend_on_neighbouring_texts():
    texts = ["Good line here.\nBAD!! LINE!!\n", "", "one", "\n\n", "a | b | c\nx", None, "z"]
    data, at = utf8(pa.array(texts))
    x, n, first = line_features(data, at)
    assert np.diff(first).tolist() == [3, 1, 1, 3, 2, 1, 1] and x.shape[1] == WIDTH
    for i, t in enumerate(texts):
        d1, a1 = utf8(pa.array([t], pa.string()))
        x1, n1, _ = line_features(d1, a1)
        assert np.allclose(x[first[i] : first[i + 1]], x1) and np.array_equal(n[first[i] : first[i + 1]], n1)


def corpus(n=600, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(4, 12))).capitalize() + "." for _ in range(r.randint(1, 8))]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if toxic:
            lines[-1] += " " + r.choice(["vile", "awful scum", "moronic"])
        docs.append((i, "\n".join(lines), "clash", "clash"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(900, None, "", ""), (901, "", "", ""), (902, "\n" * 5000, "", ""), (903, "word " * 60_000, "", "")]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label", "bar"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(tables, operator, label, bar):
    docs, labels = tables
    out = operator(docs, labels, fold(F.col("doc_id"), 3) != 1)
    assert out.count() == 604 and out.where("score is null or score < 0 or score > 1").count() == 0
    got = out.join(labels, "doc_id").where(fold(F.col("doc_id"), 3) == 1).collect()
    assert sum(x.predicted == x[label] for x in got) / len(got) >= bar
    again = operator(docs, labels, fold(F.col("doc_id"), 3) != 1)
    assert {x.doc_id: round(x.score, 9) for x in out.collect()} == {x.doc_id: round(x.score, 9) for x in again.collect()}


def test_without_labels_and_empty_tables(spark, tables):
    docs, labels = tables
    for operator in (quality, toxicity):
        assert {x.score for x in operator(docs.limit(3), labels.limit(0), F.lit(True)).collect()} == {0.5}
        assert operator(docs.limit(0), labels, F.lit(True)).count() == 0


def test_keep_good_agrees_with_the_scores(tables):
    docs, labels = tables
    train = fold(F.col("doc_id"), 3) != 1
    want = {x.doc_id for x in quality(docs, labels, train).where("predicted = 1").collect()}
    kept = keep_good(docs, labels, train)
    assert {x.doc_id for x in kept.collect()} == want and kept.columns == docs.columns


def test_emissions_are_the_features_times_the_weights():
    r = np.random.default_rng(6)
    texts = ["", "\n", "One line.", "a\n\nb b b\n", "\n\n\n", "x|y;z\t1 2 3!!\nUPPER case é\nend", *["\n".join("".join(r.choice(list("ab .,!1|\t#É"), r.integers(0, 30))) for _ in range(r.integers(0, 9))) for _ in range(60)]]
    data, at = utf8(pa.array(texts, pa.string()))
    theta = r.normal(size=quality_crf.WIDTH + 4)
    x, n, first = quality_crf.line_features(data, at)
    emission, lengths, begins = quality_crf.emissions(data, at, theta)
    assert np.allclose(emission, x @ theta[: quality_crf.WIDTH], atol=1e-12) and (lengths == n).all() and (begins == first).all()


def test_a_text_of_many_lines_takes_memory_for_a_few_numbers_a_line():
    data, at = utf8(pa.array(["\n" * 200_000], pa.string()))
    theta = np.zeros(quality_crf.WIDTH + 4)
    tracemalloc.start()
    quality_crf.emissions(data, at, theta)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 200 * 200_000
