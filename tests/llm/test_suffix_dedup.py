import hashlib
import random
from collections import Counter

import pytest

from tallyloom.llm.measure import planted
from tallyloom.llm.queries_dedup import op3_suffix_repeats
from tallyloom.llm.suffix_dedup import cut_repeats

SCHEMA = "doc_id long, text string, key string, p int, spans string"


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for doc, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 6)))
    passages = ["".join(word() for _ in range(r.randint(3, 40))) for _ in range(5)]
    texts = []
    for _ in range(n):
        texts.append("".join(r.choice(passages) if r.random() < 0.4 else "".join(word() for _ in range(r.randint(1, 20))) for _ in range(r.randint(0, 6))))
    texts += [texts[3]] * 7 + ["ab" * 200, "ab" * 130 + "x", "", "z" * 300, "\0" * 90, "\0" * 50 + "q"]
    return texts


@pytest.mark.parametrize(("seed", "length", "gram", "crowded"), [(1, 40, 8, 50_000), (2, 40, 16, 3), (3, 64, 64, 50_000), (4, 33, 32, 1)])
def test_equals_brute_force(spark, seed, length, gram, crowded):
    rows = [(i, t, "clash", 1, None) for i, t in enumerate(corpus(seed))] + [(10_000, None, "clash", 1, None)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in cut_repeats(spark.createDataFrame(rows, SCHEMA), length, gram, crowded).collect()}
    want = brute({i: (t or "").encode() for i, t, *_ in rows}, length)
    assert got == want
    assert any(w[1] for w in want.values())


def test_a_passage_that_very_many_share_is_induced_recursively(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared, short = word(90), word(30)
    texts = [word(r.randint(0, 30)) + r.choice([shared, shared, short, shared[20:75], ""]) + word(r.randint(0, 30)) for _ in range(250)]
    rows = [(i, t, "clash", 1, None) for i, t in enumerate(texts)]
    want = brute({i: t.encode() for i, t in enumerate(texts)}, 40)
    for crowded in (1, 10, 10_000):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in cut_repeats(spark.createDataFrame(rows, SCHEMA), 40, 8, crowded).collect()}
        assert got == want


def test_null_and_repeated_ids_keep_their_rows(spark):
    a, b, c = "x" + "ab" * 40, "cd" * 30 + "y", "".join(map(chr, range(40, 120)))
    rows = [(None, a), (None, a), (None, c), (3, b), (3, c), (3, b + "z"), (0, a), (None, None)]
    got = cut_repeats(spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA), 40, 8).collect()
    want = brute(dict(enumerate((t or "").encode() for _, t in rows)), 40)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got), key=key) == sorted(((i, *want[k]) for k, (i, _) in enumerate(rows)), key=key)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a" * 30, "", 0, ""), (1, "a" * 30, "", 0, ""), (None, "b" * 50, "", 0, "")], SCHEMA)
    assert sorted((x.doc_id or 0, x.n_bytes, x.n_removed) for x in cut_repeats(df, 40, 8).collect()) == [(0, 50, 50), (1, 30, 0), (1, 30, 0)]
    assert cut_repeats(df.limit(0), 40, 8).count() == 0


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = lambda size: " ".join(word(5) for _ in range(size))[:size]
    texts = []
    for size in (399, 400, 460):
        shared = passage(size)
        assert len(shared.split()) > 50
        texts += [f"{passage(300)}{i}{shared}{i}{passage(200)}" for i in (1, 2)]
    texts.append(passage(900))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in op3_suffix_repeats(spark, str(tmp_path)).collect()}
    assert got == brute({i: t.encode() for i, t in enumerate(texts)}, 400)
    assert [got[i][1] for i in range(7)] == [0, 0, 400, 400, 460, 460, 0]


def test_planted_passages_go_by_their_bytes_and_clean_texts_stay(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 9)))
    texts = [" ".join(word() for _ in range(r.randint(30, 90))) for _ in range(160)]
    rows = [*enumerate(texts), (200, texts[0] + texts[1]), (201, texts[0] + texts[1]), (202, None), (203, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = planted(spark, str(tmp_path))
    assert all(x["exact"] == x["holders"] == 20 and x["caught"] == x["share 400 bytes"] for x in got["by words"].values())
    assert 0 < sum(x["caught"] for x in got["by words"].values()) < 100
    assert got["left alone"] == got["clean"] > 0 and got["as before"] == got["others"] > 0
