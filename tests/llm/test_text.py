import random

import pytest

from tallyloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
vocabularies = pytest.importorskip("public_tokenizers")
PATH = vocabularies.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "B", "s", "t", "re", "ll", "'", "'", "'s", "'ve", " ", " ", "\n", "\t", "1", "٣", "é", "漢", "!", "…", "\x1c", "\x85", "😀", "-", "²", "　", "d", "m", "v", "e", " ", " "]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts(seed=1, n=3000):
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [*out, "", "a" * 700, "ab" * 3000 + "'s", " " * 300 + "x", "qzx" * 100, "<|endoftext|>", "it's 'twas 'RE don't've\n\n\n  x  "]


def test_ids_equal_the_library_and_decode_back(reference):
    c = bpe.codec(PATH)
    for text, ids in zip(texts(), c.encode(texts()), strict=True):
        assert ids == reference.encode_ordinary(text)
    found = list(c.encode(texts()))
    for text, ids, (data, ends) in zip(texts(), found, c.decode(found), strict=True):
        assert data == text.encode()
        assert ends.tolist() == [sum(len(reference.decode_single_token_bytes(i)) for i in ids[: k + 1]) for k in range(len(ids))][: len(ids)]


def test_a_small_cache_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    c = bpe.Codec(bpe.read_ranks(PATH))
    assert list(c.encode(texts(2, 400))) == [reference.encode_ordinary(t) for t in texts(2, 400)]


def test_long_slices_are_not_kept(reference):
    c = bpe.Codec(bpe.read_ranks(PATH))
    rows = ["x" * 5000, "short words", "x" * 5000 + " y"]
    assert list(c.encode(rows)) == [reference.encode_ordinary(t) for t in rows]
    assert max(map(len, c.cache)) <= bpe.LONG_SLICE


def test_columns(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate([*texts(3, 60), None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens = bpe.encode(docs, PATH, offsets=True)
    got = {x.doc_id: x for x in tokens.collect()}
    for i, t, _ in rows:
        assert got[i].ids == reference.encode_ordinary(t or "")
        assert (got[i].ends or [0])[-1] == len((t or "").encode())
    back = {x.doc_id: bytes(x.bytes) for x in bpe.decode(tokens, PATH).collect()}
    assert back == {i: (t or "").encode() for i, t, _ in rows}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
