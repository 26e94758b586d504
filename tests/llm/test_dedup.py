import hashlib
import random
import string

import pytest
import xxhash

from tallyloom.llm.exact_dedup import drop_exact, exact_groups
from tallyloom.llm.line_dedup import drop_repeated_lines
from tallyloom.llm.simhash import components, drop_near, fingerprints, links, simhash_groups

SCHEMA = "doc_id long, text string, recipe string, key long, fp long, spans string"
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "clash", 1, 2, None) for i, t in enumerate(texts)], SCHEMA)


def long_texts(seed=3):
    r = random.Random(seed)
    big = "".join(r.choice("abcdef ÄöÉ\n") for _ in range(60_000))
    return [big, big.translate(ASCII_LOWER), big[:-1] + "!", big[1:], "A" * 40_000, "a" * 40_000, "", None, " ", "Ä", "ä", *["hot copy"] * 300, "HOT copy"]


@pytest.mark.parametrize("bits", [128, 3])
def test_exact_groups_equal_brute_force(spark, bits):
    texts = long_texts()
    want = {}
    for i, t in enumerate(texts):
        want.setdefault((t or "").translate(ASCII_LOWER), []).append(i)
    got = {x.doc_id: x for x in exact_groups(frame(spark, texts), bits).collect()}
    assert len(got) == len(texts)
    for text, ids in want.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_repeated_rows_and_empty_table(spark):
    df = frame(spark, ["x", "y"]).union(frame(spark, ["X", "y"]))
    got = {x.doc_id: (x.group_size, x.kept) for x in exact_groups(df).collect()}
    assert got == {0: (2, True), 1: (2, True)}
    kept = drop_exact(frame(spark, ["q", "Q", None, ""]).union(frame(spark, ["q"])))
    assert sorted(x.doc_id for x in kept.collect()) == [1, 3] and kept.columns == frame(spark, ["q"]).columns
    odd = spark.createDataFrame([(None, "a"), (None, "A"), (None, "b"), (4, "B"), (4, "c"), (4, "d"), (5, "c")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.text.lower()) for x in drop_exact(odd).collect()) == [(0, "a"), (4, "b"), (4, "d"), (5, "c")]
    assert {(x.doc_id, x.kept) for x in exact_groups(odd).collect()} == {(None, True), (None, False), (4, True), (4, False), (5, True)}
    assert exact_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [128, 3])
def test_exact_groups_give_a_row_for_each_row(spark, bits):
    rows = [(1, "A"), (1, "a"), (1, "a"), (None, "a"), (None, "a"), (2, "b"), (1, "b"), (2, "B"), (3, None), (None, "")] + [(5, "long " * 2000)] * 3
    got = sorted((-1 if x.doc_id is None else x.doc_id, -1 if x.keep_id is None else x.keep_id, x.group_size, x.kept) for x in exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits).collect())
    texts = [(t or "").lower() for _, t in rows]
    want = []
    for (i, _), t in zip(rows, texts, strict=True):
        ids = [-1 if j is None else j for (j, _), u in zip(rows, texts, strict=True) if u == t]
        own = -1 if i is None else i
        want.append((own, max(ids), len(ids), own == max(ids)))
    assert got == sorted(want)
    assert drop_exact(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def brute_lines(docs, window=3):
    seen, out = set(), {}
    for doc, text in sorted(docs.items()):
        lines = (text or "").split("\n")
        gone = [False] * len(lines)
        for i in range(len(lines) - window + 1):
            w = tuple(lines[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out[doc] = ("\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)))
    return out


def test_line_windows_equal_brute_force(spark):
    r = random.Random(9)
    texts = ["\n".join(r.choice("abcd") for _ in range(r.randint(0, 30))) for _ in range(120)] + ["a\na\na\na\na", None, "", "\n\n\n\n", "x\ny", "one"] + ["p\nq\nr\ns"] * 200
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed, x.n_spans) for x in drop_repeated_lines(frame(spark, texts)).collect()}
    assert got == brute_lines(dict(enumerate(texts)))


def test_line_windows_repeated_ids_and_empty_table(spark):
    df = frame(spark, ["a\nb\nc"])
    assert [x.n_removed for x in drop_repeated_lines(df.union(df)).collect()] == [0, 0]
    assert drop_repeated_lines(df.limit(0)).count() == 0


THIRTY, OTHERS = "\n".join(f"l{i}" for i in range(30)), "\n".join(f"m{i}" for i in range(40))


@pytest.mark.parametrize("rows", [
    [(1, THIRTY), (2, THIRTY), (2, "a\nb")],
    [(1, THIRTY), (2, THIRTY), (2, OTHERS)],
    [(2, THIRTY), (2, OTHERS), (2, THIRTY), (2, f"{OTHERS}\nx"), (3, OTHERS)],
    [(None, THIRTY), (None, f"{THIRTY}\nx"), (None, None), (1, THIRTY), (1, ""), (1, None)],
])
def test_line_windows_of_repeated_ids_with_other_texts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_lines, x.text, x.n_removed, x.n_spans) for x in drop_repeated_lines(df).collect())
    marks = {(r.doc_id, r.text): r.mark for r in df.selectExpr("*", "xxhash64(text) as mark").collect()}
    order = sorted({*rows}, key=lambda r: (-1 if r[0] is None else r[0], marks[r]))
    want = brute_lines({i: text for i, (_, text) in enumerate(order)})
    by_row = {r: want[i] for i, r in enumerate(order)}
    assert got == sorted((-1 if r[0] is None else r[0], by_row[r][1], by_row[r][0], *by_row[r][2:]) for r in rows)


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def near_texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(12)]
    out = [*base, "", None, "  \t", "one", "one two", "One TWO", "é É"]
    for _ in range(120):
        t = r.choice(base[:4]).split()
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_simhash_equals_brute_force(spark, hot):
    texts = near_texts()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    want = brute_components(prints)
    got = simhash_groups(frame(spark, texts), hot=hot).collect()
    assert {x.doc_id: x.fingerprint for x in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {x.doc_id: x.component_id for x in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("hot", [2000, 3])
def test_links_lose_no_pair_within_three_bits(spark, hot):
    r = random.Random(8)
    centre = r.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:
        x = r.choice(sorted(prints)) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    nodes = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(sorted(prints))]
    values = dict(enumerate(sorted(prints)))
    want = {(a, b) for a in values for b in values if a < b and (values[a] ^ values[b]).bit_count() <= 3}
    got = {tuple(sorted((x.a, x.b))) for x in links(spark.createDataFrame(nodes, "id long, fp long"), hot=hot).collect()}
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(101, 141)} == {100} and {got[k] for k in range(200, 260)} == {7}


def test_near_duplicates_leave_one_of_each_group(spark):
    texts = near_texts()
    want = set(brute_components({i: brute_print(t) for i, t in enumerate(texts)}).values())
    got = drop_near(frame(spark, texts))
    assert {x.doc_id for x in got.collect()} == want and got.columns == frame(spark, ["q"]).columns
    assert drop_near(frame(spark, ["q"]).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b c d e"), (4, "b c d e"), (5, "b c d e"), (5, "f"), (6, "f")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.text) for x in drop_near(odd).collect()) == [(0, "a"), (0, "a"), (0, "b c d e"), (4, "b c d e"), (5, "b c d e"), (5, "f")]
    assert fingerprints(frame(spark, [None])).first().fp == 0


def test_fingerprints_of_null_ids_bridge_others(spark):
    r = random.Random(8)
    for _ in range(200):  # three texts, of which only the middle one is near both others
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(90)]
        chain = [words, [*words[:30], "x", *words[31:]], [*words[:30], "x", *words[31:60], "y", *words[61:]]]
        prints = [brute_print(" ".join(w)) for w in chain]
        apart = [(prints[a] ^ prints[b]).bit_count() for a, b in ((0, 1), (1, 2), (0, 2))]
        if 0 < apart[0] <= 3 and 0 < apart[1] <= 3 < apart[2]:
            break
    else:
        raise AssertionError("no such texts")
    rows = [(7, " ".join(chain[0])), (None, " ".join(chain[1])), (5, " ".join(chain[2])), (None, "alone " * 9), (9, "far " * 9)]
    got = {(x.doc_id, x.component_id) for x in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 5), (None, 5), (5, 5), (None, None), (9, 9)}
