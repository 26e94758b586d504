"""Searches with the predictor in the loop against plain ones, and voted decoding."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyloom.operators import frontier, voted

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
TOKENS, STOP = 4, 3


def logits(seed, path):
    r = np.random.default_rng([seed, *path, 99])
    return np.round(r.normal(size=TOKENS) * 3, 1)  # rounded: there are ties


class Toy:
    def next_logits(self, prefixes: pd.DataFrame) -> np.ndarray:
        return np.stack([logits(s, p) for s, p in zip(prefixes["seed"], prefixes["path"], strict=True)])


def depth_first(seed, cutoff, depth, allowed, accept, cap):
    """One path after the other, the best sibling first, until there are ``cap``."""
    out = []

    def below(path, nll):
        steps = -frontier.log_softmax(logits(seed, path)[None])[0]
        return sorted((nll + steps[t], t) for t in allowed if nll + steps[t] < cutoff)

    stack = [([], below([], 0.0))]
    while stack and len(out) < cap:
        path, rest = stack[-1]
        if not rest:
            stack.pop()
            continue
        nll, token = rest.pop(0)
        if token == STOP:
            if accept(path):
                out.append((path, nll))
        elif len(path) + 1 < depth:
            stack.append(([*path, token], below([*path, token], nll)))
    return sorted(out, key=lambda x: x[1]), len(out)


@pytest.mark.parametrize(("cutoff", "depth", "allowed", "cap"), [(3.5, 12, None, 1000), (4.0, 12, None, 3), (4.0, 5, [0, 2, 3], 2), (1.0, 1, None, 5), (0.0, 4, None, 5)])
def test_search_equals_one_path_after_the_other(spark, tmp_path, cutoff, depth, allowed, cap):
    seeds = list(range(30))
    frames = spark.createDataFrame([(s, s + 1000, "extra") for s in seeds], "seed long, id long, note string").repartition(3)
    found = frontier.completions(frames, ["id"], Toy, str(tmp_path), cutoff, depth, [STOP], allowed, lambda p: F.get(p, F.lit(0)) != 1, cap)
    got = {}
    for r in frontier.capped(found, ["id"], cap).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((list(r.path), round(r.nll, 9)))
    why = {r.id: (r.candidates, r.reason) for r in frontier.reasons(frames, found, ["id"], cap).collect()}
    some = 0
    for s in seeds:
        want, n = depth_first(s, cutoff, depth, allowed or range(TOKENS), lambda p: bool(p) and p[0] != 1, cap)
        assert got.get(s + 1000, []) == [(p, round(x, 9)) for p, x in want]
        assert why[s + 1000] == (n, "candidate_cap" if n >= cap else "exhausted")
        some += n
    assert some or cutoff <= 1


def test_without_a_cap_every_completion_is_found_and_plans_do_not_grow(spark, tmp_path):
    frames = spark.createDataFrame([(s, s) for s in range(8)], "seed long, id long")
    found = frontier.completions(frames, ["id"], Toy, str(tmp_path), 4.5, 12, [STOP])
    got = {(r.id, tuple(r.path)): round(r.nll, 9) for r in found.collect()}
    want = {(s, tuple(p)): round(x, 9) for s in range(8) for p, x in depth_first(s, 4.5, 12, range(TOKENS), lambda p: True, 10**9)[0]}
    assert got == want and max(len(p) for _, p in got) > 4
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    by_level = {r.level: (r.prefixes, r.ended) for r in frontier.levels(spark, str(tmp_path)).collect()}
    assert sum(e for _, e in by_level.values()) == len(got)
    assert all(n < 8 * np.exp(4.5) for n, _ in by_level.values())


def test_no_frames(spark, tmp_path):
    frames = spark.createDataFrame([], "seed long, id long")
    assert frontier.completions(frames, ["id"], Toy, str(tmp_path), 4.0, 5, [STOP], cap=3).count() == 0


class Sampler:
    """Notes every call in a file of its own."""

    def __init__(self, at=None):
        self.at = at

    def predict(self, prompts):
        return prompts.apply(lambda r: None if r["task"] == "none" else ["{\"a\": 1}", "{\"a\":1}", "{\"a\": 2}", "x", "x"][r["ordinal"]], axis=1)

    def log_probability(self, pairs):
        import uuid

        with open(f"{self.at}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(f"{t}|{o}|{p}" for t, o, p in zip(pairs["task"], pairs["output"], pairs["prompt"], strict=True)))
        return pairs["output"].map({"{\"a\": 1}": -0.5, "{\"a\":1}": -0.1, "{\"a\": 2}": -0.05, "x": -0.7})


def test_voted_decode_asks_once_for_each_text_in_bounded_calls(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    at, cache = str(asked), str(tmp_path / "cache")
    prompts = spark.createDataFrame([("a", "p" * 10), ("b", "q" * 10), ("none", "r")], "task string, prompt string").coalesce(1)
    make = lambda: Sampler(at)
    got = {r.task: r for r in voted.decode(prompts, ["task"], make, 5, cache, most_chars=40).collect()}
    assert set(got) == {"a", "b"}  # 2 of 5 agree on {"a":1}, and so do the two x; the likelier pool wins
    assert got["a"].text == "{\"a\":1}" and got["a"].key == "{\"a\":1}" and got["a"].found_count == 2 and got["a"].mean_lp == pytest.approx(-0.3)
    calls = [f.read_text().split("\n") for f in asked.iterdir()]
    lines = [x for c in calls for x in c]
    assert len(lines) == len(set(lines)) == 8 and all(x.split("|")[2] in ("p" * 10, "q" * 10) for x in lines)
    assert all(len(c) == 1 or sum(len(x) - 2 for x in c) <= 40 for c in calls) and len(calls) > 2
    assert tuple(voted.calls(spark, cache).first()) == (8, len(calls))
    more = prompts.union(spark.createDataFrame([("c", "s")], "task string, prompt string"))
    assert voted.decode(more, ["task"], make, 5, cache).count() == 3
    assert sorted(x.split("|")[0] for f in asked.iterdir() for x in f.read_text().split("\n")) == ["a"] * 4 + ["b"] * 4 + ["c"] * 4


def test_candidates_are_made_once_and_scores_are_not_joined_with_them(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    made = spark.sparkContext.accumulator(0)

    class Counted(Sampler):
        def predict(self, prompts):
            made.add(len(prompts))
            return super().predict(prompts)

    prompts = spark.createDataFrame([(f"t{i}", "p") for i in range(40)], "task string, prompt string")
    make = lambda: Counted(str(tmp_path / "asked"))
    for _ in range(2):  # with a cache and without
        rows = voted.scored_once(voted.pool(prompts, make, 5), ["task"], make, str(tmp_path / "cache"), context=["prompt"])
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
        got = {(r.task, r.ordinal): (r.text, r.prompt, r.lp) for r in rows.collect()}
        assert len(got) == 200 and got["t7", 1] == ("{\"a\":1}", "p", -0.1) and got["t7", 3] == got["t7", 4] == ("x", "p", -0.7)
    assert made.value == 2 * 200
