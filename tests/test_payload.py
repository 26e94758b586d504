import pytest
from pyspark.sql import functions as F

from tallyloom.functions.payload import leaf_text, leaves, parse, parsed
from tallyloom.operators.scoring import bag, field_status, one_per_id, protocol, scored, tier_of, unknown_ids



@pytest.mark.parametrize(
    ("leaf", "form"),
    [
        ("12,000", "12000"), ("12000", "12000"), (12000, "12000"), (12000.0, "12000"), ("5.50", "5.5"), ("  Ann   LEE ", "ann lee"), ("7th street", "7th street"),
        (True, "true"), (None, "null"), (False, "false"), ("-0", "-0"), ("+7", "7"), ("1,23", "1,23"), (".5", ".5"), ("1e3", "1e3"), ("ß", "ss"), ("a b", "a b"),
        ("٣٤", "34"), ("", ""), ("9" * 30, "9" * 30), (1e-7, "0.0000001"), (1.2e4, "12000"), ("0.10", "0.1"),
    ],
)
def test_normal_forms(leaf, form):
    assert leaf_text(leaf) == form


def test_strict_parse():
    assert parse('{"a":1}') == {"a": 1}
    assert parse('{"a":1,"a":2}') == {"a": 2}
    for bad in ('{"a":1} x', "[1]", "1", "", None, "{", "nan"):
        assert parse(bad) is None


def test_paths_drop_list_positions_and_alias_dots():
    assert leaves({"m": [{"n": "A"}, {"n": "b"}], "x.y": 1, "x": {"y": 1}, "e": {}, "l": [[1], [2]]}) == [("m.n", "a"), ("m.n", "b"), ("x.y", "1"), ("x.y", "1"), ("l", "1"), ("l", "2")]


CASES = [
    ('{"a":[1,2]}', '{"a":[2,1]}', 1.0, False), ('{"a":"12,000"}', '{"a":12000}', 1.0, False), ('{"a":1,"z":2}', '{"a":1,"b":2,"c":3}', 0.4, False),
    ('{"b":1}', '{"a":1}', 0.0, False), ("{}", '{"a":1}', 0.0, False), ("{}", "{}", 1.0, True), ('{"a":["x"]}', '{"a":["x","x"]}', 2 / 3, False), ('{"b":1,"a":2}', '{"a":2,"b":1}', 1.0, True),
]


def test_hand_computed_scores(spark):
    rows = [(i, p, g) for i, (p, g, *_) in enumerate(CASES)] + [(99, "oops", '{"a":1}'), (98, None, '{"a":1}'), (97, '{"a":' + "9" * 30 + "}", '{"a":1}')]
    got = {x.id: x for x in scored(spark.createDataFrame(rows, "id int, prediction string, gold string")).collect()}
    for i, (_, _, f1, exact) in enumerate(CASES):
        assert got[i].micro_f1 == pytest.approx(f1) and got[i].exact_match is exact and got[i].valid_json
    for i in (97, 98, 99):
        assert (got[i].valid_json, got[i].exact_match, got[i].micro_f1) == (False, False, 0.0)


def test_invalid_gold_raises_or_stays_null(spark):
    df = spark.createDataFrame([("{}", "oops")], "prediction string, gold string")
    with pytest.raises(Exception, match="gold is not a JSON object"):
        scored(df).collect()
    assert scored(df, on_invalid_gold="null").first().micro_f1 is None


def test_bag_counts(spark):
    df = spark.createDataFrame([(1, '{"a":["x","X",2]}')], "id int, t string").withColumn("p", parsed("t"))
    assert {(x.path, x.value, x.n) for x in bag(df, ["id"], "p").collect()} == {("a", "x", 2), ("a", "2", 1)}


def test_duplicates_missing_and_unknown_ids(spark):
    gold = spark.createDataFrame([("1", '{"a":1}'), ("2", '{"a":1}'), ("3", '{"a":1}')], "id string, gold string")
    p = spark.createDataFrame([("1", '{"a":2}', 0), ("1", '{"a":1}', 1), ("2", '{"a":1}', 0), ("9", "{}", 0)], "id string, prediction string, line_no int")
    zero = {x.id: x.micro_f1 for x in protocol(gold, p).collect()}
    last = {x.id: x.micro_f1 for x in protocol(gold, p, on_duplicate="last").collect()}
    assert zero == {"1": 0.0, "2": 1.0, "3": 0.0} and last == {"1": 1.0, "2": 1.0, "3": 0.0}
    assert [x.id for x in unknown_ids(gold, p).collect()] == ["9"]
    with pytest.raises(ValueError, match="on_duplicate"):
        one_per_id(p, on_duplicate="first")


def test_field_status_and_tiers(spark):
    p = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "d", "q")], "id int, path string, value string")
    g = spark.createDataFrame([(1, "a", "x"), (1, "b", "z"), (1, "c", "w")], "id int, path string, value string")
    assert {x.path: x.status for x in field_status(p, g, ["id"]).collect()} == {"a": "hit", "b": "wrong", "c": "miss", "d": "extra"}
    df = spark.createDataFrame([("h-1",), ("m-1",), ("x-1",), ("q",)], "id string").select(tier_of(F.col("id")).alias("t"))
    assert [x.t for x in df.collect()] == ["hard", "medium", "mixed", "easy"]


def test_normal_form_is_the_same_in_the_jvm(spark):
    import random

    from tallyloom.functions.payload import leaf_text, normal_leaf

    r = random.Random(2)
    parts = ["0", "00", "12", "345", ",", ",", ".", ".", "-", "+", " ", "\t", "\x1c", "\x0b", "a", "B", "É", "ß", "\u00a0", "\u0663", "1,234", "9" * 15, "\n", "İ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(3000)]
    texts += ["-0", "-0.0", "+5", "007", "0.500", "-000.50", "1,234,567.890", "12,34", "1" * 28, "1" * 29, "1" * 27 + ".55", "0" * 40, "1." + "0" * 40, "", " ", None, "\x00", "5.", ".5"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", normal_leaf(F.col("t")).alias("n")).collect()
    for x in rows:
        t = texts[x.i]
        assert x.n == (None if t is None else leaf_text(t)), repr(t)


def test_bags_are_made_within_their_rows(spark):
    df = spark.createDataFrame([(1, '{"a":["x","X ",2],"b":{"c":null}}'), (1, '{"a":"x"}'), (2, "{}"), (3, "no")], "id long, t string").withColumn("p", parsed("t"))
    rows = bag(df, ["id"], "p")
    assert sorted((x.id, x.path, x.value, x.n) for x in rows.collect()) == [(1, "a", "2", 1), (1, "a", "x", 1), (1, "a", "x", 2), (1, "b.c", "null", 1)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("sign", ["", "+", "-"])
def test_number_leaves_without_decimals_equal_those_by_decimals(sign):
    from decimal import Decimal

    from tallyloom.functions.payload import leaf_text, number_text

    for text in ("0", "000", "0.00", "00.50", "1,234.500", "12,345,678", "1234567890123456789012345678", "123456789012345678901234.5678", "1" + "0" * 27, "٣.٥٠", "1" * 20 + "." + "2" * 20):
        assert leaf_text(sign + text) == number_text(Decimal((sign + text).replace(",", "")))
    assert leaf_text("1" * 29) == "1" * 29 and leaf_text(" 1,23 ") == "1,23"
