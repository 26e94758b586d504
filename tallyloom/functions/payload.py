"""Extraction payloads: strict JSON objects and their normalised leaves.

``judged`` scores all predictions of a row against its gold in one Arrow-batched
call, so that each text is parsed once and only scores come back. ``parsed``
returns the leaves themselves; a leaf carries its number among
equal leaves of its text, so that a bag of leaves is a set of (path, value, nth)
and the overlap of two bags is the size of an array intersection.
"""

from __future__ import annotations

import functools
import json
import re
from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), T.StructField("nth", T.IntegerType())])
PARSED = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("canonical", T.StringType()), T.StructField("top_level_keys", T.IntegerType()), T.StructField("leaves", T.ArrayType(LEAF))])
#: Fixed value: what counts as a number inside a text leaf (a sign, grouped or plain digits, a fraction).
NUMBER = re.compile(r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?")
_DIGITS = Context(prec=28, rounding=ROUND_HALF_EVEN)


def number_text(x: Decimal) -> str:
    """Plain notation without trailing zeros, after rounding to 28 digits. An
    integer that needs more digits is an error."""
    x = _DIGITS.create_decimal(x)
    if not x.is_finite():
        raise InvalidOperation
    text = f"{x:f}"
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    if "." not in text and len(text.lstrip("-")) > 28:
        raise InvalidOperation
    return text


def _number_leaf(text: str) -> str | None:
    """The normal form of a text that is a number, None if it is too long to be one."""
    digits = text.replace(",", "")
    if len(digits) > 28 or not digits.isascii():
        try:
            return number_text(Decimal(digits))
        except InvalidOperation:
            return None
    # No digit is rounded away, so signs and zeros are all that changes.
    whole, _, rest = digits.lstrip("+-").partition(".")
    whole, rest = whole.lstrip("0") or "0", rest.rstrip("0")
    return ("-" if digits[0] == "-" else "") + whole + ("." + rest if rest else "")


def _text_leaf(x: str) -> str:
    text = " ".join(x.split()).casefold()
    if NUMBER.fullmatch(text) and (number := _number_leaf(text)) is not None:
        return number
    return text


#: Short texts that come again, as words of a class do, are normalised once.
_short_leaf = functools.lru_cache(1 << 14)(_text_leaf)


def leaf_text(x: object) -> str:
    """The normal form of a leaf: JSON words, numbers as ``number_text``, text
    with white space collapsed and case folded, or as a number if it is one."""
    if isinstance(x, str):
        return _short_leaf(x) if len(x) <= 64 else _text_leaf(x)
    if x is True or x is False or x is None:
        return {True: "true", False: "false", None: "null"}[x]
    return number_text(Decimal(str(x)))


def leaves(payload: dict) -> list[tuple[str, str]]:
    """(path, value) of every leaf: keys joined by dots, list positions left out."""
    if not any(isinstance(v, (dict, list)) for v in payload.values()):
        return [(k, leaf_text(v)) for k, v in payload.items()]
    out, todo = [], [("", payload)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(path, v) for v in reversed(node)]
        else:
            out.append((path, leaf_text(node)))
    return out


def parse(text: str | None) -> dict | None:
    """The object that is the whole text, or None."""
    try:
        found = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def bag(payload: dict) -> dict[tuple[str, str], int] | None:
    """How often each leaf occurs; None if a number is too long to be one."""
    try:
        pairs = leaves(payload)
    except InvalidOperation:
        return None
    out = dict.fromkeys(pairs, 1)
    if len(out) < len(pairs):
        out = dict.fromkeys(pairs, 0)
        for pair in pairs:
            out[pair] += 1
    return out


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.arrow_udf(PARSED)
def parsed(texts: pa.Array) -> pa.Array:
    """Struct of valid, canonical JSON, top_level_keys and leaves; null and
    malformed texts are not valid, and so is a bare number of over 28 digits."""
    valid, forms, sizes, ends = [], [], [], [0]
    paths: list[str] = []
    values: list[str] = []
    nths: list[int] = []
    for text in texts.to_pylist():
        found = parse(text)
        try:
            pairs = leaves(found) if found is not None else None
        except InvalidOperation:
            pairs = None
        valid.append(pairs is not None)
        forms.append(None if pairs is None else canonical(found))
        sizes.append(None if pairs is None else len(found))
        seen: dict[tuple[str, str], int] = {}
        for pair in pairs or ():
            seen[pair] = seen.get(pair, 0) + 1
            paths.append(pair[0])
            values.append(pair[1])
            nths.append(seen[pair])
        ends.append(len(paths))
    flat = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string()), pa.array(nths, pa.int32())], ["path", "value", "nth"])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    lists = pc.if_else(pa.array(valid, pa.bool_()), lists, pa.nulls(len(valid), lists.type))
    return pa.StructArray.from_arrays([pa.array(valid, pa.bool_()), pa.array(forms, pa.string()), pa.array(sizes, pa.int32()), lists], ["valid", "canonical", "top_level_keys", "leaves"])


SCORE = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("exact", T.BooleanType()), T.StructField("f1", T.DoubleType())])


@F.arrow_udf(T.ArrayType(SCORE))
def judged(golds: pa.Array, predictions: pa.Array) -> pa.Array:
    """For each gold text and its array of predictions the score of each:
    whether it is a JSON object, equals the gold's canonical JSON, and its
    micro-F1 (1 if both bags are empty). Null where the gold is malformed."""
    flat = predictions.flatten().to_pylist()
    at, ends, known = 0, [0], []
    valid: list[bool] = []
    exact: list[bool] = []
    f1: list[float] = []
    for gold, n in zip(golds.to_pylist(), pc.list_value_length(predictions).fill_null(0).to_pylist(), strict=True):
        texts, at = flat[at : at + n], at + n
        want = parse(gold)
        target = None if want is None else bag(want)
        known.append(target is not None)
        for text in texts if target is not None else ():
            found = parse(text)
            got = None if found is None else bag(found)
            valid.append(got is not None)
            exact.append(got is not None and found == want and canonical(found) == canonical(want))
            if got is None:
                f1.append(0.0)
            else:
                size = sum(got.values()) + sum(target.values())
                shared = sum(min(c, target[x]) for x, c in got.items() if x in target)
                f1.append(2.0 * shared / size if size else 1.0)
        ends.append(len(valid))
    rows = pa.StructArray.from_arrays([pa.array(valid, pa.bool_()), pa.array(exact, pa.bool_()), pa.array(f1, pa.float64())], ["valid", "exact", "f1"])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
    return pc.if_else(pa.array(known, pa.bool_()), lists, pa.nulls(len(known), lists.type))


# Filters and projections above don't repeat the call of a function that isn't deterministic.
parsed, judged = parsed.asNondeterministic(), judged.asNondeterministic()


@F.arrow_udf(T.StringType())
def candidate_key(texts: pa.Array) -> pa.Array:
    """Canonical JSON of an object, else the text itself. Candidates of a vote agree
    often, so a text of a batch is parsed once."""
    each = texts.dictionary_encode()
    keys = [t if (found := parse(t)) is None or bag(found) is None else canonical(found) for t in each.dictionary.to_pylist()]
    return pa.array(keys, pa.string()).take(each.indices)


@F.pandas_udf(T.StringType())
def _normal_leaf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else leaf_text(t))


def normal_leaf(text: Column) -> Column:
    """The normal form of a text leaf. ASCII texts, but for numbers of over 28
    digits, are done in the JVM; Python gets nulls in their place."""
    folded = F.lower(F.trim(F.regexp_replace(text, r"[\x09-\x0D\x1C-\x20]+", " ")))
    digits = F.replace(folded, F.lit(","), F.lit(""))
    whole = F.regexp_replace(F.regexp_extract(digits, r"^[+-]?([0-9]+)", 1), "^0+(?=.)", "")
    rest = F.regexp_replace(F.regexp_extract(digits, r"(\.[0-9]+)$", 1), r"\.?0+$", "")
    number = F.concat(F.when(digits.startswith("-"), F.lit("-")).otherwise(F.lit("")), whole, rest)
    plain = text.rlike(r"^[\x00-\x7F]*$") & ~(is_number(folded) & (F.length(digits) > 28))
    return F.coalesce(F.when(plain, F.when(is_number(folded), number).otherwise(folded)), _normal_leaf(F.when(~plain, text)))


def is_number(text: Column) -> Column:
    """Whether a folded ASCII text is numeric, JVM-side."""
    return text.rlike(r"^[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?$")


def overlap(a: Column, b: Column) -> Column:
    """Size of the bag intersection of two leaf arrays."""
    return F.size(F.array_intersect(a, b))


def micro_f1(predicted: Column, gold: Column) -> Column:
    """2 overlap / (sizes); 1 if both bags are empty."""
    both = F.size(predicted) + F.size(gold)
    return F.when(both == 0, 1.0).otherwise(2.0 * overlap(predicted, gold) / both)

