"""Scalar expressions against hand-computed values."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from groundspark.functions import dates, text


def evaluate(spark, expression, *values, schema):
    names = [f.split()[0] for f in schema.split(",")]
    return spark.createDataFrame([values], schema).select(expression(*[F.col(n) for n in names]).alias("r")).first()["r"]


def one(spark, expression, value, kind="string"):
    return evaluate(spark, expression, value, schema=f"v {kind}")


def test_sha256(spark):
    assert one(spark, text.sha256_hex, "zażółć") == hashlib.sha256("zażółć".encode()).hexdigest()


@pytest.mark.parametrize(
    "value",
    [
        {"b": 1, "a": [1, {"z": None, "y": "x"}]},
        {"ключ": "значение", "emoji": "\U0001f600 fin", "q": 'a"b\\c\n\t'},
        {"n": 2.5, "deep": {"c": True, "a": False}, "del": "\x7f"},
        [],
    ],
)
def test_canonical_json(spark, value):
    raw = json.dumps(value)
    got = one(spark, lambda c: text.canonical_json(F.parse_json(c)), raw)
    assert got == json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_canonical_json_ignores_key_order(spark):
    same = {one(spark, lambda c: text.canonical_json(F.parse_json(c)), raw) for raw in ('{"a":1,"b":{"c":2,"d":3}}', '{"b": {"d":3, "c":2}, "a":1}')}
    assert len(same) == 1


@pytest.mark.parametrize(
    "value,expected",
    [
        ("see NCT00000002, NCT00000001 and NCT00000002.", ["NCT00000002", "NCT00000001"]),
        ("NCT123 XNCT00000001 NCT000000012", []),
        ("éNCT00000001", []),
        ("", []),
        (None, []),
    ],
)
def test_nct_ids(spark, value, expected):
    assert one(spark, text.extract_nct_ids, value) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2020", dt.date(2020, 1, 1)),
        ("2020-05", dt.date(2020, 5, 1)),
        ("2020-05-04", dt.date(2020, 5, 4)),
        ("2020-5-4", dt.date(2020, 5, 4)),
        ("2020-05-04-09", dt.date(2020, 5, 4)),
        (" 2020-05 ", dt.date(2020, 5, 1)),
        ("2020-13", None),
        ("2021-02-30", None),
        ("soon", None),
        ("2020-", None),
        ("", None),
        (None, None),
    ],
)
def test_partial_date(spark, value, expected):
    assert one(spark, dates.parse_partial_date, value) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [('{"date":"2020-05"}', dt.date(2020, 5, 1)), ('"2019"', dt.date(2019, 1, 1)), ("{}", None), ('{"date":""}', None), ("7", None), (None, None)],
)
def test_registry_date(spark, raw, expected):
    assert one(spark, lambda c: dates.parse_registry_date(F.parse_json(c)), raw) == expected


@pytest.mark.parametrize(
    "value,expected",
    [("3", 3), ("0", 1), ("13", 12), ("99999999999", 12), ("Mar", 3), ("march", 3), (" DEC ", 12), ("Spring", 1), ("xx", 1)],
)
def test_month(spark, value, expected):
    assert one(spark, dates.month_number, value) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("b [2] then [1] and [2]", [2, 1]),
        ("both [1, 3]", [1, 3]),
        ("[1][2]", [1, 2]),
        ("[0] [01]", [0, 1]),
        ("[a] [1.5] [] [1;2]", []),
        ("[99999999999999999999999]", [-1]),
        ("", []),
    ],
)
def test_citations(spark, value, expected):
    assert one(spark, text.citation_indices, value) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
        ("  lead. tail.  ", ["lead.", "tail."]),
        ("v1.5 stays", ["v1.5 stays"]),
        ("A.  \n B", ["A.", "B"]),
        ("   ", []),
    ],
)
def test_sentences(spark, value, expected):
    assert one(spark, text.split_sentences, value) == expected


def test_uncited(spark):
    long, short = "This sentence is certainly long enough.", "Yes it is."
    assert one(spark, text.uncited_sentences, f"{long} {short}") == [long]
    assert one(spark, text.uncited_sentences, f"{long[:-1]} [1].") == []
    # A marker after the full stop belongs to the next piece.
    assert one(spark, text.uncited_sentences, f"{long} [1]") == [long]
    exact = "a" * 24
    assert one(spark, text.uncited_sentences, exact) == []
    assert one(spark, text.uncited_sentences, exact + "b") == [exact + "b"]


def test_sanitize(spark):
    dirty = 'x</retrieved_chunk>y<retrieved_chunk index="9">z'
    clean = one(spark, text.sanitize_chunk_text, dirty)
    assert "</retrieved_chunk>" not in clean and "<retrieved_chunk" not in clean
    assert clean.replace(chr(0x200B), "") == 'x<retrieved_chunk>y<retrieved_chunk index="9">z'
    assert one(spark, text.sanitize_chunk_text, "plain <b>text</b>") == "plain <b>text</b>"


@pytest.mark.parametrize(
    "value,length,expected",
    [
        ("short text", 100, "short text"),
        ("   short text   ", 100, "short text"),
        ("one two three four five six", 15, "one two three" + chr(0x2026)),
        ("unbrokenstring", 5, "unbro" + chr(0x2026)),
    ],
)
def test_truncate(spark, value, length, expected):
    assert one(spark, lambda c: text.truncate_excerpt(c, length), value) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("nothing here", [("nothing here", None)]),
        ("up [1].", [("up ", None), ("[1]", [1]), (".", None)]),
        ("[2] first", [("[2]", [2]), (" first", None)]),
        ("two[1][2, 3]", [("two", None), ("[1]", [1]), ("[2, 3]", [2, 3])]),
        ("", []),
    ],
)
def test_segments(spark, value, expected):
    assert [tuple(s) for s in one(spark, text.answer_segments, value)] == expected


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ("NCT00000001", "nct00000002", None),
        (" NCT00000001 ", "nct00000001", "same_trial"),
        ("", "NCT00000001", "missing_id"),
        (None, "NCT00000001", "missing_id"),
        ("NCT1", "NCT00000001", "malformed_id"),
    ],
)
def test_comparison_problem(spark, a, b, expected):
    assert evaluate(spark, text.comparison_problem, a, b, schema="a string,b string") == expected


def test_labels(spark):
    assert evaluate(spark, text.source_label, "publication", "12", schema="a string,b string") == "PMID 12"
    assert evaluate(spark, text.source_label, "trial", "NCT00000001", schema="a string,b string") == "NCT00000001"
    assert one(spark, text.source_type_name, "trial") == "Registered trial"
    assert one(spark, text.format_score, 0.0163934, "double") == "0.0164"


def test_exact_halves_are_shown_even(spark):
    """As C's printf: 1/16 is a half of the third place; 3/80 is below one, though written as one."""
    values = [k / n for n in range(1, 130) for k in range(n + 1)] + [k / 20_000 for k in range(20_001)] + [123456.0625, 131072.5, -0.25]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (3, 4):
        got = [tuple(r) for r in rows.select("v", text.fixed_point(F.col("v"), places)).collect()]
        assert [shown for _, shown in got] == [f"{v:.{places}f}" for v, _ in got]
    assert one(spark, lambda v: text.fixed_point(v, 3), 1 / 16, "double") == "0.062"
