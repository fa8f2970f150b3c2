"""Column functions against what Python itself does with the same texts."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from shelfgauge.functions import (
    WHITESPACE,
    contains_any,
    first_piece,
    grade_of,
    has_words,
    is_missing,
    or_dash,
    parse_float,
    priority_class,
    round_tenth,
    score_band,
    score_class,
    shown_issues,
    shows_nothing,
    split_list,
    strip,
    strip_fence,
    to_score,
    word_count,
)


def evaluate(spark, values, *columns, kind="string"):
    df = spark.createDataFrame([(at, value) for at, value in enumerate(values)], f"i int, c {kind}")
    rows = df.select("i", *[c.alias(f"r{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [row[1] if len(columns) == 1 else tuple(row[1:]) for row in rows]


def test_whitespace_is_what_python_calls_whitespace():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def _texts():
    rng = random.Random(7)
    alphabet = [*WHITESPACE, "a", "é", "語", "​", "﻿", ";", "-", "😀", "᠎", "\x00"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    spaced = [" ".join(["w"] * n) + tail for n in range(18, 23) for tail in ("", " ", "　")]
    return ["", " ", *WHITESPACE, *made, *spaced]


def test_strip_and_words_match_python(spark):
    texts = _texts()
    got = evaluate(spark, texts, strip("c"), word_count("c"), has_words("c", 20), is_missing("c"))
    for text, row in zip(texts, got):
        words = len(text.split())
        assert row == (text.strip(), words, words >= 20, not text.strip()), repr(text)


def test_text_functions_of_null(spark):
    columns = (strip("c"), word_count("c"), has_words("c", 1), is_missing("c"), split_list("c"))
    assert evaluate(spark, [None], *columns) == [(None, 0, False, True, [])]
    assert evaluate(spark, [None], has_words("c", 0)) == [True]


def _python_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_parse_float_matches_python(spark):
    fixed = """38 38.00 $38 1,000 1_000 1__0 _1 1_ 38d 38f 38D 1e3 1E+3 1e 1e1_0 +5 -5 .5 5. . -.5
        +-5 0x10 0x1p3 inf -inf +Infinity infinit nan -nan +NaN nanx 1e999 -1e999 1e-999 00.0 -0
        1_0.0_1 1._0 1_.0 1e_1 ½ ²""".split()
    pieces = ["1", "0", "_", ".", "e", "+", "-", "d", " "]
    made = ["".join(p) for n in range(1, 5) for p in itertools.product(pieces, repeat=n)]
    texts = ["", " ", " 7 ", " 7　", *fixed, *made]
    for text, got in zip(texts, evaluate(spark, texts, parse_float("c"))):
        want = _python_float(text)
        same = got == want or (want is not None and got is not None and math.isnan(want) and math.isnan(got))
        assert same, (text, want, got)


@pytest.mark.parametrize(
    "value, score",
    [
        ("85.7", 85),
        ("-3.9", -3),
        ("abc", 0),
        ("n/a", 0),
        ("", 0),
        (None, 0),
        ("1e3", 1000),
        ("inf", 0),
        ("-inf", 0),
        ("nan", 0),
        ("250", 250),
        ("1e300", 0),
        ("3000000000", 3000000000),
    ],
)
def test_to_score(spark, value, score):
    assert evaluate(spark, [value], to_score("c")) == [score]


def test_rounding_is_half_even(spark):
    values = [0.25, 0.31, 2.5, 74.25, 74.75, -0.25, 73.35, 0.05, 0.15, 2.0**52 + 1, 1e300, float("inf")]
    draw = random.Random(7)
    values += [k / 20 for k in range(-4000, 4000)] + [k + 0.05 for k in range(2000)]
    values += [draw.uniform(-100, 100) for _ in range(20_000)] + [draw.uniform(-1, 1) * 10 ** draw.randint(-5, 14) for _ in range(20_000)]
    assert evaluate(spark, values, round_tenth(F.col("c")), kind="double") == [
        round(v, 1) for v in values
    ]


def test_grade_and_band_edges(spark):
    scores = [-1, 44, 45, 49, 50, 59, 60, 64, 65, 74, 75, 79, 80, 89, 90, 100]
    got = evaluate(spark, scores, grade_of("c"), score_band("c"), score_class("c"), kind="int")
    assert [row[0] for row in got] == list("FFDDDDCCCCBBBBAA")
    assert [row[1] for row in got] == ["low"] * 4 + ["mid"] * 8 + ["high"] * 4
    assert [row[2] for row in got] == (
        ["low"] * 4 + ["low-m"] * 4 + ["mid"] * 4 + ["high"] * 4
    )


def test_lists(spark):
    texts = ["a; b ;; c;", "one", "", " ; ", "x;y"]
    assert evaluate(spark, texts, split_list("c")) == [["a", "b", "c"], ["one"], [], [], ["x", "y"]]
    got = evaluate(spark, [" a ; b", "", None, ";x", "solo"], first_piece("c"))
    assert got == ["a", "N/A", "N/A", "", "solo"]
    got = evaluate(spark, ["None", "nan", "NONE", "a; none", "", None], shown_issues("c"))
    assert got == [[], [], [], ["a", "none"], [], []]


def test_display_values(spark):
    texts = [None, "", " ", "nan", " 0 ", "0.0", "0.00", "None", "x"]
    assert evaluate(spark, texts, shows_nothing("c")) == [True] * 6 + [False] * 3
    assert evaluate(spark, texts, or_dash("c"))[:4] == ["—", "—", " ", "—"]
    more = ["\u3000nan\t", "nano", "00", "0 0", "0.0 ", "\u2003", "n", ""]
    got = evaluate(spark, more, shows_nothing("c"))
    assert got == [not t.strip() or t.strip() in ("nan", "0", "0.0") for t in more]
    got = evaluate(spark, ["HIGH", "Medium", "low", "urgent", None], priority_class("c"))
    assert got == ["high", "medium", "low", "low", "low"]


def test_contains_any(spark):
    texts = ["MEN'S boot", "men’s boot", "Dimensions", "tee", None]
    assert evaluate(spark, texts, contains_any("c", ("men's", "mens"))) == [
        True,
        False,
        True,
        False,
        False,
    ]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("```json\n[1]\n```", "[1]"),
        ("```\n[1]```", "[1]"),
        ("```JSON[1] 　```  ", "[1]"),
        ("  [1] ", "[1]"),
        ("[1]```", "[1]"),
        ("text ```json [1]```", "text ```json [1]"),
        ("```", ""),
        ("````", "`"),
        ("[1]\n```\n```", "[1]\n```"),
        ("```jsonx```", "x"),
    ],
)
def test_strip_fence(spark, raw, clean):
    assert evaluate(spark, [raw], strip_fence("c")) == [clean]
