"""Display bands of scores, priorities and issue lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfgauge.functions.text import WHITESPACE, _col, split_list, strip


def _steps(value: Column, steps: tuple[tuple[int, str], ...], rest: str) -> Column:
    chain = None
    for floor, label in steps:
        chain = (F if chain is None else chain).when(value >= floor, label)
    return chain.otherwise(rest)


def grade_of(score: Column | str) -> Column:
    """Letter grade of a 0-100 score."""
    return _steps(_col(score), ((90, "A"), (75, "B"), (60, "C"), (45, "D")), "F")


def score_band(score: Column | str) -> Column:
    """Three-way band used for table cells."""
    return _steps(_col(score), ((80, "high"), (50, "mid")), "low")


def score_class(score: Column | str) -> Column:
    """Four-way band used for the score badge of one product."""
    return _steps(_col(score), ((80, "high"), (65, "mid"), (50, "low-m")), "low")


def priority_class(priority: Column | str) -> Column:
    """``high`` or ``medium``; everything else, null included, is ``low``."""
    lowered = F.lower(_col(priority))
    return F.when(lowered.isin("high", "medium"), lowered).otherwise("low")


def shown_issues(issues: Column | str) -> Column:
    """Issue texts to list; empty where the text only stands for "nothing"."""
    issues = _col(issues)
    return F.when(F.lower(issues).isin("nan", "none"), F.array().cast("array<string>")).otherwise(
        split_list(issues)
    )


def shows_nothing(value: Column | str) -> Column:
    """Display rule for the MISSING badge: blank, or the text of a missing or zero number.

    Equal to a test of the trimmed text; long texts are told apart by their first character.
    """
    value = _col(value)
    lead = F.ltrim(value, F.lit(WHITESPACE))
    number = lead.startswith("0") | lead.startswith("nan")
    return value.isNull() | (lead == "") | (number & strip(value).isin("nan", "0", "0.0"))


def or_dash(value: Column | str) -> Column:
    """The value itself, or a dash for null, ``""`` and ``nan``."""
    value = _col(value)
    return F.when(value.isNull() | value.isin("", "nan"), "—").otherwise(value)
