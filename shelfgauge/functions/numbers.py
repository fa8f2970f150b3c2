"""Numeric parsing and rounding with Python's rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfgauge.functions.text import _col, strip

_DIGITS = r"\d+(?:_\d+)*"
_DECIMAL = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_PLAIN = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
_NAMED = r"(?i)^[+-]?(?:inf|infinity)$"
_NAN = r"(?i)^[+-]?nan$"


def parse_float(value: Column | str) -> Column:
    """Double for every text Python's ``float`` accepts, else null.

    The JVM parser differs in both directions: it takes ``38d`` and hexadecimal
    notation and refuses ``1_000``. So the shape is checked first.
    """
    text = strip(value)
    return (
        F.when(text.rlike(_DECIMAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike(_NAMED), text.try_cast("double"))
        .when(text.rlike(_NAN), F.lit(float("nan")))
    )


def number_or_zero(value: Column | str) -> Column:
    """Double of a plain decimal number, fractions kept; anything else becomes 0.

    Unlike :func:`parse_float`, names of infinities and digit groups are no numbers here.
    """
    text = strip(_col(value).cast("string"))
    return F.coalesce(F.when(text.rlike(_PLAIN), text.try_cast("double")), F.lit(0.0))


def to_score(value: Column | str) -> Column:
    """Whole number toward zero; anything that is no plain decimal number becomes 0."""
    number = number_or_zero(value)
    whole = F.when(F.abs(number) < F.lit(float(2**63)), number.try_cast("bigint"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def round_tenth(value: Column) -> Column:
    """Half-even rounding to one decimal of the binary value, as Python's ``round(x, 1)``.

    73.35 is a little less than its decimal text says, so it becomes 73.3. Ten times the
    value is taken apart into a double and what that leaves out, exactly; ties are judged
    on both.
    """
    x = value.cast("double")
    tens = x * 10.0
    shifted = x * float(2**27 + 1)
    high = shifted - (shifted - x)
    left_out = (high * 10.0 - tens) + (x - high) * 10.0
    below = F.floor(tens)
    over_half = (tens - below.cast("double") - 0.5) + left_out
    up = (over_half > 0) | ((over_half == 0) & (below % 2 != 0))
    rounded = (below + F.when(up, 1).otherwise(0)).cast("double") / 10.0
    # beyond 2 ** 52 there are no fractions, and names of numbers stay
    return F.when(F.isnan(x) | (F.abs(x) >= float(2**52)), x).otherwise(rounded)
