"""Text helpers, all plain column expressions that stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# The code points Python treats as whitespace. Spark's own trim
# knows only U+0020 and a regular expression's \s only the ASCII blanks.
WHITESPACE = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)
# The same set for regular expressions. Ranges, with printable ASCII tried first: a class
# that lists single code points is tested one by one and several times slower.
_BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = f"[{_BLANKS}]"
_WORD = f"[!-~[^{_BLANKS}]]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.trim(_col(value), F.lit(WHITESPACE))


def is_missing(value: Column | str) -> Column:
    """Null or blank text; decided at the first character that is no blank."""
    value = _col(value)
    return value.isNull() | (F.ltrim(value, F.lit(WHITESPACE)) == "")


def word_count(value: Column | str) -> Column:
    """Number of whitespace-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(_col(value), F.lit(_WORD + "++")), F.lit(0))


def has_words(value: Column | str, n: int) -> Column:
    """Whether the text holds at least ``n`` words.

    Equal to ``word_count(value) >= n``, but the match is over as soon as the nth
    word starts, where counting would cut a long description into all its words.
    """
    if n <= 0:
        return F.lit(True)
    pattern = rf"\A{_BLANK}*+(?:{_WORD}++{_BLANK}++){{{n - 1}}}{_WORD}"
    return F.coalesce(_col(value).rlike(pattern), F.lit(False))


def contains_any(value: Column | str, needles: Iterable[str]) -> Column:
    """Case-insensitive substring test against a short list; false for null."""
    lowered = F.lower(_col(value))
    hit = F.lit(False)
    for needle in needles:
        hit = hit | lowered.contains(needle)
    return F.coalesce(hit, F.lit(False))


def split_list(value: Column | str) -> Column:
    """``"a; b;"`` -> ``["a", "b"]``: split on ``;``, trim, drop blanks. Null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(_col(value), F.lit("")), ";"), strip)
    return F.filter(parts, lambda part: part != "")


def first_piece(value: Column | str) -> Column:
    """Text before the first ``;``, or ``N/A`` where there is no text at all."""
    value = _col(value)
    empty = value.isNull() | (value == "")
    return F.when(empty, "N/A").otherwise(strip(F.substring_index(value, ";", 1)))


def strip_fence(value: Column | str) -> Column:
    """Remove a Markdown code fence around a model answer."""
    text = strip(value)
    # The opening and closing fence.
    text = F.regexp_replace(text, f"(?i)^```(?:json)?{_BLANK}*", "")
    text = F.regexp_replace(text, f"(?<!{_BLANK}){_BLANK}*+```\\z", "")
    return strip(text)
