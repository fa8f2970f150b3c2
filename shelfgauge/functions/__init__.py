"""Column functions: text, numbers and display bands."""

from shelfgauge.functions.bands import (
    grade_of,
    or_dash,
    priority_class,
    score_band,
    score_class,
    shown_issues,
    shows_nothing,
)
from shelfgauge.functions.numbers import number_or_zero, parse_float, round_tenth, to_score
from shelfgauge.functions.text import (
    WHITESPACE,
    contains_any,
    first_piece,
    has_words,
    is_missing,
    split_list,
    strip,
    strip_fence,
    word_count,
)

__all__ = [
    "WHITESPACE",
    "contains_any",
    "first_piece",
    "grade_of",
    "has_words",
    "is_missing",
    "number_or_zero",
    "or_dash",
    "parse_float",
    "priority_class",
    "round_tenth",
    "score_band",
    "score_class",
    "shown_issues",
    "shows_nothing",
    "split_list",
    "strip",
    "strip_fence",
    "to_score",
    "word_count",
]
