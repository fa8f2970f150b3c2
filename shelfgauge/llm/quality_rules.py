"""Quality rules (3): clean line by line, then reject texts that lost too much.

A line fails by punctuation (many symbols or exclamation marks for its words, or short
without an end mark), navigation (a row of menu entries of few words each), boilerplate
(licence, cookie and rights notices; a line of over ``NOTICE_WORDS`` words only mentions
them) or repetition (equal to an earlier line with a word). Failed lines go. A text is
rejected if the base rules fail (under ten words, or over a fifth of its words in repeated
windows of five), if over half of its words went with failed lines, or if no words are left.
Notices go without counting as a loss, since good texts carry them. A text all of whose lines
would go as notices stays as it is: there is nothing beside which they would be notices, as in
a text of one sentence that mentions one.

Null and empty texts have no words and are rejected. All rows are judged alone, so
repeated rows, null ids and other columns, whatever their names, make no difference.
Repeated windows are counted in arrays of numbers, which keeps very long texts small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfgauge.llm.common import SPACE, map_rows, pieces, whole

LEAST_WORDS = 10
WINDOW = 5
#: Per cent of words in repeated windows, and of words lost with lines, that are borne.
MOST_REPEATED = 20
MOST_LOST = 50
#: A line with fewer words needs an end mark.
SHORT = 5
#: A notice is a line of at most so many words; a menu entry has at most so many.
NOTICE_WORDS = 20
ENTRY_WORDS = 4

#: Symbols that count, marks that end a line, menu entries, notices.
SYMBOLS = "#*$%&|<>"
END = r"""[.!?:;…。！？"'”’»)\]]\s*$"""
MENU = r"(home|menu|login|log in|sign in|sign up|next|previous|back|search|about us|contact us|skip to content)"
NOTICES = (
    "all rights reserved", "click here", "cookie policy", "copyright (c)", "enable javascript",
    "is licensed", "licensed under", "privacy policy", "subscribe to", "terms of service",
    "terms of use", "use of cookies", "©",
)
MENU_LINE = rf"(?i)^\s*{MENU}(\s*[|>»•·/-]\s*.*|\s*)$"

_WORD = re.compile(rf"[^{SPACE}]+")
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_END = re.compile(END)
_MENU_LINE = re.compile(MENU_LINE)
_BAR = re.compile(rf"[|>»•·/]|(?<![^{SPACE}])-(?![^{SPACE}])")


def _short_entries(line: str) -> bool:
    """Whether bars cut the line into entries of few words; hyphens within words do not."""
    return all(len(_WORD.findall(entry)) <= ENTRY_WORDS for entry in _BAR.split(line))


def line_fails(line: str, n_words: int) -> bool:
    """The verdict on a line with words, from the line alone."""
    return (
        4 * len(_SYMBOL.findall(line)) > n_words
        or 2 * line.count("!") > n_words
        or (n_words < SHORT and not _END.search(line))
        or (bool(_MENU_LINE.search(line)) and _short_entries(line))
    )


def _has_notice(text: str) -> bool:
    lowered = text.lower()
    return any(notice in lowered for notice in NOTICES)


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs."""
    return np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of words that occurs twice or more."""
    if len(words) <= window:
        return 0
    numbers = {word: number for number, word in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    twos = _paired(codes[:-1], codes[1:])
    fours = _paired(twos[:-2], twos[2:])
    fives = _paired(fours[:-1], codes[4:])
    starts = np.bincount(fives)[fives] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(starts)] += starts
    edges[window : window + len(starts)] -= starts
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judge(text: str) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """Counts, verdicts and the text of the lines that stay."""
    words: list[str] = []
    seen: set[str] = set()
    left: list[str] = []
    lost = duplicates = stay = 0
    some_notice = _has_notice(text)
    for line in text.split("\n"):
        own = _WORD.findall(line)
        words += own
        again = bool(own) and line in seen
        duplicates += again
        notice = some_notice and len(own) <= NOTICE_WORDS and _has_notice(line)
        if own and (again or notice or line_fails(line, len(own))):
            lost += 0 if notice else len(own)
        else:
            left.append(line)
            stay += len(own)
        if own:
            seen.add(line)
    n = len(words)
    repeats = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    if not stay and not lost:
        left = text.split("\n")
    kept = not failed and (stay > 0 or not lost) and 100 * lost <= MOST_LOST * n
    symbols = len(_SYMBOL.findall(text))
    return n, sum(map(len, words)), symbols, duplicates, repeats, failed, kept, lost, "\n".join(left)


VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lost_words long"
)


def judge_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: id, counts, verdicts, words lost with lines."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {VERDICT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ids, texts in pieces(batches, "doc_id", "text"):
            for key, value in zip(ids, texts):
                yield key, *judge(value)[:-1]

    return map_rows(narrow, schema, run)


def clean(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The rows that are kept, with their columns; ``text`` without the lines that failed.

    A column ``chars``, where there is one, gets the length of the cleaned text.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                judged = [judge(value or "") for value in part.column(place).to_pylist()]
                part = part.set_column(
                    place, batch.schema.field(place), pa.array([j[-1] for j in judged], pa.string())
                )
                yield part.filter(pa.array([j[6] for j in judged], pa.bool_()))

    out = docs.mapInArrow(run, schema)
    if chars in docs.columns:
        kind = schema[chars].dataType
        out = out.withColumn(chars, F.length(text).cast(kind))
    return out
