"""Spelling variant grouping (13): PartEnum signatures on letter multisets.

Words that differ by one inserted, deleted or replaced character have letter multisets
that differ in at most two places, if a multiset is read as a binary vector with a place
for each letter and occurrence (first ``a``, second ``a``, ...). The places are dealt to
``PARTS`` parts by a hash. Two differing places lie in at most two parts, so near words
agree outside of some two parts: a word's signatures are the hashes of its multiset
without each pair of parts, and near words share at least one. Equal signatures meet in
a shuffle, and each group is verified: a word is filed under each of its forms with one
character masked and looked up under each with one character less, so that the work is
linear in the group. A pair that shares several signatures counts in the first of them.
Groups of over ``LARGE`` words, or as many characters as ``LARGE`` words of usual length,
are dealt anew by equal halves: one changed character leaves the first or the last half
of a word as it was.

Words are runs of letters of whole texts, ASCII letters in lower case, of at least
``SHORTEST`` characters after one in 31 has lost a character by the given rule, that
occur ``LEAST`` times or more. Null texts have no words; a null id counts as the empty
text in the rule; repeated rows count each. A word of any length is a word; over ``LONG``
characters, words are filed by halves and compared directly. Ties go to the smaller
word in code-point order. An empty table gives an empty result. Other columns make no
difference.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfgauge.llm.common import map_rows, pieces, store, whole

SHORTEST = 7
LEAST = 2
#: A form occurs at least so many times as often as the word.
RATIO = 10
#: Parts of the letter vector; ``PARTS * (PARTS - 1) / 2`` signatures a word.
PARTS = 5
#: Words of a signature that are verified together.
LARGE = 50_000
LONG = 64
#: Distinct words a task counts before it hands them on.
HELD = 300_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MASK = (1 << 64) - 1
_DROPPED = list(combinations(range(PARTS), 2))
_PLACE = {pair: at for at, pair in enumerate(_DROPPED)}


def variant(doc_id: str, run: str) -> str:
    """The run, without one of its characters where the rule says so."""
    value = zlib.crc32(f"{doc_id}:{run}".encode())
    if value % 31:
        return run
    at = value % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST) -> DataFrame:
    """``word, n`` of all words of all texts."""
    narrow = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), whole(text).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")
        counts: Counter[str] = Counter()
        for ids, texts in pieces(batches, "doc_id", "text"):
            for key, value in zip(ids, texts):
                for found, n in Counter(runs.findall(value)).items():
                    word = found.lower() if found.isascii() else found.translate(_LOWER)
                    word = variant(key, word)
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield from counts.items()
                    counts.clear()
        yield from counts.items()

    return map_rows(narrow, "word string, n long", run).groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def part(letter: str, occurrence: int) -> int:
    """The part of the letter vector in which a place lies."""
    return _mixed(ord(letter) << 32 | occurrence) % PARTS


class Vectors:
    """Sums of hashes of a word's places by part, and the signatures made of them."""

    def __init__(self) -> None:
        self.places: dict[tuple[str, int], tuple[int, int]] = {}

    def _sums(self, word: str) -> list[int]:
        sums, seen = [0] * PARTS, {}
        for letter in word:
            seen[letter] = at = seen.get(letter, 0) + 1
            place = self.places.get((letter, at))
            if place is None:
                place = part(letter, at), _mixed(_mixed(ord(letter)) + at & _MASK)
                if len(self.places) < 100_000:
                    self.places[letter, at] = place
            sums[place[0]] += place[1]
        return [total & _MASK for total in sums]

    def signatures(self, words: list[str]) -> np.ndarray:
        """Per word its signatures; the lowest byte is the number of the dropped pair."""
        sums = np.array([self._sums(word) for word in words], np.uint64).reshape(-1, PARTS)
        total = sums.sum(axis=1, dtype=np.uint64)
        out = np.empty((len(words), len(_DROPPED)), np.uint64)
        for at, (a, b) in enumerate(_DROPPED):
            rest = (total - sums[:, a] - sums[:, b]) * np.uint64(0x9E3779B97F4A7C15)
            out[:, at] = (rest ^ (rest >> np.uint64(29))) & np.uint64(_MASK - 255) | np.uint64(at)
        return out.view(np.int64)


def _signed(words: DataFrame) -> DataFrame:
    """A row ``sig, word, n`` for each signature of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                signatures = vectors.signatures(some.column("word").to_pylist())
                rows = pa.array(np.repeat(np.arange(some.num_rows), len(_DROPPED)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signatures.ravel()), some.column("word").take(rows), some.column("n").take(rows)],
                    names=["sig", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "sig long, word string, n long")


def is_near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes ``a`` to ``b``."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b) + 1 or a == b:
        return False
    at = _common(a, b)
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def halves(word: str) -> Iterator[tuple[int, int, str]]:
    """Length of the longer word of a pair, side, and the half that may be equal.

    Words of a pair are as long as the longer one or one character less.
    """
    for longer in (len(word), len(word) + 1):
        half = (longer - 1) // 2
        yield longer, 0, word[:half]
        yield longer, 1, word[len(word) - half :]


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Each pair of near words among distinct ones, once."""
    if len(words) <= 6:
        for i, j in combinations(range(len(words)), 2):
            if is_near(words[i], words[j]):
                yield i, j
        return
    place = {word: i for i, word in enumerate(words)}
    masked: dict[str, list[int]] = {}
    by_half: dict[tuple[int, int, str], list[int]] = {}
    for i, word in enumerate(words):
        if len(word) <= LONG:
            less = set()
            for at in range(len(word)):
                before, after = word[:at], word[at + 1 :]
                masked.setdefault(f"{before}*{after}", []).append(i)
                less.add(before + after)
            for other in less:
                if (j := place.get(other)) is not None:
                    yield i, j
        if len(word) >= LONG:
            for key in halves(word):
                if key[0] > LONG:
                    by_half.setdefault(key, []).append(i)
    for found in masked.values():
        if len(found) > 1:
            yield from combinations(found, 2)
    for (longer, side, _), found in by_half.items():
        for i, j in combinations(found, 2):
            if _first_half(words[i], words[j], longer, side) and is_near(words[i], words[j]):
                yield i, j


def _first_half(a: str, b: str, longer: int, side: int) -> bool:
    """Whether a pair counts under this half, the first that its words share."""
    half = (longer - 1) // 2
    return max(len(a), len(b)) == longer and not (side and a[:half] == b[:half])


def first_shared(a: str, b: str) -> int:
    """The number of the first dropped pair of parts outside of which near words agree."""
    if len(a) < len(b):
        a, b = b, a
    at = _common(a, b)
    parts = {part(a[at], a.count(a[at]))}
    if len(a) == len(b):
        parts.add(part(b[at], b.count(b[at])))
    return min(place for pair, place in _PLACE.items() if parts <= set(pair))


def _verified(words: list[str], ns: list[int], pairs: Iterator[tuple[int, int]]) -> Iterator[tuple]:
    """``word, n_near, best_n, best`` of the words that the pairs hold."""
    counts, best = Counter(), {}
    for pair in pairs:
        for i, j in (pair, pair[::-1]):
            counts[i] += 1
            rank = -ns[j], words[j]
            if i not in best or rank < best[i]:
                best[i] = rank
    for i, n in counts.items():
        yield words[i], n, -best[i][0], best[i][1]


def _groups(batches: Iterator[pa.RecordBatch], key: str, large: int) -> Iterator[tuple[int, pa.Table, bool]]:
    """Sorted rows by key: the key, its rows if there are two or more, and whether these go on.

    Of a group beyond ``large`` rows or ``12 * large`` characters all rows come, in parts.
    """
    held, held_key, going = None, None, False
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        keys = rows.column(key).to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        starts, sizes = bounds[:-1], np.diff(bounds)
        whole_groups = (sizes > 1) & (np.arange(len(sizes)) < len(sizes) - 1)
        if going and len(sizes) > 1:
            yield held_key, rows.slice(0, sizes[0]), True
            whole_groups[0], going = False, False
        picked = rows.filter(pa.array(np.repeat(whole_groups, sizes)))
        at = 0
        for start, size in zip(starts[whole_groups], sizes[whole_groups]):
            yield int(keys[start]), picked.slice(at, size), False
            at += size
        held, held_key = rows.slice(bounds[-2]), int(keys[-1])
        if going or held.num_rows > large or held.nbytes > 12 * 8 * large:
            yield held_key, held, True
            held, going = held.slice(0, 0), True
    if held is not None and held.num_rows > 1 - going:
        yield held_key, held, going


#: Rows of verified groups, and with ``sig`` those of groups that are too large.
_FOUND = "word string, n_near long, best_n long, best string, n long, sig long"


def _verify(signed: DataFrame, large: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for sig, rows, going in _groups(batches, "sig", large):
            words, ns = rows.column("word").to_pylist(), rows.column("n").to_pylist()
            if going:
                yield from ((word, None, None, None, n, sig) for word, n in zip(words, ns))
                continue
            drop = sig & 255
            pairs = (p for p in near_pairs(words) if first_shared(words[p[0]], words[p[1]]) == drop)
            yield from ((*row, None, None) for row in _verified(words, ns, pairs))

    return map_rows(signed.repartition("sig").sortWithinPartitions("sig"), _FOUND, run)


def _verify_halves(rest: DataFrame) -> DataFrame:
    """The same for the rows of large groups, dealt by equal halves."""
    schema = "sig long, word string, n long, longer long, side int, half string"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part_ in pieces(batches, "sig", "word", "n"):
            for sig, word, n in zip(*part_):
                yield from ((sig, word, n, *key) for key in halves(word))

    dealt = map_rows(rest.select("sig", "word", "n"), schema, deal)
    keyed = dealt.withColumn("key", F.xxhash64("sig", "longer", "side", "half"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows, _ in _groups(batches, "key", 1 << 62):
            words, ns = rows.column("word").to_pylist(), rows.column("n").to_pylist()
            keys = set(zip(*(rows.column(name).to_pylist() for name in ("sig", "longer", "side"))))
            # Rows of several keys that share a hash are told apart here.
            for sig, longer, side in keys:
                mine = [
                    i for i in range(len(words))
                    if rows.column("sig")[i].as_py() == sig and rows.column("longer")[i].as_py() == longer
                    and rows.column("side")[i].as_py() == side
                ] if len(keys) > 1 else range(len(words))
                own, own_n = [words[i] for i in mine], [ns[i] for i in mine]
                pairs = (
                    p for p in near_pairs(own)
                    if _first_half(own[p[0]], own[p[1]], longer, side)
                    and first_shared(own[p[0]], own[p[1]]) == sig & 255
                )
                yield from ((*row, None, None) for row in _verified(own, own_n, pairs))

    return map_rows(
        keyed.drop("half").repartition("key").sortWithinPartitions("key"), _FOUND, run
    )


def near_words(words: DataFrame, large: int = LARGE) -> DataFrame:
    """``word, n_near, best``: how many words are near, and the least of ``-n, word`` among them.

    ``words`` has distinct words and their counts. Words without a near one are left out.
    """
    found = store(_verify(_signed(words), large), "near-words")
    rest = found.where("sig is not null")
    verified = found.where("sig is null")
    if not rest.isEmpty():
        verified = verified.unionByName(_verify_halves(rest))
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), F.col("best").alias("word")))
    return verified.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def _roots(linked: DataFrame, most: int, ratio: int) -> DataFrame:
    """``word, root`` of the words that have a form.

    Each step multiplies the count by ``ratio``, so no word is further from its root than
    the counts allow; each round doubles the steps taken.
    """
    roots = linked.select("word", F.col("form").alias("root"))
    steps = max(1, math.ceil(math.log(max(most, 2), max(2, ratio))))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return roots


def group_variants(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shortest: int = SHORTEST,
    least: int = LEAST,
    ratio: int = RATIO,
    large: int = LARGE,
) -> DataFrame:
    """Per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of largest ``n`` if that is at least ``ratio`` times the
    word's, else null; ``root`` is the last of the chain of forms.
    """
    words = store(count_words(docs, text, doc_id, shortest).where(F.col("n") >= least), "words")
    known = F.col("best.word"), -F.col("best.rank")
    is_form = -F.col("best.rank") >= F.lit(ratio) * F.col("n")
    formed = store(
        words.join(near_words(words, large), "word", "left").select(
            "word",
            F.when(is_form, known[0]).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, known[1]).alias("form_n"),
        ),
        "spelling-forms",
    )
    most = formed.agg(F.max("n")).first()[0] or 0
    roots = _roots(formed.where("form is not null"), most, max(2, ratio))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
