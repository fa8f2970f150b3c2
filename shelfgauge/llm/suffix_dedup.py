"""Suffix-array dedup (7): remove every byte of a 200-byte string that occurs twice.

Suffixes are sorted at anchors only. A window of 200 bytes chooses the 64-byte strings
within it whose hash is least; equal windows choose alike, wherever they are, so every
repeated window holds an anchor at the same place as its copies. About one position in
seventy is an anchor. Anchors meet by the hash of their 64 bytes, and most are alone.

The context of an anchor is all that its windows can reach: 136 bytes before it, 200 from
it on. Anchors with equal contexts are covered by them in full, whatever their number, so
they are counted, not compared. What is left are anchors that share 64 bytes but not the
context, at the edges of repeats. Their suffixes are sorted group by group: multikey
quicksort down to ``SHALLOW`` bytes beyond those that the group shares, then a blind trie
for each set that still agrees. The sort gives the bytes that neighbours share to the
right; with those shared to the left, an anchor knows how far repeats cover it. Groups of
over ``LARGE`` contexts are not gathered: each of their windows is hashed and counted in
a shuffle. Time is linear in the contexts at any size of a group, but for a logarithm.

What decides equality are two 64-bit hashes, of the anchor and of its context, from sums of
one kind: where anchors agree, the other 64 bits decide. Texts are read once, a part at a
time, and kept compressed in a written table until the bytes are removed.

Null texts count as empty, texts under 200 bytes lose nothing. Null and repeated ids are
carried through; equal rows are copies of each other and lose all their windows. An empty
table gives an empty result. Other columns make no difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from shelfgauge.llm.common import map_rows, numbered, pieces, store, whole

WINDOW = 200
GRAM = 64
#: Bytes before an anchor that a window with the anchor can hold.
BEFORE = WINDOW - GRAM
#: Windows looked at together; longer texts are read in such parts.
PART = 1 << 18
SHALLOW = 16
#: Groups of more contexts are compared window by window length, those of more than
#: ``LARGE`` not in memory.
PAIRS = 32
LARGE = 20_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


class Hasher:
    """Hashes of all substrings from prefix sums, modulo 2 to the 64."""

    def __init__(self) -> None:
        draw = np.random.default_rng(7)
        self.values = draw.integers(0, 1 << 64, 256, np.uint64)
        size = PART + 2 * (WINDOW + BEFORE) + 2
        self.powers = self._powers(_MULTIPLIER, size)
        self.inverses = self._powers(_INVERSE, size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((sums[ends] - sums[starts]) * self.inverses[starts])

    def grams(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return _mixed((sums[length:] - sums[:n]) * self.inverses[:n])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Best of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def chosen(grams: np.ndarray, width: int = BEFORE + 1) -> np.ndarray:
    """Places of the grams that are least in some run of ``width``."""
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero(most == grams)


def anchors(raw: np.ndarray, hasher: Hasher) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a text, part by part: hashes of gram and context, place, bytes from the place on."""
    n = len(raw)
    known = np.empty(0, np.int64)
    for first in range(0, n - WINDOW + 1, PART):
        last = min(first + PART + WINDOW - 1, n)  # end of the last window of this part
        low, high = max(0, first - BEFORE), min(n, last + WINDOW)
        sums = hasher.sums(raw[low:high])
        grams = hasher.grams(sums, GRAM)
        own = grams[first - low : last - low - GRAM + 1]
        places = chosen(own) + (first - low)
        # Parts overlap by less than a window; what both choose counts once.
        places = places[~np.isin(places + low, known)]
        before = np.minimum(BEFORE, places + low)
        reach = np.minimum(WINDOW, n - low - places)
        context = hasher.of(sums, places - before, places + reach)
        context = _mixed(context ^ (before * 1000 + reach).astype(np.uint64))
        known = places + low
        yield grams[places].view(np.int64), context.view(np.int64), known, reach


def _alike(gram: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair occurs first, and which of them each pair is."""
    order = np.lexsort((context, gram))
    gram, context = gram[order], context[order]
    new = np.ones(len(order), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _reached(place: np.ndarray, reach: np.ndarray) -> list[tuple[int, int]]:
    """The contexts of anchors as spans, overlapping ones as one."""
    place, reach = place[order := np.argsort(place)], reach[order]
    starts, ends = place - np.minimum(BEFORE, place), place + reach
    whole_window = ends - starts >= WINDOW
    starts, ends = starts[whole_window], ends[whole_window]
    gaps = np.flatnonzero(starts[1:] > ends[:-1])
    if not len(starts):
        return []
    return list(zip(starts[[0, *(gaps + 1)]].tolist(), ends[[*gaps, -1]].tolist()))


def folded(raw: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Columns ``gram, context, place, reach, n`` of a text's distinct anchors, and the spans
    of those that occur again in it.

    Each part is folded by itself first: a text that repeats itself holds few distinct anchors,
    however many there are, so memory is that of a part.
    """
    kept, cover = [], []
    for gram, context, place, reach in anchors(raw, hasher):
        first, which = _alike(gram, context)
        n = np.bincount(which, minlength=len(first))
        again = n[which] > 1
        cover += _reached(place[again], reach[again])
        kept.append(np.stack([gram[first], context[first], place[first], reach[first], n]))
    if not kept:
        return np.empty((5, 0), np.int64), []
    rows = np.concatenate(kept, axis=1)
    if len(kept) > 1:
        first, which = _alike(rows[0], rows[1])
        again = np.bincount(which)[which] > 1
        cover += _reached(rows[2][again], rows[3][again])
        n = np.zeros(len(first), np.int64)
        np.add.at(n, which, rows[4])
        rows = rows[:, first]
        rows[4] = n
    return rows, merged(cover)


def _read(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row per document, written: its text, compressed, and its anchors.

    Equal contexts within the text are covered here and leave one anchor, with their number.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes long, sha string, packed binary, cover array<long>, "
        "gram array<long>, context array<long>, place array<long>, reach array<long>, n array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hasher, packer = Hasher(), zstandard.ZstdCompressor(level=3)
        for ids, texts in pieces(batches, "doc_id", "text", rows=64):
            for key, value in zip(ids, texts):
                raw = value.encode("utf-8", "surrogatepass")
                rows, cover = folded(np.frombuffer(raw, np.uint8), hasher)
                yield (
                    key, len(raw), hashlib.sha256(raw).hexdigest(), packer.compress(raw),
                    [at for span in cover for at in span],
                    *rows,
                )

    return numbered(map_rows(narrow, schema, run), "texts")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of at least a window, in order, overlapping or touching ones as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if end - start < WINDOW:
            continue
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    differ = (int.from_bytes(a) ^ int.from_bytes(b)).bit_length()
    return n - (differ + 7) // 8


class Node:
    """A branch of a blind trie: the depth it branches at, and a child per byte there."""

    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict[int, Node | int]) -> None:
        self.depth, self.children = depth, children


def _byte(text: bytes, depth: int) -> int:
    return text[depth] if depth < len(text) else -1


def blind_trie(texts: list[bytes], which: list[int]) -> list[tuple[int, int]]:
    """``which`` sorted by text; with each, the bytes it shares with the one before.

    A trie keeps branching depths only. A new text goes down blindly to any leaf, is
    compared with it once, and then branches off at the depth where they differ. Equal
    texts are listed one after the other.
    """
    same: dict[int, list[int]] = {which[0]: [which[0]]}
    root: Node | int = which[0]
    for new in which[1:]:
        text, node = texts[new], root
        while isinstance(node, Node):
            node = node.children.get(_byte(text, node.depth)) or next(iter(node.children.values()))
            node = node if isinstance(node, Node) else node - 1
        common = shared(text, texts[node])
        if common == len(text) == len(texts[node]):
            same[node].append(new)
            continue
        same[new] = [new]
        above, at = None, root
        while isinstance(at, Node) and at.depth < common:
            above, at = at, at.children[_byte(text, at.depth)]
            at = at if isinstance(at, Node) else at - 1
        if isinstance(at, Node) and at.depth == common:
            at.children[_byte(text, common)] = new + 1
            continue
        branch = Node(common, {_byte(text, common): new + 1})
        branch.children[_byte(texts[node], common)] = at if isinstance(at, Node) else at + 1
        if above is None:
            root = branch
        else:
            above.children[_byte(text, above.depth)] = branch
    out: list[tuple[int, int]] = []
    stack: list[tuple[Node | int, int]] = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, Node):
            order = sorted(node.children, reverse=True)
            for place, byte in enumerate(order):
                child = node.children[byte]
                child = child if isinstance(child, Node) else child - 1
                stack.append((child, node.depth if place < len(order) - 1 else depth))
        else:
            first, *rest = same[node]
            out.append((first, depth))
            out += [(other, len(texts[other])) for other in rest]
    return out


def deep_shallow(texts: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[tuple[int, int]]:
    """Places of ``texts`` in sorted order; with each, the bytes it shares with the one before.

    All texts agree on their first ``depth`` bytes. Multikey quicksort goes ``shallow``
    bytes further, blind tries sort what agrees on those.
    """
    out: list[tuple[int, int]] = []
    end = depth + shallow
    stack: list[tuple[list[int], int, int]] = [(list(range(len(texts))), depth, 0)]
    while stack:
        some, at, common = stack.pop()
        if len(some) == 1:
            out.append((some[0], common))
        elif at >= end:
            (first, _), *rest = blind_trie(texts, some)
            out += [(first, common), *rest]
        else:
            pivot = _byte(texts[some[len(some) // 2]], at)
            less, equal, more = [], [], []
            for which in some:
                byte = _byte(texts[which], at)
                (less if byte < pivot else more if byte > pivot else equal).append(which)
            # The first of a later part shares ``at`` bytes with the last of an earlier one.
            if more:
                stack.append((more, at, at))
            if pivot < 0:  # all of these have ended, so they are equal
                out += [(which, at if place or less else common) for place, which in enumerate(equal)]
            else:
                stack.append((equal, at + 1, at if less else common))
            if less:
                stack.append((less, at, common))
    return out


def edges(before: list[bytes], after: list[bytes], alone: list[bool]) -> list[tuple[int, int] | None]:
    """How far windows that occur twice reach to the left and right of each anchor.

    ``before`` holds the bytes left of the anchors, backwards; ``after`` those from them on.
    """
    order = deep_shallow(after, GRAM)
    if len(order) > PAIRS:
        return _edges_by_split(before, after, alone, order)
    out: list[tuple[int, int] | None] = [None] * len(after)
    for place, (own, _) in enumerate(order):
        if not alone[own]:
            continue
        left = right = 0
        for step in (-1, 1):
            common, at = len(after[own]), place
            while 0 <= at + step < len(order):
                common = min(common, order[at if step < 0 else at + 1][1])
                at += step
                back = shared(before[own], before[order[at][0]])
                if back + common >= WINDOW:
                    left, right = max(left, back), max(right, common)
        if right:
            out[own] = left, right
    return out


def _classes_at(order: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted order, and what each shares with the one before."""
    places, common = zip(*order)
    return np.array(places), np.array(common)


def _edges_by_split(
    before: list[bytes], after: list[bytes], alone: list[bool], order: list[tuple[int, int]]
) -> list[tuple[int, int] | None]:
    """The same without comparing pairs.

    For each split of a window at the anchor, texts that share enough to the right are
    neighbours in one sorted order, those that share enough to the left in another; a
    window occurs twice if two texts are together in both.
    """
    sorted_after, common_after = _classes_at(order)
    sorted_before, common_before = _classes_at(deep_shallow(before))
    n = len(after)
    lengths_before, lengths_after = (np.array([len(t) for t in side]) for side in (before, after))
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    group_after, group_before = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(BEFORE + 1):
        ahead = WINDOW - back
        group_after[sorted_after] = np.cumsum(common_after < ahead)
        group_before[sorted_before] = np.cumsum(common_before < back)
        held = np.flatnonzero((lengths_before >= back) & (lengths_after >= ahead))
        pairs = group_after[held] * (n + 1) + group_before[held]
        _, which, count = np.unique(pairs, return_inverse=True, return_counts=True)
        twice = held[count[which] > 1]
        left[twice] = back
        right[twice] = np.maximum(right[twice], ahead)
    return [(int(a), int(b)) if b and own else None for a, b, own in zip(left, right, alone)]


def _contexts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (gram, n, kinds, row, place, reach) with the bytes around each place."""
    lists = asked.groupBy("row").agg(
        F.collect_list(F.struct("gram", "place", "reach", "n", "kinds")).alias("asked")
    )
    joined = texts.select("row", "packed").join(lists, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpacker = zstandard.ZstdDecompressor()
        for rows, packed, asked in pieces(batches, "row", "packed", "asked", rows=64):
            for row, data, places in zip(rows, packed, asked):
                raw = unpacker.decompress(data)
                for x in places:
                    at = x["place"]
                    before, after = raw[max(0, at - BEFORE) : at], raw[at : at + x["reach"]]
                    yield x["gram"], x["kinds"], row, at, x["n"], before, after

    schema = "gram long, kinds long, row long, place long, n long, before binary, after binary"
    return map_rows(joined, schema, run)


def _compared(contexts: DataFrame) -> DataFrame:
    """Spans of the contexts that are alone, from sorting each group in memory."""

    def solved(group: list[tuple]) -> Iterator[tuple]:
        alike: dict[bytes, list[tuple]] = {}
        for context in group:  # by the bytes themselves, which a hash may share with others
            alike.setdefault(context[-1][:GRAM], []).append(context)
        for some in alike.values():
            rows, places, n, before, after = zip(*some)
            found = edges([b[::-1] for b in before], list(after), [count == 1 for count in n])
            for row, place, reach in zip(rows, places, found):
                if reach:
                    yield row, place - reach[0], place + reach[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, group = None, []
        for part in pieces(batches, "gram", "row", "place", "n", "before", "after"):
            for gram, *rest in zip(*part):
                if gram != held and group:
                    yield from solved(group)
                    group = []
                held = gram
                group.append(tuple(rest))
        if group:
            yield from solved(group)

    ordered = contexts.repartition("gram").sortWithinPartitions("gram")
    return map_rows(ordered, "row long, start long, end long", run)


def _counted(contexts: DataFrame) -> DataFrame:
    """The same for groups of any size: each window of each context is counted by its hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        names = ("row", "place", "n", "before", "after")
        for part in pieces(batches, *names, rows=64):
            for row, place, n, before, after in zip(*part):
                raw = before + after
                for at in range(len(raw) - WINDOW + 1):
                    digest = hashlib.blake2b(raw[at : at + WINDOW], digest_size=16).digest()
                    yield digest, row, place - len(before) + at, n

    all_windows = map_rows(contexts, "digest binary, row long, start long, n long", windows)
    # Windows of one text that two anchors hold are one window.
    own = all_windows.groupBy("digest", "row", "start").agg(F.max("n").alias("n"))
    again = own.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    return (
        all_windows.where("n = 1")
        .join(again, "digest", "left_semi")
        .select("row", "start", (F.col("start") + WINDOW).alias("end"))
    )


def _repeated(texts: DataFrame) -> DataFrame:
    """Anchors whose gram occurs twice or more; ``one`` if all have the same context."""
    zipped = F.arrays_zip("gram", "context", "place", "reach", "n")
    points = texts.select("row", F.explode(zipped).alias("at")).select("row", "at.*")
    grams = (
        points.groupBy("gram")
        .agg(F.sum("n").alias("all"), F.min("context").alias("a"), F.max("context").alias("b"))
        .where("all > 1")
        .select("gram", (F.col("a") == F.col("b")).alias("one"))
    )
    return store(points.join(grams, "gram"), "repeated-anchors")


def _span() -> list:
    return [
        F.greatest(F.col("place") - BEFORE, F.lit(0)).alias("start"),
        (F.col("place") + F.col("reach")).alias("end"),
    ]


def _classes(points: DataFrame) -> DataFrame:
    """Per gram and context: how many anchors, and one of them."""
    kinds = points.where("not one").groupBy("gram", "context")
    some = F.min(F.struct("row", "place", "reach")).alias("some")
    return store(kinds.agg(F.sum("n").alias("n"), some), "anchor-classes")


def covered(texts: DataFrame, large: int = LARGE) -> DataFrame:
    """Spans ``row, start, end`` whose windows occur twice; all such windows are in one."""
    points = _repeated(texts)
    classes = _classes(points)
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("cover") - 2, F.lit(2)),
        lambda i: F.struct(F.get("cover", i).alias("start"), F.get("cover", i + 1).alias("end")),
    )
    local = texts.where("size(cover) > 0").select("row", F.explode(pairs).alias("at")).select("row", "at.*")
    alike = points.where("one").select("row", *_span())
    often = classes.where("n > 1").select("gram", "context")
    alike_too = points.where("not one").join(often, ["gram", "context"], "left_semi").select("row", *_span())
    groups = classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    open_groups = groups.where("least = 1").select("gram", "kinds")
    asked = classes.join(open_groups, "gram").select("gram", "n", "kinds", "some.*")
    spans = local.unionByName(alike).unionByName(alike_too)
    around = store(_contexts(texts, asked), "contexts")
    small, big = around.where(f"kinds <= {large}"), around.where(f"kinds > {large}")
    return spans.unionByName(_compared(small)).unionByName(_counted(big))


def _removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    # A span travels as one number, so that lists of them are cheap to sort and to read.
    span = F.shiftleft("start", 32).bitwiseOR(F.col("end"))
    lists = spans.where(f"end - start >= {WINDOW}").groupBy("row")
    lists = lists.agg(F.sort_array(F.collect_set(span)).alias("spans"))
    joined = texts.select("row", "doc_id", "n_bytes", "sha", "packed").join(lists, "row", "left")
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpacker = zstandard.ZstdDecompressor()
        for part in pieces(batches, "doc_id", "n_bytes", "sha", "packed", "spans", rows=64):
            for key, size, sha, packed, spans in zip(*part):
                raw = unpacker.decompress(packed)
                gone = merged([(span >> 32, span & 0xFFFFFFFF) for span in spans or ()])
                if gone:
                    bounds = [0, *(at for span in gone for at in span), size]
                    raw = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                    sha = hashlib.sha256(raw).hexdigest()
                yield key, size, sum(b - a for a, b in gone), len(gone), sha, raw

    return map_rows(joined, schema, run)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the ``kept`` bytes.

    Where a span begins or ends within a character, ``kept`` need not be valid UTF-8.
    """
    texts = _read(docs, text, doc_id)
    return _removed(texts, covered(texts))
