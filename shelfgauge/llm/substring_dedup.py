"""Substring dedup (12): suffix trees over words, built in memory-sized groups.

The suffixes of a text are those that begin at its words and have ``WINDOW`` words or
more. Only their first ``WINDOW`` words matter, so a suffix belongs to the group of the
prefix that its least run of ``GRAM`` words (by hash) stands for: equal windows have the
same least run, and so do several suffixes in a row, which travel together, as one
segment of words. Where too many segments share a run, the prefix is made longer: parts
of the group, dealt by salt, each keep their first suffix of every window, and these
meet again in groups of the whole prefix of ``WINDOW`` words.

Each group's suffix tree is built from the root, two words a level, with nodes of one
suffix left out. Internal nodes at depth ``WINDOW`` are the repeats; of the suffixes below
one the first, by document id and place, stays and the windows of all others are marked.
Marked windows that overlap are one longer repeat.

Runs that occur once in all texts are asked for first, so that text without repeats does
not move. Texts lie in chunks of about ``CHUNK`` bytes, packed, and move as such.

Words are told apart by 64-bit hashes for runs and 32-bit hashes for each word of a
window (``WINDOW`` of these must agree). Document ids must be integers; null ids come
after all others, and rows that share an id follow each other by chunk and place, so that
of equal rows one stays whole. Null texts have no words. Texts of any length and words of
any length are taken whole; a text must fit in a task. An empty table gives an empty
result. Other columns make no difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from shelfgauge.llm.common import map_rows, pieces, store, whole

WINDOW = 20
GRAM = 8
CHUNK = 1 << 20
#: Segments of one run of words that are compared in one group.
CAP = 50_000
#: Bytes of text whose runs are asked for in one task, and whose segments make a group.
ASKED, GROUPED = 40_000_000, 10_000_000

_LAST = np.iinfo(np.int64).max
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LONG = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_VALUES[_SPACE] = 0
_POWERS = np.cumprod(np.full(_LONG + 1, _MULTIPLIER, np.uint64), dtype=np.uint64)


def word_hashes(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie end to end, and each text's first word.

    ``offsets`` has where texts begin, and the end of the last one.
    """
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~inside[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:] | fresh[1:]
    ends = np.flatnonzero(inside & last) + 1
    del inside, fresh, last
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), 50_000):
        some, stop = starts[low : low + 50_000], ends[low : low + 50_000]
        at, until = some[0], stop[-1]
        sizes = np.diff(np.append(some, until))
        if until - at < 1 << 24:
            place = np.arange(until - at) - np.repeat(some - at, sizes)
            values = _VALUES[data[at:until]] * _POWERS[np.minimum(place, _LONG)]
            out[low : low + len(some)] = np.add.reduceat(values, some - at)
        for i in np.flatnonzero(stop - some > _LONG):
            digest = hashlib.blake2b(data[some[i] : stop[i]].tobytes(), digest_size=8).digest()
            out[low + i] = int.from_bytes(digest, "little")
        if until - at >= 1 << 24:
            for i in np.flatnonzero(stop - some <= _LONG):
                word = data[some[i] : stop[i]]
                out[low + i] = (_VALUES[word] * _POWERS[: len(word)]).sum(dtype=np.uint64)
    sizes = (ends - starts).astype(np.uint64)
    return _mixed(out + sizes * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


class Segments:
    """The segments of a chunk, in order: suffixes in a row with the same least run of words."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> None:
        """``firsts`` has each text's first word, and the number of all words."""
        self.words, self.firsts, self.window = words, firsts, window
        counts = np.diff(firsts)
        n = max(0, len(words) - window + 1)
        ends = np.repeat(firsts[1:], counts)[:n]
        starts = np.flatnonzero(ends - np.arange(n) >= window)
        self.start = self.n = np.zeros(0, np.int64)
        self.run = np.zeros(0, np.uint64)
        self.text = np.zeros(0, np.int64)
        self.again = np.zeros(0, np.int64)
        if not len(starts):
            return
        runs = np.zeros(len(words) - gram + 1, np.uint64)
        for at in range(gram):
            runs = runs * _MULTIPLIER + words[at : at + len(runs)]
        runs = _mixed(runs)
        width = window - gram + 1
        least = sliding_window_view(runs, width)[:n].argmin(axis=1)[starts] + starts
        heads = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        self.start, self.run = starts[heads], runs[least[heads]]
        self.n = np.diff(np.append(heads, len(starts)))
        self.text = np.searchsorted(firsts, self.start, "right") - 1
        self._drop_own_repeats()

    def _drop_own_repeats(self) -> None:
        """Windows that occur earlier in their text are known as such: ``again``.

        Segments of such windows alone are left out; ``twice`` marks those that stay for them.
        """
        mixed = self.run ^ _mixed(self.text.astype(np.uint64) + np.uint64(1))
        _, inverse, counts = np.unique(mixed, return_inverse=True, return_counts=True)
        several = counts[inverse] > 1
        self.twice = several
        if not several.any():
            return
        segment, at = expanded(self.n[several])
        segment = np.flatnonzero(several)[segment]
        place = self.start[segment] + at
        hashed = _mixed(self.text[segment].astype(np.uint64) + np.uint64(1))
        for step in range(self.window):
            hashed = hashed * _MULTIPLIER + self.words[place + step]
        order = np.lexsort((place, hashed))
        repeat = np.zeros(len(place), bool)
        repeat[order[1:]] = hashed[order[1:]] == hashed[order[:-1]]
        self.again = np.sort(place[repeat])
        known = np.bincount(segment[repeat], minlength=len(self.n)) == self.n
        for name in ("start", "n", "run", "text", "twice"):
            setattr(self, name, getattr(self, name)[~known])


def expanded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: of which entry each item is, and its number there."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def joined(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, behind their lengths."""
    sizes = np.array([len(array) for array in arrays], "<u4")
    return sizes.tobytes() + b"".join(np.ascontiguousarray(array).tobytes() for array in arrays)


def parted(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, "<u4", len(kinds))
    out, at = [], 4 * len(kinds)
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, size, at))
        at += int(size) * np.dtype(kind).itemsize
    return out


# --- the tree of a group ------------------------------------------------------------


def repeats(words: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a group below internal nodes at depth ``window``, and their nodes.

    ``place`` has where each suffix begins in ``words``. Nodes are split level by level;
    a node with one suffix is a leaf, which is left out.
    """
    alive = np.arange(len(place))
    node = np.zeros(len(place), np.int64)
    for depth in range(0, window, 2):
        at = place[alive] + depth
        label = words[at].astype(np.uint64) << np.uint64(32)
        if depth + 1 < window:
            label |= words[at + 1].astype(np.uint64)
        order = np.lexsort((label, node))
        node, label = node[order], label[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (node[1:] != node[:-1]) | (label[1:] != label[:-1])
        inner = ~(new[:-1] & new[1:])
        node = np.cumsum(new[:-1])[inner]
        alive = alive[order[inner]]
        if not len(alive):
            break
    return alive, node


class Group:
    """Segments that may hold equal windows."""

    KINDS = ("<i8", "<u4", "u1", "u1", "<u4")

    def __init__(self, window: int) -> None:
        self.window = window
        self.parts: list[list[np.ndarray]] = []
        self.chunks: list[int] = []

    def add(self, chunk: int, blob: bytes) -> None:
        """Document ids, places, numbers of suffixes, levels, and all words of segments of a chunk."""
        self.parts.append(parted(blob, *self.KINDS))
        self.chunks.append(chunk)

    def marks(self) -> tuple[Iterator[tuple[int, bytes]], dict[str, np.ndarray]]:
        """Marked windows by chunk, and the first suffixes of groups that were dealt by salt."""
        doc, start, n, level, words = (np.concatenate(arrays) for arrays in zip(*self.parts))
        sizes = [len(part[0]) for part in self.parts]
        chunk = np.repeat(np.array(self.chunks, np.int64), sizes)
        n = n.astype(np.int64)
        owner, at = expanded(n)
        length = n + self.window - 1
        place = (np.cumsum(length) - length)[owner] + at
        alive, node = repeats(words, place, self.window)
        own = owner[alive]
        order = np.lexsort((start[own].astype(np.int64) + at[alive], chunk[own], doc[own], node))
        later = np.zeros(len(alive), bool)
        later[order[1:]] = node[order[1:]] == node[order[:-1]]
        marked = np.zeros(len(owner), bool)
        marked[alive[later]] = True
        open_ = ~marked & (level[owner] > 0)
        first = {
            "doc": doc[owner[open_]], "chunk": chunk[owner[open_]],
            "start": start[owner[open_]] + at[open_], "place": place[open_], "words": words,
        }
        return self._by_chunk(chunk, start, owner, at, marked), first

    def _by_chunk(self, chunk, start, owner, at, marked) -> Iterator[tuple[int, bytes]]:
        where = np.flatnonzero(marked)
        windows = start[owner[where]].astype(np.int64) + at[where]
        order = np.lexsort((windows, chunk[owner[where]]))
        chunks, windows = chunk[owner[where]][order], windows[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(chunks)) + 1, [len(chunks)]])
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high > low:
                yield int(chunks[low]), packed_places(windows[low:high])


def packed_places(places: np.ndarray) -> bytes:
    """Runs of rising places: where they begin and how many follow."""
    heads = np.concatenate([[0], np.flatnonzero(np.diff(places) != 1) + 1])
    return joined(places[heads].astype("<u4"), np.diff(np.append(heads, len(places))).astype("<u4"))


# --- Spark ----------------------------------------------------------------------------


def _chunks(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Texts put together, packed and written; a row per chunk."""
    kind = docs.schema[doc_id].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} must be an integer, not {kind}")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        packer = zstandard.ZstdCompressor(level=3)

        def row() -> tuple:
            raw = b"".join(texts)
            sizes = np.array([len(t) for t in texts], "<i8").tobytes()
            return list(ids), sizes, len(raw), packer.compress(raw)

        ids, texts, size = [], [], 0
        for keys, values in pieces(batches, "doc_id", "text"):
            for key, value in zip(keys, values):
                raw = value.encode("utf-8", "surrogatepass")
                if ids and size + len(raw) > CHUNK:
                    yield row()
                    ids, texts, size = [], [], 0
                ids.append(key)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield row()

    schema = "ids array<long>, sizes binary, n_bytes long, packed binary"
    numbered = map_rows(narrow, schema, run).withColumn("chunk", F.monotonically_increasing_id())
    return store(numbered, "text-chunks")


def _opened(sizes: bytes, packed: bytes) -> tuple[bytes, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
    return raw, np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])


def _split(keys: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Each key with its part of the arrays."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high > low:
            yield int(keys[low]), *(array[order[low:high]] for array in arrays)


def _repeated_runs(chunks: DataFrame, n_buckets: int, window: int, gram: int, cap: int) -> DataFrame:
    """``chunk, found``: segments whose run of words occurs again, and how often it must be split."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in pieces(batches, "chunk", "sizes", "packed", rows=1):
            for chunk, sizes, packed in zip(*part):
                found = Segments(*word_hashes(*_opened(sizes, packed)), window, gram)
                if not len(found.run):
                    continue
                number = np.arange(len(found.run))
                # A run that its text holds again is asked for twice, so that it is found.
                number = np.concatenate([number, number[found.twice]])
                run = found.run[number]
                bucket = (run >> np.uint64(32)) % np.uint64(n_buckets)
                for own, key, which in _split(bucket, run.astype("<u4"), number.astype("<u4")):
                    yield own, chunk, joined(key, which)

    asked = map_rows(chunks.select("chunk", "sizes", "packed"), "bucket long, chunk long, asked binary", ask)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, rows = None, []
        for part in pieces(batches, "bucket", "chunk", "asked", rows=64):
            for bucket, *row in zip(*part):
                if bucket != held:
                    yield from answered(rows)
                    held, rows = bucket, []
                rows.append(row)
        yield from answered(rows)

    def answered(rows: list) -> Iterator[tuple]:
        if not rows:
            return
        chunks_ = [chunk for chunk, _ in rows]
        keys, numbers = zip(*(parted(raw, "<u4", "<u4") for _, raw in rows))
        _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        counts = counts[inverse]
        levels = np.ceil(np.log2(np.maximum(1, counts / cap))).astype("u1")
        at = 0
        for chunk, number in zip(chunks_, numbers):
            mine = slice(at, at + len(number))
            kept = counts[mine] > 1
            if kept.any():
                yield chunk, joined(number[kept], levels[mine][kept])
            at += len(number)

    ordered = asked.repartition("bucket").sortWithinPartitions("bucket")
    return map_rows(ordered, "chunk long, found binary", answer)


def _segments(chunks: DataFrame, found: DataFrame, n_groups: int, window: int, gram: int) -> DataFrame:
    """``bucket, chunk, kind, blob``: segments by group (kind 0), and windows known as repeats (1)."""
    lists = found.groupBy("chunk").agg(F.collect_list("found").alias("found"))
    joined_rows = chunks.select("chunk", "ids", "sizes", "packed").join(lists, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        packer = zstandard.ZstdCompressor(level=1)
        for part in pieces(batches, "chunk", "ids", "sizes", "packed", "found", rows=1):
            for chunk, ids, sizes, packed, answers in zip(*part):
                own = Segments(*word_hashes(*_opened(sizes, packed)), window, gram)
                if len(own.again):
                    yield chunk % n_groups, chunk, 1, packed_places(own.again)
                numbers, levels = map(np.concatenate, zip(*(parted(raw, "<u4", "u1") for raw in answers)))
                numbers, once = np.unique(numbers, return_index=True)
                levels = levels[once]
                # Parts of a large group are dealt by chunk.
                dealt = _mixed(np.array([chunk + 1], np.uint64))
                salt = dealt & ((np.uint64(1) << levels.astype(np.uint64)) - np.uint64(1))
                bucket = _mixed(own.run[numbers] + salt * _MULTIPLIER) % np.uint64(n_groups)
                order = np.array([_LAST if key is None else key for key in ids], np.int64)
                words = (own.words >> np.uint64(32)).astype("<u4")
                for group, number, level in _split(bucket, numbers, levels):
                    start, n = own.start[number], own.n[number]
                    owner, at = expanded(n + window - 1)
                    blob = joined(
                        order[own.text[number]], start.astype("<u4"), n.astype("u1"), level, words[start[owner] + at]
                    )
                    yield group, chunk, 0, packer.compress(blob)

    return map_rows(joined_rows, "bucket long, chunk long, kind int, blob binary", run)


def _trees(segments: DataFrame, n_groups: int, window: int) -> DataFrame:
    """``chunk, marks`` of marked windows; with ``bucket`` and ``kind`` 0, segments to compare again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, group = None, Group(window)
        unpacker = zstandard.ZstdDecompressor()
        for part in pieces(batches, "bucket", "chunk", "kind", "blob", rows=64):
            for bucket, chunk, kind, blob in zip(*part):
                if kind:
                    yield None, chunk, 1, blob
                    continue
                if bucket != held:
                    yield from solved(group)
                    held, group = bucket, Group(window)
                group.add(chunk, unpacker.decompress(blob))
        yield from solved(group)

    def solved(group: Group) -> Iterator[tuple]:
        if not group.parts:
            return
        marks, first = group.marks()
        yield from ((None, chunk, 1, raw) for chunk, raw in marks)
        if not len(first["place"]):
            return
        packer = zstandard.ZstdCompressor(level=1)
        hashed = np.zeros(len(first["place"]), np.uint64)
        for step in range(window):
            hashed = hashed * _MULTIPLIER + first["words"][first["place"] + step]
        for bucket, doc, chunk, start, place in _split(
            _mixed(hashed) % np.uint64(n_groups), first["doc"], first["chunk"], first["start"], first["place"]
        ):
            for own, docs, starts, places in _split(chunk, doc, start, place):
                one = np.ones(len(docs), "u1")
                words = first["words"][(places[:, None] + np.arange(window)).ravel()]
                yield bucket, own, 0, packer.compress(joined(docs, starts.astype("<u4"), one, one * 0, words))

    ordered = segments.repartition("bucket").sortWithinPartitions("bucket")
    return map_rows(ordered, "bucket long, chunk long, kind int, blob binary", run)


def marked_windows(
    chunks: DataFrame, window: int = WINDOW, gram: int = GRAM, cap: int = CAP, asked: int = ASKED, grouped: int = GROUPED
) -> DataFrame:
    """``chunk, blob``: windows whose words occur earlier, as runs of places in the chunk."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    n_groups = -(-total // grouped) + 1
    found = _repeated_runs(chunks, -(-total // asked) + 1, window, gram, cap)
    first = store(_trees(_segments(chunks, found, n_groups, window, gram), n_groups, window), "suffix-trees")
    marks = first.where("kind = 1")
    again = first.where("kind = 0")
    if not again.isEmpty():
        marks = marks.unionByName(_trees(again, n_groups, window).where("kind = 1"))
    return marks.select("chunk", "blob")


def remove_passages(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    window: int = WINDOW,
    gram: int = GRAM,
    **sizes: int,
) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256`` and ``kept``, the words that stay."""
    chunks = _chunks(docs, text, doc_id)
    marks = marked_windows(chunks, window, gram, **sizes)
    lists = marks.groupBy("chunk").agg(F.collect_list("blob").alias("marks"))
    joined_rows = chunks.select("chunk", "ids", "sizes", "packed").join(lists, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in pieces(batches, "ids", "sizes", "packed", "marks", rows=1):
            for ids, sizes_, packed, blobs in zip(*part):
                raw, offsets = _opened(sizes_, packed)
                yield from kept_texts(ids, raw, offsets, blobs or [])

    def kept_texts(ids: list, raw: bytes, offsets: np.ndarray, blobs: list[bytes]) -> Iterator[tuple]:
        lists_ = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:])]
        firsts = np.concatenate([[0], np.cumsum([len(words) for words in lists_])]).astype(np.int64)
        steps = np.zeros(firsts[-1] + 1, np.int64)
        for blob in blobs:
            start, n = parted(blob, "<u4", "<u4")
            np.add.at(steps, start, 1)
            np.add.at(steps, start.astype(np.int64) + n + window - 1, -1)
        gone = np.cumsum(steps)[:-1] > 0
        for key, words, at in zip(ids, lists_, firsts):
            mine = gone[at : at + len(words)]
            n_gone = int(mine.sum())
            if n_gone:
                kept = [words[i] for i in np.flatnonzero(~mine)]
            else:
                kept = words
            line = b" ".join(kept)
            yield key, len(words), n_gone, hashlib.sha256(line).hexdigest(), line.decode("utf-8", "surrogatepass")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return map_rows(joined_rows, schema, run)
