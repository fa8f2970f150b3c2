"""Packing (9): best fit, longest first, over windows of fixed length.

A document is its token ids and an end id. What is longer than a window is cut into full
windows first; the rest of each document goes, longest first, into the open window with
the least room that still holds it. A segment tree over the possible amounts of room
finds that window.

Pieces are numbered in the order of the documents' rows, so a mix stays a mix: by
partition, or, where the caller says so, by written file and place in it. Runs of about
``SHARD`` pieces in that order are shards, each packed alone by length and number: a shard
that runs again gives the same windows. Sequences are numbered by shard and, within one, by
the number of the window's longest piece. Shards leave at most a few windows with much room
each. A task holds the ids of one shard, at most 4 KB a piece.

``pack_sequences`` gives the sequences with their ids: a window whose tokens are a power of
two is left at that, all others are padded. ``pack`` gives the pieces, read back from the
sequences.

Null texts count as empty and are one end id. Null and repeated ids are carried through,
each row a document of its own. An empty table gives an empty result. Other columns make
no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfgauge.llm.common import in_order, map_rows, pieces, store, whole
from shelfgauge.llm.tokens import Tokens

WINDOW = 1024
END = b"\0\0\0\0"
SHARD = 20_000
#: Shards that a task packs, one after the other: what it reads does not grow with the input.
TASK_SHARDS = 4
#: Windows of a shard have numbers below this.
PER_SHARD = 1 << 32


class Rooms:
    """Open windows by room left: a segment tree of how many have each amount."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.counts[at] += n
            at >>= 1

    def put(self, room: int, window: int) -> None:
        self.open.setdefault(room, []).append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and its room."""
        at = need + self.leaves
        if not self.counts[at]:
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.counts[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.open[room].pop(), room


def cut(ids: bytes, window: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, length and ids of the pieces of a document."""
    for at in range(0, len(ids), 4 * window):
        piece = ids[at : at + 4 * window]
        yield at // 4, len(piece) // 4, piece


def slim(ids: bytes) -> bytes:
    """Ids as 16-bit numbers where all fit, for their way through files and shuffles."""
    numbers = np.frombuffer(ids, "<u4")
    return numbers.astype("<u2").tobytes() if numbers.max() < 1 << 16 else ids


def wide(ids: bytes, length: int) -> bytes:
    """The 32-bit ids of a piece of ``length`` tokens, from :func:`slim`."""
    return ids if len(ids) == 4 * length else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def padded(ids: bytes, window: int, pad: int = 0) -> bytes:
    """The ids of a sequence, filled up to ``window`` unless their number is a power of two."""
    n = len(ids) // 4
    return ids if n & (n - 1) == 0 else ids + pad.to_bytes(4, "little") * (window - n)


def _tokenized(
    docs: DataFrame, text: str, doc_id: str, window: int, ranks: str | None, files: bool
) -> DataFrame:
    """Pieces, each with its run of rows and its number there."""
    narrow = in_order(docs, F.col(doc_id).alias("doc_id"), whole(text).alias("text"), files=files)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
        "file string, run long, task long, nth long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = Tokens(ranks)
        seen: dict[tuple, int] = {}
        for part in pieces(batches, "doc_id", "text", "file", "run", "task"):
            for key, value, *own in zip(*part):
                nth = seen.get(tuple(own), 0)
                ids = encoder.encode(value) + END
                for start, length, piece in cut(ids, window):
                    yield key, start, length, slim(piece), len(ids) // 4, *own, nth
                    nth += 1
                seen[tuple(own)] = nth

    return map_rows(narrow, schema, run)


def _filled(window: int, pad: int, rows: list[tuple], shard: int) -> Iterator[tuple]:
    """The sequences of a shard, from its pieces, longest first."""
    rooms = Rooms(window)
    held: list[list[tuple]] = []
    used: list[int] = []
    for row in rows:
        length = row[2]
        at, room = rooms.take(length) or (len(held), window)
        if at == len(held):
            held.append([])
            used.append(0)
        if room > length:
            rooms.put(room - length, at)
        held[at].append((*row, used[at]))
        used[at] += length
    # By the number of the longest piece, which is the first.
    for place, at in enumerate(sorted(range(len(held)), key=lambda at: held[at][0][5])):
        ids = b"".join(wide(row[3], row[2]) for row in held[at])
        yield (
            shard * PER_SHARD + place,
            used[at],
            padded(ids, window, pad),
            [
                {"doc_id": key, "start": start, "length": length, "doc_tokens": tokens, "offset": offset}
                for key, start, length, _, tokens, _, offset in held[at]
            ],
        )


def _packed(window: int, pad: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sequences of rows sorted by shard and falling length; a shard is held at a time."""
    shard, rows = None, []
    names = "shard", "doc_id", "start", "length", "ids", "doc_tokens", "number"
    for part in pieces(batches, *names):
        for own, *row in zip(*part):
            if own != shard:
                if rows:
                    yield from _filled(window, pad, rows, shard)
                shard, rows = own, []
            rows.append(tuple(row))
    if rows:
        yield from _filled(window, pad, rows, shard)


def _numbered(cuts: DataFrame) -> DataFrame:
    """``number``: each piece's place in the order of the rows, from counts of the runs.

    A run is what one task read of one file, so there is a row per split of the input; they
    are small enough to be put in order by one task, and joined as their size allows.
    """
    key = ["file", "run", "task"]
    runs = cuts.groupBy(*key).agg(F.count("*").alias("n"))
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    starts = store(
        runs.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "token-runs"
    )
    return cuts.join(starts, key).withColumn("number", F.col("before") + F.col("nth"))


def pack_sequences(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    window: int = WINDOW,
    shard: int = SHARD,
    ranks: str | None = None,
    files: bool = False,
    pad: int = 0,
) -> DataFrame:
    """Per sequence: ``sequence_id, n_tokens, ids, pieces``.

    ``ids`` are little-endian 32-bit numbers, filled up with ``pad`` after ``n_tokens``;
    ``pieces`` lists ``doc_id, start, length, doc_tokens, offset`` in the sequence's order.
    With ``files``, the rows' order is that of the files which ``docs`` reads.
    """
    cuts = store(_tokenized(docs, text, doc_id, window, ranks, files), "token-pieces")
    total = cuts.count()
    shards = max(1, -(-total // shard))
    dealt = (
        _numbered(cuts)
        .withColumn("shard", F.expr(f"number * {shards} div {max(1, total)}"))
        .select("shard", "doc_id", "start", "length", "ids", "doc_tokens", "number")
        # Exactly so many shards a task; by hash, some would get twice as many.
        .repartitionById(-(-shards // TASK_SHARDS), F.expr(f"int(shard div {TASK_SHARDS})"))
        .sortWithinPartitions("shard", F.col("length").desc(), "number")
    )
    kind = cuts.schema["doc_id"].dataType.simpleString()
    schema = (
        "sequence_id long, n_tokens long, ids binary, pieces array<struct<"
        f"doc_id: {kind}, start: bigint, length: bigint, doc_tokens: bigint, offset: bigint>>"
    )
    return map_rows(dealt, schema, lambda batches: _packed(window, pad, batches))


def pack(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    window: int = WINDOW,
    shard: int = SHARD,
    ranks: str | None = None,
    files: bool = False,
) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    All of it is read from the sequences of :func:`pack_sequences`.
    """
    sequences = pack_sequences(docs, text, doc_id, window, shard, ranks, files)
    ids = F.substring("ids", 4 * F.col("piece.offset").cast("int") + 1, 4 * F.col("piece.length").cast("int"))
    return sequences.select("sequence_id", "ids", F.explode("pieces").alias("piece")).select(
        "piece.doc_id", "piece.start", "piece.length", F.crc32(ids).alias("ids_crc32"),
        "piece.doc_tokens", "sequence_id", "piece.offset", ids.alias("ids"),
    )
