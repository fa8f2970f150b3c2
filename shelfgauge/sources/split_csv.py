"""CSV records of files that many tasks read, where quoted cells may hold line breaks.

Whether a line break ends a record depends on all that comes before it in the file. But a
line has only two ways to begin, inside a quoted cell or outside of one, and for each of
them it is known how it ends. So a block of lines is a function from its first state to
its last; these functions, one small row per block, are put together in the order of the
file and give every block's true first state. With that each task cuts its own block into
records; the few that lie in more than one block are joined from their parts.

Spark's text source deals out blocks and lines, and Spark's CSV functions read the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfgauge.sources.shared_tables import store

#: More blocks than this are joined to their lines by a shuffle instead of a broadcast.
BROADCAST_BLOCKS = 1_000_000

#: Whole cells from the beginning of a line on. Possessive, so that a cell of any length
#: takes neither stack nor second tries.
_CELLS = r'\G(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)(?:,|$)'

_MARK = b"\xef\xbb\xbf"


def _left_open(line: Column) -> Column:
    """Whether a line that begins outside of cells ends inside a quoted one."""
    return F.length(F.regexp_replace(line, F.lit(_CELLS), F.lit(""))) > 0


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines with file, block, and how they end for each way to begin."""
    line = F.col("value")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        line.cast("binary").alias("line"),
        _left_open(line).alias("opens"),
        _left_open(F.concat(F.lit('"'), line)).alias("stays"),
    )


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000, weight: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows or about ``weight`` bytes."""
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += sum(len(value) for value in row if isinstance(value, bytes))
        if len(held) >= size or heavy >= weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _block_ends(lines: DataFrame) -> DataFrame:
    """Per block: how it ends for each way to begin, and whether a record begins in it if it begins inside."""
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("opens", pa.bool_()), ("stays", pa.bool_()), ("begins", pa.bool_())]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key = outside = inside = begins = None
        for file, block, opens, stays in _columns(batches):
            if (file, block) != key:
                if key:
                    yield *key, outside, inside, begins
                key, outside, inside, begins = (file, block), False, True, False
            begins |= not inside
            outside = stays if outside else opens
            inside = stays if inside else opens
        if key:
            yield *key, outside, inside, begins

    narrow = lines.select("file", "block", "opens", "stays")
    return narrow.mapInArrow(
        lambda batches: _batches(fold(batches), schema),
        "file string, block long, opens boolean, stays boolean, begins boolean",
    )


def block_states(lines: DataFrame) -> DataFrame:
    """``file, block, inside, owner``: how each block begins, and in which block the open record began.

    One row per block, in order of the file; a file's rows stream through a task.
    """
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("owner", pa.int64())])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, inside, owner = None, False, 0
        for file, block, opens, stays, begins in _columns(batches):
            if file != held:
                held, inside, owner = file, False, block
            yield file, block, inside, owner
            if not inside or begins:
                owner = block
            inside = stays if inside else opens

    ordered = _block_ends(lines).repartition("file").sortWithinPartitions("file", "block")
    return ordered.mapInArrow(
        lambda batches: _batches(compose(batches), schema), "file string, block long, inside boolean, owner long"
    )


def _cut(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``file, owner, block, whole, head, text`` from lines in order with their block's state."""
    key, held, head_seen = None, [], False
    inside = own = False
    owner = None

    def part(whole: bool, ended: bool) -> tuple:
        text = b"\n".join(held)
        file, block = key
        head = owner == 0 and own and not head_seen
        if head:
            text = text.removeprefix(_MARK)
        if ended:
            text = text.removesuffix(b"\r")
        return file, owner, block, whole, head, text

    for file, block, line, opens, stays, first_inside, first_owner in rows:
        if (file, block) != key:
            if held:
                yield part(False, False)
            if first_inside is None:
                raise ValueError(f"The blocks of {file} changed while it was read")
            key, held, head_seen, inside = (file, block), [], False, first_inside
            own, owner = not inside, first_owner if inside else block
        held.append(line)
        inside = stays if inside else opens
        if not inside:
            done = part(own, True)
            held, own, owner = [], True, block
            if done[-1].strip() or not done[3]:
                yield done
                head_seen |= done[4]
    if held:
        yield part(False, False)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, head, record``: all CSV records of the files; ``head`` marks each file's first.

    Line breaks inside cells stay as they are. Records end with ``\\n`` or ``\\r\\n``; blank
    lines are no records. Runs jobs at once, and writes the records.
    """
    lines = _lines(spark, path)
    states = store(block_states(lines), "csv-blocks")
    small = states.count() <= BROADCAST_BLOCKS
    known = lines.join(F.broadcast(states) if small else states, ["file", "block"], "left")
    if not small:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        known = numbered.join(states, ["file", "block"], "left")
        known = known.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    schema = pa.schema(
        [
            ("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()),
            ("head", pa.bool_()), ("text", pa.binary()),
        ]
    )
    columns = "file", "block", "line", "opens", "stays", "inside", "owner"
    cut = known.select(*columns).mapInArrow(
        lambda batches: _batches(_cut(_columns(batches)), schema),
        "file string, owner long, block long, whole boolean, head boolean, text binary",
    )
    found = store(cut, "csv-records").withColumn("text", F.col("text").cast("string"))
    parts = F.sort_array(F.collect_list(F.struct("block", "text")))
    spread = (
        found.where("not whole")
        .groupBy("file", "owner")
        .agg(F.array_join(F.transform(parts, lambda part: part["text"]), "\n").alias("record"), F.max("head").alias("head"))
        .where(F.length(F.trim("record")) > 0)
    )
    whole = found.where("whole").select("file", "head", F.col("text").alias("record"))
    return whole.unionByName(spread.select("file", "head", "record"))
