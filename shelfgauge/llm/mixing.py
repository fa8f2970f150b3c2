"""Mixing (10): sources interleaved to target weights by proportionate-fair scheduling.

Each source is a row of blocks of ``BLOCK`` documents. The target is the flow in which all
sources are drawn at once, each in proportion to its exact weight; when a source runs out,
the shares of the others grow and a new phase begins. A block may start at the slot in
which the flow first touches it and must be placed before the slot by which the flow has
passed it. Placing the released block with the earliest deadline meets every deadline, so
after any number of slots each source is less than one block from its target. Releases and
deadlines are whole numbers worked out from fractions: no error adds up, over phases either.

Every row comes out exactly once: the mix is an order, not a selection. The slots are
worked out in turn by one task, which holds a few numbers per source and reads no rows; a
table with a row per block gives them to the rows. Any number of sources will do.

Without weights, a source's target is proportional to the root of its rows, which lifts
small sources. Weights given by name must be positive; sources without one are refused.
Null is a source of its own, apart from the empty name (give it the weight of ``None``).
Rows with null or repeated ids are rows like others; an empty table gives an empty result;
other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfgauge.llm.common import map_rows, pieces, store

BLOCK = 16
ROUND = 10_000


def shares(weights: Mapping[str, float], slots: int) -> dict[str, int]:
    """Whole shares of ``slots``, at least one each, by largest remainders."""
    total = math.fsum(weights.values())
    spare = slots - len(weights)
    exact = {name: max(0.0, weight / total * slots - 1) for name, weight in weights.items()}
    scale = spare / (math.fsum(exact.values()) or 1)
    found = {name: 1 + int(part * scale) for name, part in exact.items()}
    by_rest = sorted(exact, key=lambda name: (int(exact[name] * scale) - exact[name] * scale, name))
    for name in by_rest[: slots - sum(found.values())]:
        found[name] += 1
    return found


def one_round(parts: Mapping[str, int]) -> list[str]:
    """Which source each slot goes to: the released block with the earliest deadline."""
    slots = sum(parts.values())
    placed = dict.fromkeys(parts, 0)
    waiting = [(0, name) for name in sorted(parts)]
    ready: list[tuple[int, str]] = []
    order = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, name = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(placed[name] + 1) * slots // parts[name]), name))
        _, name = heapq.heappop(ready)
        order.append(name)
        placed[name] += 1
        if placed[name] < parts[name]:
            heapq.heappush(waiting, (placed[name] * slots // parts[name], name))
    return order


def turns(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple]:
    """Per slot: source, number of its block, phase, slot and the source's share in the phase."""
    names = sorted(name for name, n in blocks.items() if n)
    exact = [Fraction(weights[name]) for name in names]
    whole = math.lcm(*(weight.denominator for weight in exact))
    rate = [int(weight * whole) for weight in exact]
    size = [blocks[name] for name in names]
    # Stretches of the flow between ends of sources: their end (as size / rate of a source
    # that ends there), blocks of ended sources, and rates of the others in sum.
    ends: list[int] = []
    gone, flow = [0], [sum(rate)]
    for i in sorted(range(len(names)), key=lambda i: Fraction(size[i], rate[i])):
        if ends and size[ends[-1]] * rate[i] == size[i] * rate[ends[-1]]:
            gone[-1] += size[i]
            flow[-1] -= rate[i]
        else:
            ends.append(i)
            gone.append(gone[-1] + size[i])
            flow.append(flow[-1] - rate[i])
    near = [size[i] / rate[i] for i in ends]

    def reached(i: int, n: int) -> tuple[int, int]:
        """The first slot that ends at or after the flow has n blocks of source i, and the last before."""
        at = min(bisect_left(near, n / rate[i]), len(ends) - 1)
        while at and n * rate[ends[at - 1]] <= size[ends[at - 1]] * rate[i]:
            at -= 1
        while n * rate[ends[at]] > size[ends[at]] * rate[i]:
            at += 1
        passed = flow[at] * n
        return gone[at] - (-passed // rate[i]), gone[at] + passed // rate[i]

    placed = [0] * len(names)
    waiting = [(0, i) for i in range(len(names))]
    ready: list[tuple[int, int]] = []
    stretch = phase = 0
    for slot in range(sum(size)):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (reached(i, placed[i] + 1)[0], i))
        before = stretch
        while (slot - gone[stretch]) * rate[ends[stretch]] >= flow[stretch] * size[ends[stretch]]:
            stretch += 1
        phase += stretch > before and slot > 0
        _, i = heapq.heappop(ready)
        yield names[i], placed[i], phase, slot, rate[i] / flow[stretch]
        placed[i] += 1
        if placed[i] < size[i]:
            heapq.heappush(waiting, (reached(i, placed[i])[1], i))


def _placed(docs: DataFrame, source: str) -> DataFrame:
    """``docs`` in a written table, each row with its source's key, task and place there."""
    keyed = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("key"),
    )
    extra = [StructField("key", StringType()), StructField("part", LongType()), StructField("place", LongType())]
    schema = StructType([keyed.schema["doc"], *extra])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            places = []
            for key in batch.column(1).to_pylist():
                places.append(seen.get(key, 0))
                seen[key] = places[-1] + 1
            own = pa.array([part] * batch.num_rows, pa.int64())
            columns = [batch.column(0), batch.column(1), own, pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow
            )

    return store(keyed.mapInArrow(run, schema), "mix-rows")


def schedule(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    source: str = "source",
    block: int = BLOCK,
    slots: int = ROUND,
) -> DataFrame:
    """Rows ``doc, block, phase, slot, place, weight``: each row's slot in the mix, place in its
    block and source's share in the phase. ``slots`` is no longer needed: no round is repeated.
    """
    spark = docs.sparkSession
    rows = _placed(docs, source)
    counts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(
        counts.select("key", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")),
        "mix-starts",
    )
    totals = starts.groupBy("key").agg(F.sum("n").alias("n"))
    targets = None
    if weights is not None:
        targets = {"null" if name is None else f"={name}": w for name, w in weights.items()}
        if wrong := sorted(key for key, w in targets.items() if not w > 0):
            raise ValueError(f"Weights that are not positive: {', '.join(wrong)}")
        named = spark.createDataFrame([(key,) for key in targets], "key string")
        if missing := sorted(r.key for r in totals.join(named, "key", "left_anti").limit(20).collect()):
            raise ValueError(f"Sources without a weight: {', '.join(missing)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sizes = {key: n for part in pieces(batches, "key", "n") for key, n in zip(*part)}
        own = targets or {key: math.sqrt(n) for key, n in sizes.items()}
        yield from turns({key: -(-n // block) for key, n in sizes.items()}, own)

    plan = store(
        map_rows(totals.coalesce(1), "key string, block long, phase int, slot long, weight double", run),
        "mix-plan",
    )
    return (
        rows.join(starts.drop("n"), ["key", "part"])
        .withColumn("block", F.expr(f"(place + before) div {block}"))
        .withColumn("place", F.pmod(F.col("place") + F.col("before"), F.lit(block)))
        .join(plan, ["key", "block"])
        .select("doc", "block", "phase", "slot", "place", "weight")
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    source: str = "source",
    block: int = BLOCK,
    slots: int = ROUND,
) -> DataFrame:
    """``docs`` in the order of the mix: sorted within and across partitions."""
    placed = schedule(docs, weights, source, block, slots)
    return (
        placed.repartitionByRange("slot", "place")
        .sortWithinPartitions("slot", "place")
        .select("doc.*")
    )
