"""Exact fixed-size batches over an ordered feed, without a global window.

The rows are written once, each with an id. Their keys and ids are range-partitioned and
sorted inside each partition. A row's number is then its place in its partition plus the
rows of all partitions before it, and only those per-partition counts (one row each) pass
through a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfgauge.sources.shared_tables import store, store_once

#: ``monotonically_increasing_id`` keeps the partition above this bit, the place below.
_PLACE_BITS = 33
#: Internal columns start like this.
_OWN = "__shelfgauge_"
#: Feed columns with the name of a batch column are moved to a name that starts like this.
OWN_NAME = "__feed_"
_ID, _PART = f"{_OWN}id", f"{_OWN}part"

#: Columns :func:`with_batch_id` adds.
BATCH_COLUMNS = ("position", "batch_id", "item_no")


def _keys(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(key).asc_nulls_last() if isinstance(key, str) else key for key in order]


def _refuse_clashes(df: DataFrame, *added: str) -> None:
    clashes = [name for name in df.columns if name in added or name.startswith(_OWN)]
    if clashes:
        raise ValueError(f"Columns with reserved names: {', '.join(clashes)}")


def _ordered(stored: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The ids of stored rows, range-partitioned and sorted by the order.

    Rows with one key, or exact copies, may be a third of the feed. Their ids, which
    follow the order of the files, break the ties and let them be split.
    """
    by = [*_keys(order), F.col(_ID).asc()]
    return stored.repartitionByRange(*by).sortWithinPartitions(*by).select(_ID)


def numbered_positions(ordered: DataFrame, name: str, write: Callable) -> DataFrame:
    """Ids with their 0-based places, from rows in order within and across partitions.

    The order is written before it is numbered: the boundaries of a range partitioning
    come from a sample and would differ when the plan is run again.
    """
    placed = write(ordered.withColumn(_PART, F.monotonically_increasing_id()), name)
    place = F.col(_PART).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    placed = placed.select(_ID, F.shiftright(_PART, _PLACE_BITS).alias(_PART), place.alias("_place"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(_PART)
        .agg(F.count("*").alias("_rows"))
        .select(_PART, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    # One row per written partition, so the size of this side is the partition count.
    return placed.join(F.broadcast(starts), _PART).select(
        _ID, (F.col("_start") + F.col("_place")).alias("position")
    )


def with_position(
    df: DataFrame,
    order: Sequence[str | Column] = ("product_id",),
    folder: str | None = None,
    *,
    fixed: bool = False,
) -> DataFrame:
    """Add ``position``, the row's 0-based place in the given order.

    Order keys are column names (nulls last) or sort expressions; ties follow the order
    of the input files. Runs two jobs at once: the rows are written with an id each, so
    that what lies before is computed once, then the ids in order. Only keys and ids are
    sorted; whole rows move once, when their places are joined to them. With ``fixed``
    the tables lie at fixed paths in ``folder``, and a later run takes them up again.
    """
    _refuse_clashes(df, "position")

    def write(frame: DataFrame, name: str) -> DataFrame:
        return store_once(frame, f"{folder}/{name}") if fixed else store(frame, name, folder)

    stored = write(df.withColumn(_ID, F.monotonically_increasing_id()), "feed")
    positions = numbered_positions(_ordered(stored, order), "positions", write)
    return stored.join(positions, _ID).drop(_ID)


def with_batch_id(
    df: DataFrame,
    batch_size: int = 8,
    order: Sequence[str | Column] = ("product_id",),
    folder: str | None = None,
    *,
    fixed: bool = False,
) -> DataFrame:
    """Cut the ordered feed into consecutive chunks of ``batch_size`` rows.

    Adds ``position`` in the feed, ``batch_id``, and ``item_no``, the place in the batch;
    a feed that has such columns is refused. Runs jobs at once, see :func:`with_position`.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    _refuse_clashes(df, *BATCH_COLUMNS)
    return with_position(df, order, folder, fixed=fixed).withColumns(
        {
            "batch_id": F.expr(f"position div {batch_size}"),
            "item_no": (F.col("position") % batch_size).cast("int"),
        }
    )


def by_category(key: str | Column = "product_id") -> tuple[str | Column, ...]:
    """Order that puts similar products into the same batch."""
    return ("category", key)


def batch_sizes(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch_id").agg(F.count("*").alias("n"))
