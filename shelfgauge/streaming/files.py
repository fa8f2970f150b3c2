"""Feeds that arrive as files whose headers differ, files delivered again, running batch numbers.

A stream of rows has one schema from its start. A stream of file names has none of the
files' headers in it: Spark's log of seen files makes each name arrive once, and each
micro-batch reads its files as :func:`read_feed` does, those of one header together. A
micro-batch that is repeated after a failure has the same files and writes over its own
folder, so nothing is written twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from shelfgauge.operators.batching import with_batch_id
from shelfgauge.operators.scoring import DEFAULT_RULES, Rule, with_pre_score
from shelfgauge.schema import REQUIRED_COLUMNS
from shelfgauge.sources.feed_csv import read_feed
from shelfgauge.sources.shared_tables import is_written

#: Files of a micro-batch; their names pass through the driver.
FILES = 1000

#: Groups of ids that a stream of changes keeps its state by.
GROUPS = 4096


def stream_files(spark: SparkSession, folder: str, files_per_trigger: int = FILES) -> DataFrame:
    """Stream of the names of new files in ``folder``; their content is not read."""
    source = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).option("maxFilesPerTrigger", str(files_per_trigger))
    return source.load(folder).select("path")


def feed_of_files(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """The contract columns of files with any headers that have them, in any order.

    Files with the same header are read together. ``options`` are those of :func:`read_feed`.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    firsts = lines.where((F.col("block") == 0) & (F.trim("value") != ""))
    found = firsts.groupBy("file").agg(F.min_by("value", "at").alias("header")).collect()
    by_header: dict[str, list[str]] = {}
    for row in found:
        by_header.setdefault(row.header, []).append(row.file)
    feeds = [read_feed(spark, sorted(files), **options).select(*REQUIRED_COLUMNS) for files in by_header.values()]
    if not feeds:
        return spark.createDataFrame([], ", ".join(f"{name} string" for name in REQUIRED_COLUMNS))
    return reduce(DataFrame.unionByName, feeds)


def _own_id(spark: SparkSession, checkpoint: str) -> str:
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def write_files(
    names: DataFrame, work: Callable[[DataFrame, str, int], DataFrame], out: str, checkpoint: str, **options
) -> DataStreamWriter:
    """Writer that applies ``work(feed, run, epoch)`` to the files of each micro-batch.

    Results lie in ``out/run=<id>/epoch=<n>``, where ``id`` is that of the checkpoint.
    """

    def run(frame: DataFrame, epoch: int) -> None:
        spark = frame.sparkSession
        paths = [row.path for row in frame.collect()]  # at most the files of a trigger
        own = _own_id(spark, checkpoint)
        if paths:
            result = work(feed_of_files(spark, paths, **options), own, epoch)
            result.write.mode("overwrite").parquet(f"{out}/run={own}/epoch={epoch}")

    return names.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def score_files(
    names: DataFrame, out: str, checkpoint: str, *, rules: Sequence[Rule] = DEFAULT_RULES, **options
) -> DataStreamWriter:
    """Writer for scored products of files with any header."""
    return write_files(names, lambda feed, run, epoch: with_pre_score(feed, rules), out, checkpoint, **options)


def batch_files(
    names: DataFrame,
    out: str,
    checkpoint: str,
    *,
    batch_size: int = 8,
    order: Sequence[str | Column] = ("product_id",),
    **options,
) -> DataStreamWriter:
    """Writer for products with batch numbers that go on from one micro-batch to the next.

    The first free number after each micro-batch is kept beside the results, under its
    epoch; a repeated micro-batch looks at those before it and gets the same numbers.
    """

    def work(feed: DataFrame, run: str, epoch: int) -> DataFrame:
        spark = feed.sparkSession
        place = f"{out}-numbers/run={run}"
        free = [n for n in range(epoch - 1, -1, -1) if is_written(spark, f"{place}/epoch={n}")][:1]
        start = spark.read.parquet(f"{place}/epoch={free[0]}").first().next_batch if free else 0
        batched = with_batch_id(feed, batch_size, order)
        batched = batched.withColumn("batch_id", F.col("batch_id") + start)
        last = batched.agg((F.coalesce(F.max("batch_id") + 1, F.lit(start))).alias("next_batch"))
        last.write.mode("overwrite").parquet(f"{place}/epoch={epoch}")
        return batched

    return write_files(names, work, out, checkpoint, **options)


def changed_products(feed: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Of a stream of products, those that are new or differ from their last delivery.

    The hash of each product's cells is kept as state under its id. Of several rows with
    one id in a micro-batch the first by content counts. Rows without an id pass.

    Ids are dealt to ``groups`` groups by their hash, and a group's ids and hashes are one
    row of state: a call of Python for every id takes many times as long as the comparison.
    Rows without an id are dealt by their content. A checkpoint keeps to its ``groups``.
    """
    content = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), f"`{name}`"), F.lit("")) for name in feed.columns])
    columns = [f"{field.name} {field.dataType.simpleString()}" for field in feed.schema]
    names = feed.columns

    def firsts(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values("__content").drop_duplicates("product_id")

    def changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            loose = frame["product_id"].isna()
            if loose.any():
                yield frame.loc[loose, names]
            first = firsts(frame[~loose])
            held = first if held is None else firsts(pd.concat([held, first]))
        known = dict(zip(*state.get)) if state.exists else {}
        delivered = list(zip(held["product_id"].tolist(), held["__content"].tolist()))
        new = [known.get(product) != content for product, content in delivered]
        if any(new):
            known.update(delivered)
            state.update((list(known), list(known.values())))
            yield held.loc[new, names]

    group = F.pmod(F.when(F.col("product_id").isNull(), F.col("__content")).otherwise(F.xxhash64("product_id")), F.lit(groups))
    dealt = feed.withColumn("__content", content).withColumn("__group", group)
    return dealt.groupBy("__group").applyInPandasWithState(
        changed, ", ".join(columns), "ids array<string>, contents array<long>", "append", "NoTimeout"
    )


def write_changes(
    feed: DataFrame, out: str, checkpoint: str, *, rules: Sequence[Rule] = DEFAULT_RULES, groups: int = GROUPS
) -> DataStreamWriter:
    """Writer for the scores of new and changed products only."""
    writer = with_pre_score(changed_products(feed, groups), rules).writeStream.outputMode("append").format("parquet")
    return writer.option("path", out).option("checkpointLocation", checkpoint)
