"""Feeds that arrive as files in a folder.

Every rule looks at one product, so the column functions of the batch path run on a
stream unchanged and need no state or watermark. The file source keeps a log of the
files it has read, which is what makes each file count once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from shelfgauge.operators.enrichment import Scorer, enrich
from shelfgauge.operators.scoring import DEFAULT_RULES, Rule, with_pre_score
from shelfgauge.schema import FEED_SCHEMA
from shelfgauge.sources.feed_csv import (
    READ_OPTIONS,
    RECORD,
    WRITE_OPTIONS,
    clean_feed,
    export_columns,
    refuse_surplus,
)
from shelfgauge.sources.shared_tables import drop_folder, shared_folder


def stream_feed(
    spark: SparkSession,
    folder: str,
    *,
    files_per_trigger: int | None = None,
    line_breaks_in_cells: bool = True,
) -> DataFrame:
    """Cleaned stream of the CSV files in ``folder``.

    A stream has one fixed schema, so the headers must be the contract columns in their
    order; a file with another header stops the stream, and so does a record with more
    cells than the header. ``line_breaks_in_cells=False`` lets Spark split large files.
    """
    options = {**READ_OPTIONS, "multiLine": str(line_breaks_in_cells).lower()}
    if files_per_trigger:
        options["maxFilesPerTrigger"] = str(files_per_trigger)
    schema = StructType([*FEED_SCHEMA, StructField(RECORD, StringType())])
    return clean_feed(refuse_surplus(spark.readStream.schema(schema).options(**options).csv(folder)))


def score_stream(feed: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    return with_pre_score(feed, rules)


def write_scores(
    feed: DataFrame,
    out: str,
    checkpoint: str,
    *,
    rules: Sequence[Rule] = DEFAULT_RULES,
    sink_format: str = "parquet",
) -> DataStreamWriter:
    """Writer for scored products; the caller adds a trigger and starts it."""
    writer = score_stream(feed, rules).writeStream.outputMode("append").format(sink_format)
    if sink_format == "csv":
        writer = writer.options(**WRITE_OPTIONS)
    return writer.option("path", out).option("checkpointLocation", checkpoint)


def write_enriched(
    feed: DataFrame,
    scorer: Scorer,
    out: str,
    checkpoint: str,
    *,
    batch_size: int = 8,
    order: Sequence[str | Column] = ("product_id",),
    **options,
) -> DataStreamWriter:
    """Writer that enriches each micro-batch into ``out/run=<id>/epoch=<n>``.

    ``id`` is that of the checkpoint, so streams with checkpoints of their own never write
    over each other's results. A micro-batch that is repeated after a failure takes up the
    answers that were stored, overwrites its own folder, and then drops its intermediate
    tables, so each product is written once and no stored answer is asked for again.
    """

    def run(frame: DataFrame, epoch: int) -> None:
        spark = frame.sparkSession
        own = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        folder = f"{shared_folder(spark)}/shelfgauge/stream-{own}/epoch-{epoch}"
        enriched = enrich(
            frame, scorer, batch_size=batch_size, order=order, folder=folder, **options
        )
        path = f"{out}/run={own}/epoch={epoch}"
        export_columns(enriched).write.mode("overwrite").parquet(path)
        drop_folder(spark, folder)

    return feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
