"""Running a user-supplied model over all batches.

The model is any function from a request text to an answer text. It is called inside
Spark tasks, so the executors must be able to load it; everything around the call
(requests, checks, retries, stubs) is set-based.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from shelfgauge.operators.batching import BATCH_COLUMNS, OWN_NAME, with_batch_id
from shelfgauge.operators.calls import ask
from shelfgauge.operators.merging import merge_results
from shelfgauge.operators.requests import PROMPT, STRICT_PROMPT, batch_requests
from shelfgauge.operators.responses import (
    parse_responses,
    result_rows,
    stub_rows,
    validate_responses,
    with_items,
)
from shelfgauge.schema import RESPONSE_SCHEMA
from shelfgauge.sources.shared_tables import is_written, new_path, store_once

Scorer = Callable[[str], str]

#: Bytes of requests that a calling task takes in at once. Spark's own limit is 64 MB, which
#: Python then holds more than once.
TAKEN = 4 << 20

_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Have Spark hand requests to Python in small batches; a limit the session sets itself holds."""
    own = spark.conf.get(_LIMIT, None)
    if own is None:
        spark.conf.set(_LIMIT, str(TAKEN))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_LIMIT)


def _asked(
    requests: DataFrame,
    scorer: Scorer,
    attempt: int,
    folder: str,
    *,
    pause: float,
    per_minute: float | None,
    callers: int,
) -> DataFrame:
    """Send ``(batch_id, n, request)`` rows to the model and store the answers: one job.

    Every answer is logged when it comes (see :mod:`shelfgauge.operators.calls`), so a run
    that is taken up again asks only what has no logged answer. Answers are checked and
    written before anything reads them: the model is costly and need not answer twice alike.
    What the run did is observed while they are written.
    """
    spark = requests.sparkSession
    place = f"{folder}/responses-{attempt}"
    if not is_written(spark, place):
        # the partition that Spark's hash partitioning gives a batch is its shard
        shard = F.pmod(F.hash("batch_id"), F.lit(callers)).alias("shard")
        dealt = requests.select("batch_id", "n", "request", shard).repartition(callers, "batch_id")
        work = ask(scorer, attempt, f"{folder}/calls-{attempt}", callers, pause, per_minute)
        answers = dealt.sortWithinPartitions("shard").mapInPandas(work, RESPONSE_SCHEMA)
        checked = validate_responses(parse_responses(answers)).drop("items")
        seen = Observation()
        observed = checked.observe(
            seen,
            F.count(F.lit(1)).alias("asked"),
            F.count_if(F.col("error").isNotNull()).alias("failed"),
            F.count_if(F.col("valid")).alias("valid"),
            F.count_if(F.coalesce("n_items", F.lit(0)) == 0).alias("empty"),
        )
        with _small_batches(spark):
            observed.write.mode("overwrite").parquet(place)
        told = spark.createDataFrame([(attempt, *(seen.get[name] for name in _METRICS))], _METRICS_SCHEMA)
        told.write.mode("overwrite").parquet(f"{folder}/metrics-{attempt}")
    return _stored_responses(spark, place)


_METRICS = ("asked", "failed", "valid", "empty")
_METRICS_SCHEMA = "attempt int, " + ", ".join(f"{name} long" for name in _METRICS)


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """What the run in ``folder`` did, as observed: batches asked, asked again, failed calls, stubbed.

    One row; reads no answers.
    """
    told = spark.read.schema(_METRICS_SCHEMA).parquet(f"{folder}/metrics-1", f"{folder}/metrics-2")
    first, second = F.col("attempt") == 1, F.col("attempt") == 2

    def total(name: str, which: Column, alias: str) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col(name))), F.lit(0)).cast("long").alias(alias)

    return told.agg(
        total("asked", first, "batches"),
        total("valid", first, "valid_at_once"),
        total("asked", second, "retried"),
        total("failed", first | second, "failed_calls"),
        total("empty", second, "stubbed"),
    )


#: Answers as they are stored, with their checks.
_STORED = "batch_id long, n long, attempt int, raw string, error string, n_items int, valid boolean"


def _stored_responses(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(place)


def responses_of(spark: SparkSession, folder: str) -> DataFrame:
    """All stored answers of the run in ``folder``, with the error texts of failed calls."""
    first, second = (f"{folder}/responses-{attempt}" for attempt in (1, 2))
    return _stored_responses(spark, first).unionByName(_stored_responses(spark, second))


def analyse(
    batched: DataFrame,
    scorer: Scorer,
    *,
    columns: Sequence[str] | None = None,
    prompt: str = PROMPT,
    strict_prompt: str = STRICT_PROMPT,
    pause: float = 0.0,
    per_minute: float | None = None,
    callers: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Results for every product of a feed with batch ids.

    All batches are asked once; the batches with an invalid answer are asked again with
    the strict request; products of batches that still have none get stubs.

    ``callers`` is the number of tasks that call the model, by default the session's
    shuffle partitions. ``per_minute`` is the rate of calls that all of them keep together;
    ``pause`` is a time that each of them waits between two calls. Neither bounds the
    partitions that build requests or read answers. Answers lie in ``folder``; a second
    call with the same folder, feed and callers takes up where the first ended.
    """
    spark = batched.sparkSession
    callers = callers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or new_path(spark, "analysis")
    requests = batch_requests(batched, columns, prompt, strict_prompt)

    def answers(rows: DataFrame, attempt: int, text: str) -> DataFrame:
        rows = rows.select("batch_id", "n", F.col(text).alias("request"))
        return _asked(
            rows, scorer, attempt, folder, pause=pause, per_minute=per_minute, callers=callers
        )

    first = answers(requests, 1, "prompt")
    failed = first.where(~F.col("valid")).select("batch_id")
    again = batched.join(failed, "batch_id", "left_semi")
    second = answers(batch_requests(again, columns, prompt, strict_prompt), 2, "strict_prompt")

    # Every batch has one first answer, and every rejected batch one second answer. So
    # the joins go by the batches that failed, which are few, and no answer text needs a
    # shuffle to find out which one counts.
    empty = F.coalesce("n_items", F.lit(0)) == 0
    usable = first.where("valid").unionByName(second.where(~empty))
    without = second.where(empty).select("batch_id")
    stubs = stub_rows(batched.join(without, "batch_id", "left_semi"))
    return result_rows(with_items(usable)).unionByName(stubs)


def enrich(
    feed: DataFrame,
    scorer: Scorer,
    *,
    batch_size: int = 8,
    order: Sequence[str | Column] = ("product_id",),
    folder: str | None = None,
    first_by: tuple[str, ...] = ("batch_id", "item_no"),
    **options,
) -> DataFrame:
    """Batch a feed, run the model over it and merge the results back.

    Every product gets the first result with its id, so the output has as many rows as
    the feed; with ``first_by=()`` an id that k products share gives k * k rows, as a
    plain left join does. ``options`` are those of :func:`analyse`.

    All tables of the run lie in ``folder``. Called again with the same folder, feed and
    arguments, it asks only what has no stored answer; remove the folder when the result
    is written. Feed columns with the name of a batch column keep their name and values.
    """
    spark = feed.sparkSession
    folder = folder or new_path(spark, "enrichment")
    moved = {name: f"{OWN_NAME}{name}" for name in BATCH_COLUMNS if name in feed.columns}
    order = [moved.get(key, key) if isinstance(key, str) else key for key in order]
    batched = with_batch_id(feed.withColumnsRenamed(moved), batch_size, order, folder, fixed=True)
    # The merge reads the results more than once, so the answers are parsed into a table.
    results = store_once(analyse(batched, scorer, folder=folder, **options), f"{folder}/results")
    merged = merge_results(batched.drop(*BATCH_COLUMNS), results, first_by=first_by)
    return merged.withColumnsRenamed({new: old for old, new in moved.items()})
