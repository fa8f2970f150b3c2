"""Joining model results to the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfgauge.functions import to_score
from shelfgauge.schema import MODEL_COLUMNS, MODEL_DEFAULTS

#: Results per product id from which an id is joined apart from the others.
HOT_ROWS = 1_000_000

_LISTS = ("issues", "missing_attributes")


def _result_column(results: DataFrame, name: str) -> Column:
    """The value a matched product gets; never null for lists, so null means "no match" there."""
    if name not in results.columns:
        return F.lit(None).cast("string").alias(name)
    value = F.col(name)
    if name in _LISTS:
        if results.schema[name].dataType.typeName() == "array":
            value = F.array_join(value, "; ")
        value = F.coalesce(value.cast("string"), F.lit(""))
    elif name == "quality_score":
        value = to_score(value)
    else:
        value = value.cast("string")
    return value.alias(name)


def _with_defaults(df: DataFrame, own: list[str]) -> DataFrame:
    filled = [F.coalesce(name, F.lit(MODEL_DEFAULTS[name])).alias(name) for name in MODEL_COLUMNS]
    return df.select(*[f"`{name}`" for name in own], *filled)


def first_results(results: DataFrame, *first_by: str) -> DataFrame:
    """One result per product id: the one with the smallest ``first_by``."""
    rest = [name for name in results.columns if name not in ("product_id", *first_by)]
    row = F.min(F.struct(*first_by, *rest)).alias("row")
    return results.groupBy("product_id").agg(row).select("product_id", "row.*")


def merge_results(
    feed: DataFrame,
    results: DataFrame,
    *,
    first_by: tuple[str, ...] = (),
    unique: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join on ``product_id``; products without a result get the defaults.

    An id with several results gives several rows; name ``first_by`` columns to keep
    one. Null ids match nothing. Model columns the feed already has become ``prev_*``, in
    place of older ones. ``unique`` says that no id has several results.

    Skew: Spark splits hot partitions of the left side of a left join by itself, but
    not those of the right side. Ids with ``hot_rows`` results or more are therefore
    inner-joined apart, where both sides can be split: such an id has a match for
    certain, so nothing is lost. There are at most as many such ids as results per
    ``hot_rows``. Without any, that branch is empty and dropped; with ``unique`` or
    ``first_by`` they are not searched for.
    """
    if "product_id" not in results.columns:
        raise ValueError("Missing required columns: product_id")
    again = {name: f"prev_{name}" for name in MODEL_COLUMNS if name in feed.columns}
    feed = (
        feed.drop(*again.values())
        .withColumnsRenamed(again)
        .withColumn("product_id", F.col("product_id").cast("string"))
    )
    results = results.where(F.col("product_id").isNotNull())
    if first_by:
        results = first_results(results, *first_by)
    results = results.select(
        F.col("product_id").cast("string").alias("product_id"),
        *[_result_column(results, name) for name in MODEL_COLUMNS],
    )
    own = feed.columns
    if first_by or unique:
        return _with_defaults(feed.join(results, "product_id", "left"), own)

    hot = (
        results.groupBy("product_id")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= hot_rows)
        .select("product_id")
    )
    hot = F.broadcast(hot)  # a row per hot_rows results at most
    usual = feed.join(hot, "product_id", "left_anti").join(
        results.join(hot, "product_id", "left_anti"), "product_id", "left"
    )
    apart = feed.join(hot, "product_id", "left_semi").join(
        results.join(hot, "product_id", "left_semi"), "product_id"
    )
    return _with_defaults(usual.unionByName(apart), own)
