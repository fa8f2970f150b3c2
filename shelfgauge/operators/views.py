"""Projections of scored and enriched feeds for display."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfgauge.functions import (
    number_or_zero,
    or_dash,
    priority_class,
    score_band,
    score_class,
    shown_issues,
    shows_nothing,
    strip,
)
from shelfgauge.schema import REQUIRED_COLUMNS

# The columns of the preview and of the result table.
PREVIEW_COLUMNS = ("product_id", "title", "pre_score", "pre_grade", "pre_issues")
RESULT_COLUMNS = (
    "product_id",
    "title",
    "quality_score",
    "grade",
    "issues",
    "improvement_priority",
    "suggested_title",
    "suggested_keywords",
)
# The enriched fields of a before/after comparison, in display order.
ENRICHED_FIELDS = (
    "suggested_title",
    "suggested_description",
    "suggested_keywords",
    "missing_attributes",
)


def _existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[name for name in names if name in df.columns])


def preview(scored: DataFrame) -> DataFrame:
    """Local scores before the model has run, shown as ``quality_score``."""
    return _existing(scored, PREVIEW_COLUMNS).withColumnRenamed("pre_score", "quality_score")


def results_view(enriched: DataFrame) -> DataFrame:
    return _existing(enriched, RESULT_COLUMNS)


def title_comparison(enriched: DataFrame) -> DataFrame:
    """Old and new title of the products that have a suggestion."""
    return enriched.where(strip("suggested_title") != "").select(
        "product_id",
        F.col("title").alias("original_title"),
        F.col("suggested_title").alias("ai_suggested_title"),
        "quality_score",
    )


def first_products(df: DataFrame, n: int, order: Sequence[str | Column] = ("product_id",)) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def find_products(df: DataFrame, ids: DataFrame | Iterable[str], *first_by: str) -> DataFrame:
    """The products with the given ids, one row each.

    ``ids`` is a list, pushed into the scan as a filter, or a frame with ``product_id``.
    Where an id repeats, the row with the smallest ``first_by`` columns is taken, which
    must be named for that (a row number gives the first row); ties go by content. It is
    a minimum, so copies of one id shrink before the shuffle.
    """
    if not first_by:
        raise ValueError("Name the columns that say which row of an id comes first")
    wanted = df.withColumn("product_id", F.col("product_id").cast("string"))
    if isinstance(ids, DataFrame):
        wanted = wanted.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    else:
        wanted = wanted.where(F.col("product_id").isin([str(value) for value in ids]))
    rest = [name for name in df.columns if name not in ("product_id", *first_by)]
    firsts = wanted.groupBy("product_id").agg(
        F.min(F.struct(*first_by, *[F.col(f"`{name}`") for name in rest])).alias("_row")
    )
    return firsts.select("product_id", "_row.*").select(*[f"`{name}`" for name in df.columns])


def missing_badges(feed: DataFrame) -> DataFrame:
    """The contract fields of each product that a detail view marks as missing."""
    flags = {f"_missing_{name}": name for name in REQUIRED_COLUMNS}
    count = sum((F.col(flag).cast("int") for flag in flags), F.lit(0))
    names = [F.when(F.col(flag), F.lit(name)) for flag, name in flags.items()]
    return feed.select(
        "product_id", *[shows_nothing(name).alias(flag) for flag, name in flags.items()]
    ).select(
        "product_id", F.concat_ws(", ", *names).alias("missing_fields"), count.alias("n_missing")
    )


def before_after(enriched: DataFrame) -> DataFrame:
    """Long form of all products: 12 supplier fields, then 4 model fields, ready to show."""
    sides = [("before", name) for name in REQUIRED_COLUMNS]
    sides += [("after", name) for name in ENRICHED_FIELDS]
    cells = [
        F.struct(
            F.lit(side).alias("side"),
            F.lit(at).alias("field_no"),
            F.lit(name).alias("field"),
            F.col(name).cast("string").alias("raw"),
        )
        for at, (side, name) in enumerate(sides)
    ]
    before, shown = F.col("side") == "before", or_dash("raw")
    return enriched.select("product_id", F.inline(F.array(*cells))).select(
        "product_id",
        "side",
        "field_no",
        "field",
        F.when(before, shown).otherwise(strip(shown)).alias("value"),
        (before & shows_nothing("raw")).alias("missing"),
    )


def product_badges(enriched: DataFrame) -> DataFrame:
    """Score, grade and priority bands and the issue list of each product's detail view.

    Score texts are judged by their number, 0 where they have none.
    """
    score = number_or_zero("quality_score")
    return enriched.select(
        "product_id",
        "quality_score",
        "grade",
        score_band(score).alias("score_band"),
        score_class(score).alias("score_class"),
        priority_class("improvement_priority").alias("priority_class"),
        shown_issues("issues").alias("issue_list"),
    )
