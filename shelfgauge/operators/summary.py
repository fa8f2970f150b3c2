"""Dashboard figures of an enriched feed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfgauge.functions import first_piece, number_or_zero, round_tenth, strip
from shelfgauge.schema import GRADES
from shelfgauge.sources.shared_tables import store

# The review threshold and the hours one manual review takes.
REVIEW_BELOW = 60
HOURS_PER_REVIEW = 0.25
# What is shown of the worst products.
WORST_COLUMNS = ("product_id", "title", "quality_score", "grade", "issues")


def needs_review(score: Column | str = "quality_score") -> Column:
    return (F.col(score) if isinstance(score, str) else score) < REVIEW_BELOW


def _scalars(n_columns: int) -> list[Column]:
    score = number_or_zero("quality_score")
    return [
        F.count("*").alias("total_products"),
        round_tenth(F.avg(score)).alias("average_quality_score"),
        F.count_if(needs_review(score)).alias("products_needing_review"),
        F.lit(n_columns).alias("n_columns"),
    ]


def _derived(figures: DataFrame) -> DataFrame:
    points = round_tenth(100 - F.col("average_quality_score"))
    hours = round_tenth(F.col("products_needing_review") * F.lit(HOURS_PER_REVIEW))
    return figures.withColumn("points_from_perfect", points).withColumn("hours_saved", hours)


def summary_scalars(enriched: DataFrame) -> DataFrame:
    """One row, one pass: size, mean score and review effort.

    Scores count with their fractions, and as 0 where they are no numbers.
    """
    return _derived(enriched.agg(*_scalars(len(enriched.columns))))


def _counters(column: str, categories: Sequence[str]) -> list[Column]:
    return [
        F.count_if(F.col(column) == category).alias(f"c{at}")
        for at, category in enumerate(categories)
    ]


def _as_rows(counts: DataFrame, column: str, categories: Sequence[str], count_as: str) -> DataFrame:
    pairs = [
        F.struct(F.lit(category).alias(column), F.col(f"c{at}").alias(count_as))
        for at, category in enumerate(categories)
    ]
    return counts.select(F.inline(F.array(*pairs)))


def zero_filled_counts(
    df: DataFrame, column: str, categories: Sequence[str], count_as: str = "n_products"
) -> DataFrame:
    """Rows per category, 0 where there are none; other values are left out.

    One global aggregate whose counters become rows, so no join and no shuffle of rows.
    """
    return _as_rows(df.agg(*_counters(column, categories)), column, categories, count_as)


def grade_distribution(enriched: DataFrame, column: str = "grade") -> DataFrame:
    return zero_filled_counts(enriched, column, GRADES)


def worst_products(enriched: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` lowest scores, ties by id, with the first issue of each.

    Scores that are texts become numbers first, 0 where they are none.
    """
    have = [name for name in WORST_COLUMNS if name in enriched.columns]
    worst = enriched.select(*have)
    if dict(worst.dtypes)["quality_score"] == "string":
        worst = worst.withColumn("quality_score", number_or_zero("quality_score"))
    worst = worst.orderBy("quality_score", "product_id").limit(k)
    if "issues" not in have:
        return worst.withColumn("top_issue", F.lit("N/A"))
    return worst.withColumn("top_issue", first_piece("issues"))


def missing_attribute_frequency(enriched: DataFrame) -> DataFrame:
    """How often each attribute is reported missing, most frequent first."""
    return (
        enriched.select(F.explode(F.split("missing_attributes", ";")).alias("attribute"))
        .select(strip("attribute").alias("attribute"))
        .where((F.col("attribute") != "") & (F.lower("attribute") != "none"))
        .groupBy("attribute")
        .agg(F.count("*").alias("n_products"))
        .orderBy(F.desc("n_products"), "attribute")
    )


@dataclass(frozen=True)
class Summary:
    """The dashboard as four small lazy frames."""

    scalars: DataFrame
    grades: DataFrame
    worst: DataFrame
    attributes: DataFrame


def summarise(enriched: DataFrame, folder: str | None = None) -> Summary:
    """All figures from one evaluation of ``enriched``.

    The columns that the figures need are written once, and all four frames read them;
    scalars and grades are one aggregate, also written. Both tables lie in ``folder``, by
    default that of this process.
    """
    names = dict.fromkeys((*WORST_COLUMNS, "missing_attributes"))
    needed = store(enriched.select(*[n for n in names if n in enriched.columns]), "summary", folder)
    figures = store(
        needed.agg(*_scalars(len(enriched.columns)), *_counters("grade", GRADES)), "figures", folder
    )
    return Summary(
        _derived(figures.drop(*[f"c{at}" for at in range(len(GRADES))])),
        _as_rows(figures, "grade", GRADES, "n_products"),
        worst_products(needed),
        missing_attribute_frequency(needed),
    )
