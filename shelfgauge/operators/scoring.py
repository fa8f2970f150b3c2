"""Rule-based product scores.

A rule is data: when it fires, what it costs, what it reports. All rules are evaluated
in one projection of built-in expressions, so scoring needs no shuffle and no Python
on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfgauge.functions import (
    contains_any,
    grade_of,
    has_words,
    is_missing,
    parse_float,
    strip,
    word_count,
)

# Title words that name a gender, straight apostrophes only.
GENDER_WORDS = ("women's", "men's", "womens", "mens", "unisex", "boys'", "girls'")
# Signs of more than one colour in a cell.
AMBIGUOUS_COLOUR = "[/&]"
# Fixed value: shortest acceptable description, in words.
MIN_WORDS = 20


@dataclass(frozen=True)
class Rule:
    """``fires`` and ``issue`` build columns, so that rules can be declared without a session."""

    name: str
    points: int
    fires: Callable[[], Column]
    issue: Callable[[], Column]
    #: attribute reported as missing, if the rule is about absence
    attribute: str | None = None
    #: how a request to a model names the problem, by default the name
    label: str = ""


def absent(column: str, points: int) -> Rule:
    """The cell is null or blank."""
    return Rule(
        f"{column}_missing",
        points,
        lambda: is_missing(column),
        lambda: F.lit(f"Missing {column}"),
        column,
        f"no {column.replace('_', ' ')}",
    )


def _ambiguous_colour() -> Column:
    return F.coalesce(F.col("colour").rlike(AMBIGUOUS_COLOUR), F.lit(False))


def _too_short() -> Column:
    return ~is_missing("description") & ~has_words("description", MIN_WORDS)


def _bad_price() -> Column:
    return parse_float("price").isNull()


def _not_positive() -> Column:
    # NaN sorts above every number in Spark, so it does not fire.
    return F.coalesce(parse_float("price") <= 0, F.lit(False))


#: The default rules, in the order their issues are reported.
DEFAULT_RULES: tuple[Rule, ...] = (
    absent("material", 20),
    absent("colour", 10),
    Rule(
        "colour_ambiguous",
        10,
        _ambiguous_colour,
        lambda: F.concat(F.lit("Ambiguous colour value: '"), strip("colour"), F.lit("'")),
        label="ambiguous colour (with / or &)",
    ),
    absent("description", 15),
    Rule(
        "description_short",
        15,
        _too_short,
        lambda: F.concat(
            F.lit("Description too short ("),
            word_count("description").cast("string"),
            F.lit(f" words, need ≥{MIN_WORDS})"),
        ),
        label=f"description shorter than {MIN_WORDS} words",
    ),
    Rule(
        "title_gender",
        10,
        lambda: ~contains_any("title", GENDER_WORDS),
        lambda: F.lit("Title missing gender indicator"),
        label="no gender in the title",
    ),
    absent("keywords", 10),
    Rule(
        "price_not_positive",
        15,
        _not_positive,
        lambda: F.lit("Price is zero or negative"),
        label="price of 0 or less",
    ),
    Rule(
        "price_invalid",
        15,
        _bad_price,
        lambda: F.lit("Missing or invalid price"),
        "price",
        "price absent or no number",
    ),
    absent("stock_status", 5),
)


def _fired(texts: dict[str, Column]) -> list[Column]:
    """Each text where its flag is set, else null."""
    return [F.when(F.col(flag), text) for flag, text in texts.items()]


def _joined(texts: dict[str, Column]) -> Column:
    """The fired texts with ``"; "`` between them, or ``None`` if no flag is set."""
    any_fired = reduce(lambda left, flag: left | F.col(flag), texts, F.lit(False))
    return F.concat_ws("; ", *_fired(texts), F.when(~any_fired, "None"))


def with_pre_score(
    df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, *, lists: bool = False
) -> DataFrame:
    """Add ``pre_score``, ``pre_grade``, ``pre_issues`` and ``pre_missing_attributes``.

    The score is 100 less the points of the rules that fire, never below 0. With
    ``lists`` the two texts are also added as arrays (``*_list``), which keep an
    issue that itself contains ``;`` in one piece.
    """
    # Each rule becomes a flag first, so that score and texts share one evaluation.
    flags = {f"_fires_{rule.name}": rule for rule in rules}
    lost = sum(
        (F.when(F.col(flag), rule.points).otherwise(0) for flag, rule in flags.items()), F.lit(0)
    )
    issues = {flag: rule.issue() for flag, rule in flags.items()}
    attributes = {flag: F.lit(rule.attribute) for flag, rule in flags.items() if rule.attribute}
    added = {
        "pre_score": F.greatest(F.lit(0), F.lit(100) - lost),
        "pre_issues": _joined(issues),
        "pre_missing_attributes": _joined(attributes),
    }
    if lists:
        added["pre_issues_list"] = F.array_compact(F.array(*_fired(issues)))
        added["pre_missing_attributes_list"] = F.array_compact(F.array(*_fired(attributes)))
    last = ["pre_score", "pre_grade", *[name for name in added if name != "pre_score"]]
    own = [name for name in df.columns if name not in last]
    return (
        df.withColumns({flag: rule.fires() for flag, rule in flags.items()})
        .withColumns(added)
        .withColumn("pre_grade", grade_of("pre_score"))
        .select(*[f"`{name}`" for name in own], *last)
    )


def flaw_profile(df: DataFrame) -> DataFrame:
    """One row with the counts of four common flaws, from one pass."""
    price = strip("price")
    return df.agg(
        F.count_if(is_missing("material")).alias("missing_material"),
        F.count_if(_ambiguous_colour()).alias("ambiguous_colour"),
        F.count_if(price.isNull() | price.isin("", "0", "0.0")).alias("missing_price"),
        F.count_if(is_missing("stock_status")).alias("missing_stock"),
    )


def pre_grade_profile(scored: DataFrame) -> DataFrame:
    """Products and score range per local grade, beside the range over the whole feed."""
    return (
        scored.groupBy("pre_grade")
        .agg(
            F.count("*").alias("n_products"),
            F.min("pre_score").alias("min_score"),
            F.max("pre_score").alias("max_score"),
        )
        .groupBy()
        .agg(
            F.min("min_score").alias("feed_min_score"),
            F.max("max_score").alias("feed_max_score"),
            F.collect_list(F.struct("pre_grade", "n_products", "min_score", "max_score")).alias(
                "grades"
            ),
        )
        .select(F.inline("grades"), "feed_min_score", "feed_max_score")
    )
