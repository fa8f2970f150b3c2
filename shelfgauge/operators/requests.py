"""One model request per batch."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfgauge.operators.batching import BATCH_COLUMNS, OWN_NAME
from shelfgauge.operators.scoring import DEFAULT_RULES, Rule

_ANSWER_FIELDS = """\
- product_id: copied from the input
- quality_score: whole number from 0 to 100
- grade: A, B, C, D or F
- issues: list of texts, one per problem found
- missing_attributes: list with the names of empty attributes
- suggested_title: a better title
- suggested_description: three sentences on material, use and care
- suggested_keywords: five search keywords, separated by commas
- improvement_priority: High, Medium or Low
"""


def rule_lines(rules: Sequence[Rule]) -> str:
    """What each rule costs, as lines of a request."""
    return "".join(f"- {rule.label or rule.name.replace('_', ' ')}: {rule.points}\n" for rule in rules)


_PROMPT = (
    """\
Judge the catalogue quality of these {n} products, given as a JSON array:
{products}

Answer with one JSON array of exactly {n} objects, in input order, with these keys:
"""
    + _ANSWER_FIELDS
    + """
Every product starts at 100 points and loses points for each problem:
{rules}- vague description: 10

The answer must be the JSON array alone.
"""
)


def prompt_for(rules: Sequence[Rule]) -> str:
    """Request text for these rules; ``{n}`` and ``{products}`` are filled in per batch."""
    return _PROMPT.replace("{rules}", rule_lines(rules))


#: Request text for the default rules.
PROMPT = prompt_for(DEFAULT_RULES)

#: Second, stricter request for batches whose first answer was unusable.
STRICT_PROMPT = (
    """\
Output raw JSON only: the first character is [ and the last one is ].
No Markdown fence and no other text.

Input, {n} products:
{products}

Output, one array of exactly {n} objects with these keys:
"""
    + _ANSWER_FIELDS
)

_SLOT = re.compile(r"\{(n|products)\}")


def fill_template(template: str, n: Column, products: Column) -> Column:
    """Put the columns into the slots; text inside ``products`` is never read as a slot."""
    slots = {"n": n.cast("string"), "products": products}
    pieces = [
        slots[piece] if at % 2 else F.lit(piece)
        for at, piece in enumerate(_SLOT.split(template))
        if at % 2 or piece
    ]
    return F.concat(*pieces)


def batch_products(
    batched: DataFrame, columns: Sequence[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """``(batch_id, n, products_json)``; absent values appear as ``null``, not as gaps.

    No group is larger than the batch size. ``partitions`` fixes the number of tasks,
    which Spark would else choose by the size of the data.
    """
    names = columns or [name for name in batched.columns if name not in BATCH_COLUMNS]
    # Feed columns that were moved out of the way appear under their own names.
    product = F.struct(*[F.col(f"`{name}`").alias(name.removeprefix(OWN_NAME)) for name in names])
    in_order = F.array_sort(F.collect_list(F.struct("item_no", product.alias("product"))))
    if partitions:
        batched = batched.repartition(partitions, "batch_id")
    return (
        batched.groupBy("batch_id")
        .agg(F.count("*").alias("n"), in_order.alias("rows"))
        .select(
            "batch_id",
            "n",
            F.to_json("rows.product", {"ignoreNullFields": "false"}).alias("products_json"),
        )
    )


def batch_requests(
    batched: DataFrame,
    columns: Sequence[str] | None = None,
    prompt: str = PROMPT,
    strict_prompt: str = STRICT_PROMPT,
    partitions: int | None = None,
) -> DataFrame:
    """``(batch_id, n, prompt, strict_prompt)`` for a feed with batch ids."""
    n, products = F.col("n"), F.col("products_json")
    return batch_products(batched, columns, partitions).select(
        "batch_id",
        "n",
        fill_template(prompt, n, products).alias("prompt"),
        fill_template(strict_prompt, n, products).alias("strict_prompt"),
    )
