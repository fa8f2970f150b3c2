"""Parsing, checking and resolving raw model answers.

``responses`` frames hold ``batch_id, n, attempt, raw``, with at most one row per batch
and attempt. JSON is kept as ``VARIANT`` values, which tell an absent key from a null one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfgauge.functions import strip_fence
from shelfgauge.schema import RESULT_KEYS, RESULT_SCHEMA

# The stub a product gets when its batch has no usable answer.
STUB_ISSUE = "LLM analysis failed for this product"
STUB_SCORE, STUB_GRADE, STUB_PRIORITY = "0", "F", "High"


def with_items(df: DataFrame, text: Column | str = "raw") -> DataFrame:
    """Add ``items``, the elements of the JSON array in ``text``; null unless it is all one array.

    The JVM parser stops after the first value and ignores what follows. So the text
    is put into an outer array that ends with a hash of the text; only if the outer
    array has these two elements did the text hold exactly one value.

    The steps are columns of their own so that each text is parsed once.
    """
    outer = F.concat(F.lit("["), F.col("_text"), F.lit(',"'), F.col("_mark"), F.lit('"]'))
    pair = F.col("_pair")
    marked = F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == F.col("_mark")
    body = F.try_variant_get(F.get(pair, F.lit(0)), "$", "array<variant>")
    return (
        df.withColumn("_text", strip_fence(text))
        .withColumn("_mark", F.md5("_text"))
        .withColumn("_pair", F.try_variant_get(F.try_parse_json(outer), "$", "array<variant>"))
        .withColumn("items", F.when((F.size(pair) == 2) & marked, body))
        .drop("_text", "_mark", "_pair")
    )


def _members(item: Column) -> Column:
    """The item as a map; null where it is no object."""
    return F.try_variant_get(item, "$", "map<string,variant>")


def _has_all_keys(item: Column) -> Column:
    wanted = F.array(*map(F.lit, RESULT_KEYS))
    absent = F.array_except(wanted, F.map_keys(_members(item)))
    return F.coalesce(F.size(absent) == 0, F.lit(False))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add ``items`` (the parsed array, else null) and its length ``n_items``."""
    return with_items(responses).withColumn(
        "n_items", F.when(F.col("items").isNotNull(), F.size("items"))
    )


def validate_responses(parsed: DataFrame) -> DataFrame:
    """Add ``valid``: as many items as products, all of them objects with every key."""
    valid = (F.col("n_items") == F.col("n")) & F.forall("items", _has_all_keys)
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def usable_responses(validated: DataFrame) -> DataFrame:
    """The answers that count: a valid first one, else any non-empty second list.

    Works on :func:`validate_responses` or on a stored copy of it without ``items``.
    """
    first = (F.col("attempt") == 1) & F.col("valid")
    second = (F.col("attempt") == 2) & (F.coalesce(F.col("n_items"), F.lit(0)) > 0)
    answer = "items" if "items" in validated.columns else "raw"
    # The choice is made inside the aggregate (a null order is ignored): a filter on
    # the flags would be pushed below the parsing and parse each text again.
    kept = (
        validated.groupBy("batch_id")
        .agg(
            F.min_by(F.struct("attempt", answer), F.when(first | second, F.col("attempt"))).alias(
                "kept"
            )
        )
        .where(F.col("kept").isNotNull())
        .select("batch_id", "kept.*")
    )
    return kept if answer == "items" else with_items(kept).drop("raw")


def _field(item: Column, name: str) -> Column:
    text = F.try_variant_get(item, f"$.{name}", "string")
    if RESULT_SCHEMA[name].dataType.typeName() != "array":
        return text.alias(name)
    texts = F.try_variant_get(item, f"$.{name}", "array<string>")
    # An answer may give one text where a list was asked for.
    return F.coalesce(texts, F.when(text.isNotNull(), F.array(text))).alias(name)


def result_rows(usable: DataFrame) -> DataFrame:
    """One row per object in the usable answers; items that are no objects are dropped."""
    item = F.col("item")
    return (
        usable.select("batch_id", "attempt", F.posexplode_outer("items").alias("item_no", "item"))
        .where(_members(item).isNotNull())
        .select("batch_id", "attempt", "item_no", *[_field(item, name) for name in RESULT_KEYS])
    )


def _stub(product_id: Column, title: Column) -> dict[str, Column]:
    return {
        "product_id": product_id.cast("string"),
        "quality_score": F.lit(STUB_SCORE),
        "grade": F.lit(STUB_GRADE),
        "issues": F.array(F.lit(STUB_ISSUE)),
        "missing_attributes": F.array().cast("array<string>"),
        "suggested_title": F.coalesce(title.cast("string"), F.lit("")),
        "suggested_description": F.lit(""),
        "suggested_keywords": F.lit(""),
        "improvement_priority": F.lit(STUB_PRIORITY),
    }


def stub_rows(batched: DataFrame) -> DataFrame:
    """Stand-in results for the products of batches without a usable answer."""
    values = _stub(F.col("product_id"), F.col("title"))
    return batched.select(
        "batch_id",
        F.lit(0).alias("attempt"),
        "item_no",
        *[values[name].alias(name) for name in RESULT_KEYS],
    )


def resolve_results(batched: DataFrame, responses: DataFrame) -> DataFrame:
    """All results of a batched feed: ``batch_id, attempt, item_no`` and the nine result columns.

    ``attempt`` is 1 or 2 for model results and 0 for stubs. ``batched`` needs ``batch_id``,
    ``item_no``, ``product_id`` and ``title``. Responses that were stored with their
    validation flags are not checked again.

    The answer that counts is joined to the products of its batch, one row per batch, and
    either its items or the stubs come out, so that no answer is parsed for a second use.
    """
    if "valid" not in responses.columns:
        responses = validate_responses(parse_responses(responses))
    products = batched.groupBy("batch_id").agg(
        F.collect_list(F.struct("item_no", "product_id", "title")).alias("products")
    )
    joined = products.join(usable_responses(responses), "batch_id", "full").select(
        "batch_id", "attempt", F.posexplode(_entries()).alias("place", "entry")
    )
    item = F.col("entry.item")
    stub = _stub(F.col("entry.product_id"), F.col("entry.title"))
    from_stub = F.col("attempt").isNull()
    values = [
        F.when(from_stub, stub[name]).otherwise(_field(item, name)).alias(name)
        for name in RESULT_KEYS
    ]
    return joined.where(from_stub | _members(item).isNotNull()).select(
        "batch_id",
        F.coalesce("attempt", F.lit(0)).alias("attempt"),
        F.when(from_stub, F.col("entry.item_no")).otherwise(F.col("place")).alias("item_no"),
        *values,
    )


def _entries() -> Column:
    """The items of an answer, or else the products of the batch, in one shape."""
    nothing = {"item": "variant", "item_no": "int", "product_id": "string", "title": "string"}

    def entry(**given: Column) -> Column:
        fields = [given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in nothing.items()]
        return F.struct(*fields)

    stubs = F.transform(
        "products",
        lambda p: entry(item_no=p["item_no"], product_id=p["product_id"], title=p["title"]),
    )
    return F.when(F.col("attempt").isNull(), stubs).otherwise(
        F.transform("items", lambda item: entry(item=item))
    )
