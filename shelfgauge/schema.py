"""Column lists and types shared by every part of the package."""

from __future__ import annotations

from pyspark.sql import types as T

# The contract columns of a supplier feed.
REQUIRED_COLUMNS = (
    "product_id",
    "title",
    "category",
    "material",
    "colour",
    "description",
    "price",
    "gender",
    "size_range",
    "season",
    "keywords",
    "stock_status",
)

# The columns a model result adds, in export order.
MODEL_COLUMNS = (
    "quality_score",
    "grade",
    "issues",
    "suggested_title",
    "suggested_description",
    "suggested_keywords",
    "missing_attributes",
    "improvement_priority",
)

# What a product gets when no model result carries its id.
MODEL_DEFAULTS = {
    "quality_score": 0,
    "grade": "F",
    "issues": "Analysis failed",
    "suggested_title": "",
    "suggested_description": "",
    "suggested_keywords": "",
    "missing_attributes": "",
    "improvement_priority": "High",
}

# Cell texts that a pandas CSV read turns into missing values.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# The grades, best first.
GRADES = ("A", "B", "C", "D", "F")

#: Every model answer must hold one object per product with these keys.
RESULT_KEYS = ("product_id", *MODEL_COLUMNS)

FEED_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in REQUIRED_COLUMNS])

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("raw", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

_LIST_COLUMNS = ("issues", "missing_attributes")

#: One row per product as the responses are resolved.
RESULT_SCHEMA = T.StructType(
    [
        T.StructField(
            name, T.ArrayType(T.StringType()) if name in _LIST_COLUMNS else T.StringType()
        )
        for name in RESULT_KEYS
    ]
)
