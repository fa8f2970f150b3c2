"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfgauge import operators as op
from shelfgauge.plans import fixtures
from shelfgauge.schema import MODEL_COLUMNS, RESULT_KEYS
from shelfgauge.functions import round_tenth
from shelfgauge.sources import clean_feed, export_columns, new_path, read_feed, write_feed, write_ordered
from shelfgauge.streaming import (
    batch_files, figures_of, score_files, stream_feed, stream_files, write_changes, write_enriched,
    write_figures, write_scores,
)

SCORED = ("product_id", "pre_score", "pre_grade")
BATCHED = ("product_id", "batch_id", "item_no")

#: Bytes of stored documents that go into one large file; as text they are several blocks.
FILE_BYTES = 128 << 20


def feed(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.on_spark(spark, folder, fixtures.FEED)


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """The columns that decide the order; batch numbers need no others."""
    return feed(spark, folder).select("product_id", "category")


def model_results(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.on_spark(spark, folder, fixtures.RESULTS)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.on_spark(spark, folder, fixtures.ANSWERS)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return op.with_pre_score(feed(spark, folder))


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    return op.merge_results(feed(spark, folder), model_results(spark, folder))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return clean_feed(fixtures.on_spark(spark, folder, fixtures.RAW_FEED))


def product_number():
    """Numeric product order, which is the document order of the answers."""
    return F.substring("product_id", 2, 20).cast("bigint").asc_nulls_last()


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "feed-csv")
    write_feed(feed(spark, folder), path)
    return read_feed(spark, path)


def stream_scored(spark: SparkSession, folder: str) -> DataFrame:
    source, out, log = (new_path(spark, name) for name in ("stream-in", "stream-out", "stream-log"))
    write_feed(feed(spark, folder), source)
    writer = write_scores(stream_feed(spark, source), out, log).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(out).select(*SCORED, "pre_issues")


def parsed_responses(spark: SparkSession, folder: str) -> DataFrame:
    parsed = op.parse_responses(answers(spark, folder))
    return parsed.select("batch_id", "attempt", "n", "n_items")


def validated_batches(spark: SparkSession, folder: str) -> DataFrame:
    checked = op.validate_responses(op.parse_responses(answers(spark, folder)))
    return checked.select("batch_id", "attempt", "valid")


def _flat(results: DataFrame) -> DataFrame:
    for name in ("issues", "missing_attributes"):
        results = results.withColumn(name, F.array_join(name, "; "))
    return results.select("batch_id", "attempt", "item_no", *RESULT_KEYS)


def resolved_results(spark: SparkSession, folder: str) -> DataFrame:
    needed = feed(spark, folder).select("product_id", "title")
    batched = op.with_batch_id(needed, 8, [product_number()])
    return _flat(op.resolve_results(batched, answers(spark, folder)))


def sample_model():
    """A stand-in model: counts empty fields, and fails for some batches on purpose.

    The function is local so that it travels to the executors by value.
    """

    def scorer(request: str) -> str:
        strict = request.startswith("Output raw JSON")
        line = next(line for line in request.split("\n") if line.startswith("["))
        products = json.loads(line)
        number = int(products[0]["product_id"][1:])
        if number % 3 == 0 and not strict:
            return "I could not read these products."
        if number % 6 == 0:
            raise TimeoutError("no answer")
        results = []
        for product in products:
            empty = [name for name, value in product.items() if value is None]
            results.append(
                {
                    "product_id": product["product_id"],
                    "quality_score": 100 - 10 * len(empty),
                    "grade": "B",
                    "issues": [f"{name} is empty" for name in empty],
                    "missing_attributes": empty,
                    "suggested_title": "New " + product["title"],
                    "suggested_description": None,
                    "suggested_keywords": "a, b",
                    "improvement_priority": "Low",
                }
            )
        return "```json\n" + json.dumps(results) + "\n```"

    return scorer


ENRICHED = (
    "product_id",
    "quality_score",
    "grade",
    "issues",
    "missing_attributes",
    "suggested_title",
    "suggested_description",
    "improvement_priority",
)


def enrich_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The feed has a column of its own with the name of a batch column."""
    own = feed(spark, folder).withColumn("item_no", F.concat(F.lit("own "), "product_id"))
    return op.enrich(own, sample_model()).select(*ENRICHED, "item_no")


def run_figures(spark: SparkSession, folder: str) -> DataFrame:
    """What a run of the model did, as observed while it ran."""
    place = new_path(spark, "observed-run")
    batched = op.with_batch_id(feed(spark, folder), folder=place, fixed=True)
    op.analyse(batched, sample_model(), folder=place)
    return op.run_metrics(spark, place)


def stream_enriched(spark: SparkSession, folder: str) -> DataFrame:
    source, out, log = (new_path(spark, name) for name in ("enrich-in", "enrich-out", "enrich-log"))
    write_feed(feed(spark, folder), source)
    writer = write_enriched(stream_feed(spark, source), sample_model(), out, log)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(*ENRICHED)


def csv_two_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Two deliveries with columns in different order, read apart and put together by name."""
    odd = F.substring("product_id", -1, 1).isin("1", "3", "5", "7", "9")
    rows = feed(spark, folder)
    first, second = (new_path(spark, name) for name in ("feed-odd", "feed-even"))
    write_feed(rows.where(odd), first)
    turned = rows.where(~odd).select(*reversed(rows.columns)).withColumnRenamed("size_range", "Size Range ")
    write_feed(turned, second)
    return read_feed(spark, first).unionByName(read_feed(spark, second))


def _large_files(spark: SparkSession, folder: str) -> int:
    """In how many files the feed is delivered; looks at the sizes of files only."""
    stored = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/documents.parquet")
    return math.ceil((stored.agg(F.sum("length")).first()[0] or 1) / FILE_BYTES)


def csv_split(spark: SparkSession, folder: str) -> DataFrame:
    """Large files whose cells hold quotes and line breaks, each read by many tasks."""
    path = new_path(spark, "feed-breaks")
    told = F.concat("description", F.lit('\r\n"so",\n'), "title")
    rows = feed(spark, folder).withColumn("description", told)
    write_feed(rows.coalesce(_large_files(spark, folder)), path)
    return read_feed(spark, path, split=True)


def ordered_export(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of one ordered CSV, numbered in the order of its parts."""
    path = new_path(spark, "export-parts")
    write_ordered(enriched(spark, folder), path)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), "value"
    )
    numbered = op.with_position(lines, ("file", "at"))
    return numbered.select("position", F.col("value").alias("line"))


def _two_files(spark: SparkSession, folder: str) -> str:
    """The feed as two deliveries with headers of their own, in one folder."""
    odd = F.substring("product_id", -1, 1).isin("1", "3", "5", "7", "9")
    rows, place = feed(spark, folder), new_path(spark, "files-in")
    turned = rows.where(~odd).select(*reversed(rows.columns)).withColumnRenamed("product_id", " Product ID")
    write_feed(rows.where(odd), f"{place}/odd")
    write_feed(turned, f"{place}/even")
    return f"{place}/*"


def _drained(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Files with different headers, scored as they arrive."""
    out, log = (new_path(spark, name) for name in ("files-out", "files-log"))
    _drained(score_files(stream_files(spark, _two_files(spark, folder)), out, log))
    return spark.read.parquet(out).select(*SCORED, "pre_issues")


def stream_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of batches whose numbers go on: two deliveries, one after the other."""
    rows, place = feed(spark, folder), new_path(spark, "batches-in")
    out, log = (new_path(spark, name) for name in ("batches-out", "batches-log"))
    odd = F.substring("product_id", -1, 1).isin("1", "3", "5", "7", "9")
    for name, part in (("odd", odd), ("even", ~odd)):
        write_feed(rows.where(part), f"{place}/{name}")
        _drained(batch_files(stream_files(spark, f"{place}/*"), out, log))
    return spark.read.parquet(out).select("product_id", "batch_id", "item_no")


def stream_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A feed delivered twice, with other prices for some products the second time."""
    rows, place = feed(spark, folder), new_path(spark, "changes-in")
    out, log = (new_path(spark, name) for name in ("changes-out", "changes-log"))
    dearer = F.when(F.substring("product_id", -1, 1) == "7", F.lit("999.5")).otherwise(F.col("price"))
    for name, part in (("first", rows), ("second", rows.withColumn("price", dearer))):
        write_feed(part, f"{place}/{name}")
        _drained(write_changes(stream_feed(spark, f"{place}/*"), out, log))
    return spark.read.parquet(out).select("product_id", "price", "pre_score")


def stream_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Figures kept while enriched products arrive in two deliveries."""
    place, out, log = (new_path(spark, name) for name in ("figures-in", "figures-out", "figures-log"))
    rows = enriched(spark, folder)
    odd = F.substring("product_id", -1, 1).isin("1", "3", "5", "7", "9")
    for name, part in (("odd", odd), ("even", ~odd)):
        rows.where(part).write.parquet(f"{place}/{name}")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{place}/*")
        _drained(write_figures(arriving, out, log))
    return bundle(figures_of(spark, out))


def rounded_tenths(spark: SparkSession, folder: str) -> DataFrame:
    """Rounding of values at and near ties."""
    value = F.col("l_extendedprice").cast("double") / 20
    items = spark.read.parquet(f"{folder.rstrip('/')}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", round_tenth(value).alias("rounded"))


def repeated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return (
        fixtures.on_spark(spark, folder, fixtures.REPEATED_FEED),
        fixtures.on_spark(spark, folder, fixtures.REPEATED_RESULTS),
    )


def merged_repeats(spark: SparkSession, folder: str, *first_by: str) -> DataFrame:
    products, results = repeated(spark, folder)
    merged = op.merge_results(products, results, first_by=first_by)
    return merged.select("product_id", "title", "copy", *MODEL_COLUMNS)


def lookup_first(spark: SparkSession, folder: str) -> DataFrame:
    products, results = repeated(spark, folder)
    return op.find_products(products, results, "copy")


def _long(part: str, df: DataFrame, name: str, number: str) -> DataFrame:
    return df.select(
        F.lit(part).alias("part"), F.col(name).alias("name"), F.col(number).cast("double").alias("number")
    )


def bundle(summary: op.Summary) -> DataFrame:
    """The four parts of a summary in one long form."""
    scalars = summary.scalars.unpivot([], summary.scalars.columns, "name", "number")
    return (
        _long("scalar", scalars, "name", "number")
        .unionByName(_long("grade", summary.grades, "grade", "n_products"))
        .unionByName(_long("worst", summary.worst, "product_id", "quality_score"))
        .unionByName(_long("attribute", summary.attributes, "attribute", "n_products"))
    )


def summary_of_export(spark: SparkSession, folder: str) -> DataFrame:
    """The figures and badges of an enriched feed that was written as CSV and read back as text."""
    path = new_path(spark, "export")
    write_feed(enriched(spark, folder), path)
    back = read_feed(spark, path)
    bands = op.product_badges(back).groupBy("score_class").agg(F.count("*").alias("n"))
    return bundle(op.summarise(back)).unionByName(_long("band", bands, "score_class", "n"))


QUERIES = {
    "clean_feed": cleaned,
    "csv_round_trip": csv_round_trip,
    "pre_score": lambda s, d: scored(s, d).select(*SCORED),
    "pre_score_issues": lambda s, d: scored(s, d).select(
        "product_id", "pre_issues", "pre_missing_attributes"
    ),
    "pre_grade_profile": lambda s, d: op.pre_grade_profile(scored(s, d)),
    "flaw_profile": lambda s, d: op.flaw_profile(feed(s, d)),
    "preview": lambda s, d: op.preview(scored(s, d)),
    "merge_results": enriched,
    "results_view": lambda s, d: op.results_view(enriched(s, d)),
    "enriched_export": lambda s, d: export_columns(enriched(s, d)),
    "merge_fan_out": merged_repeats,
    "merge_first": lambda s, d: merged_repeats(s, d, "seq"),
    "lookup_first": lookup_first,
    "first_products": lambda s, d: op.first_products(feed(s, d), 20).select("product_id", "title", "price"),
    "summary_bundle": lambda s, d: bundle(op.summarise(enriched(s, d))),
    "summary_of_export": summary_of_export,
    "csv_two_headers": csv_two_headers,
    "summary_scalars": lambda s, d: op.summary_scalars(enriched(s, d)),
    "grade_distribution": lambda s, d: op.grade_distribution(enriched(s, d)),
    "worst_products": lambda s, d: op.worst_products(enriched(s, d)),
    "missing_attribute_frequency": lambda s, d: op.missing_attribute_frequency(enriched(s, d)),
    "title_compare": lambda s, d: op.title_comparison(enriched(s, d)),
    "before_after": lambda s, d: op.before_after(enriched(s, d)),
    "product_lookup": lambda s, d: op.find_products(
        feed(s, d), model_results(s, d), "title"
    ),
    "missing_badges": lambda s, d: op.missing_badges(feed(s, d)),
    "bands": lambda s, d: op.product_badges(enriched(s, d)).withColumn(
        "issue_list", F.array_join("issue_list", "|")
    ),
    "batches": lambda s, d: op.with_batch_id(keys(s, d)).select(*BATCHED),
    "batches_by_category": lambda s, d: op.with_batch_id(
        keys(s, d), order=op.by_category()
    ).select(*BATCHED),
    "batch_sizes": lambda s, d: op.batch_sizes(op.with_batch_id(keys(s, d))),
    "batch_requests": lambda s, d: op.batch_requests(op.with_batch_id(feed(s, d))),
    "parsed_responses": parsed_responses,
    "validated_batches": validated_batches,
    "resolved_results": resolved_results,
    "enrich_feed": enrich_feed,
    "stream_scored": stream_scored,
    "stream_enriched": stream_enriched,
    "run_figures": run_figures,
    "csv_split": csv_split,
    "ordered_export": ordered_export,
    "stream_headers": stream_headers,
    "stream_batches": stream_batches,
    "stream_changes": stream_changes,
    "rounded_tenths": rounded_tenths,
    "stream_figures": stream_figures,
}
