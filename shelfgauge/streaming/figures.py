"""Dashboard figures that are kept while enriched products arrive.

Every figure is made of sums and of the least few rows, so those of a micro-batch and
those kept so far give the new ones, whatever has arrived before. They are written under
the number of the micro-batch; one that is repeated starts from the figures before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from shelfgauge.functions import number_or_zero, round_tenth
from shelfgauge.operators.summary import (
    WORST_COLUMNS, Summary, missing_attribute_frequency, needs_review, worst_products,
)
from shelfgauge.operators import summary
from shelfgauge.schema import GRADES
from shelfgauge.sources.shared_tables import drop_folder, is_written, scratch, store

_TABLES = ("worst", "attributes", "totals")  # written in this order


def _totals(needed: DataFrame, n_columns: int) -> DataFrame:
    score = number_or_zero("quality_score")
    return needed.agg(
        F.count("*").alias("total_products"),
        F.coalesce(F.sum(score), F.lit(0.0)).alias("score_sum"),
        F.count_if(needs_review(score)).alias("products_needing_review"),
        F.lit(n_columns).alias("n_columns"),
        *summary._counters("grade", GRADES),
    )


def _added(name: str, both: DataFrame, worst: int) -> DataFrame:
    """Figures so far and new ones, put together."""
    if name == "worst":
        return both.orderBy("quality_score", "product_id").limit(worst)
    if name == "attributes":
        return both.groupBy("attribute").agg(F.sum("n_products").alias("n_products"))
    kept = [F.max(c).alias(c) if c == "n_columns" else F.sum(c).alias(c) for c in both.columns]
    return both.agg(*kept)


def _epochs(spark: SparkSession, out: str, before: int) -> int | None:
    """The last micro-batch before one whose figures are complete."""
    for epoch in range(before - 1, -1, -1):
        if is_written(spark, f"{out}/epoch={epoch}/totals"):
            return epoch
    return None


def write_figures(enriched: DataFrame, out: str, checkpoint: str, *, worst: int = 5) -> DataStreamWriter:
    """Writer that keeps the figures of all enriched products so far; see :func:`figures_of`.

    Each checkpoint needs an ``out`` of its own.
    """

    def run(frame: DataFrame, epoch: int) -> None:
        spark = frame.sparkSession
        names = dict.fromkeys((*WORST_COLUMNS, "missing_attributes"))
        with scratch(spark) as folder:
            needed = store(frame.select(*names), "arrived", folder)
            new = {
                "worst": worst_products(needed, worst),
                "attributes": missing_attribute_frequency(needed),
                "totals": _totals(needed, len(frame.columns)),
            }
            last = _epochs(spark, out, epoch)
            for name in _TABLES:
                both = new[name]
                if last is not None:
                    both = both.unionByName(spark.read.parquet(f"{out}/epoch={last}/{name}"))
                _added(name, both, worst).write.mode("overwrite").parquet(f"{out}/epoch={epoch}/{name}")
        spark.createDataFrame([(epoch,)], "epoch long").write.mode("overwrite").parquet(f"{out}/latest={epoch}")
        if last is not None and (older := _epochs(spark, out, last)) is not None:
            drop_folder(spark, f"{out}/epoch={older}")
            drop_folder(spark, f"{out}/latest={older}")

    return enriched.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def figures_of(spark: SparkSession, out: str) -> Summary:
    """The figures after the last micro-batch, as :func:`summarise` gives them."""
    latest = spark.read.schema("epoch long").parquet(f"{out}/latest=*").agg(F.max("epoch")).first()[0]
    read = {name: spark.read.parquet(f"{out}/epoch={latest}/{name}") for name in _TABLES}
    totals = read["totals"].withColumn(
        "average_quality_score",
        F.when(F.col("total_products") > 0, round_tenth(F.try_divide("score_sum", "total_products"))),
    )
    columns = "total_products", "average_quality_score", "products_needing_review", "n_columns"
    return Summary(
        summary._derived(totals.select(*columns)),
        summary._as_rows(totals, "grade", GRADES, "n_products"),
        read["worst"].orderBy("quality_score", "product_id"),
        read["attributes"].orderBy(F.desc("n_products"), "attribute"),
    )
