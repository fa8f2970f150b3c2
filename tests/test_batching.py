import collections

import pytest
from pyspark.sql import functions as F

from shelfgauge.operators import batch_sizes, by_category, with_batch_id, with_position


def numbered(spark, ids, partitions=5, column="product_id"):
    return spark.createDataFrame([(v,) for v in ids], f"{column} string").repartition(partitions)


def test_sixty_products_make_eight_batches(spark):
    batched = with_batch_id(numbered(spark, [f"{n:03}" for n in range(60)]))
    sizes = {row.batch_id: row.n for row in batch_sizes(batched).collect()}
    assert sizes == {**dict.fromkeys(range(7), 8), 7: 4}


@pytest.mark.parametrize("size", [1, 4, 12, 1000])
def test_batches_follow_the_order(spark, size):
    ids = [f"{n * 7919 % 1009:04}" for n in range(1000)]
    rows = with_batch_id(numbered(spark, ids), size).collect()
    assert len(rows) == 1000
    for position, row in enumerate(sorted(rows, key=lambda r: r.product_id)):
        assert (row.position, row.batch_id, row.item_no) == (
            position,
            position // size,
            position % size,
        )


def test_order_by_category_puts_nulls_last(spark):
    rows = [(f"{n:03}", [None, "b", "a"][n % 3]) for n in range(90)]
    feed = spark.createDataFrame(rows, "product_id string, category string").repartition(4)
    got = with_batch_id(feed, 8, by_category()).orderBy("position").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    assert [(r.product_id, r.category) for r in got] == want


def test_sort_expressions_and_null_keys(spark):
    feed = numbered(spark, ["10", "9", None, "100", None])
    got = with_position(feed, [F.col("product_id").cast("int").desc_nulls_last()])
    assert [r.product_id for r in got.orderBy("position").collect()] == ["100", "10", "9", None, None]
    assert sorted(r.position for r in got.collect()) == list(range(5))


def test_exact_copies_are_numbered_once_each(spark):
    ids = ["same"] * 3000 + [f"{n:04}" for n in range(1000)]
    got = with_position(numbered(spark, ids, 8)).collect()
    assert sorted(r.position for r in got) == list(range(4000))
    assert collections.Counter(r.product_id for r in got)["same"] == 3000
    ordered = [r.product_id for r in sorted(got, key=lambda r: r.position)]
    assert ordered == sorted(ids)


def test_hot_key_does_not_stay_in_one_partition(spark):
    from shelfgauge.operators.batching import _ID, _ordered

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        feed = numbered(spark, ["same"] * 4000, 8).withColumn(_ID, F.monotonically_increasing_id())
        counts = _ordered(feed, ["product_id"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 4
    assert max(row["count"] for row in counts) < 2500


def test_empty_feed(spark):
    assert with_batch_id(numbered(spark, ["a"]).where("false")).count() == 0


def test_batch_size_is_checked(spark):
    with pytest.raises(ValueError):
        with_batch_id(numbered(spark, ["a"]), 0)


def test_ties_follow_the_files(spark, tmp_path):
    rows = [("same", at) for at in range(500)]
    spark.createDataFrame(rows, "product_id string, at int").coalesce(1).write.parquet(str(tmp_path / "f"))
    got = with_position(spark.read.parquet(str(tmp_path / "f"))).orderBy("position").collect()
    assert [r.at for r in got] == list(range(500))


def test_what_lies_before_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    feed = numbered(spark, [f"{n:04}" for n in range(1000)])
    batched = with_batch_id(feed.mapInArrow(count, feed.schema))
    assert batched.count() == 1000 and batch_sizes(batched).count() == 125
    assert seen.value == 1000


def test_only_keys_are_sorted(spark, tmp_path):
    feed = spark.range(100).selectExpr("cast(id as string) product_id", "repeat('x', 100) text")
    ordered = with_position(feed, folder=str(tmp_path))
    (positions,) = tmp_path.glob("positions-*")
    assert spark.read.parquet(str(positions)).columns == ["__shelfgauge_id", "__shelfgauge_part"]
    assert ordered.columns == ["product_id", "text", "position"]


@pytest.mark.parametrize("name", ["position", "batch_id", "item_no", "__shelfgauge_id"])
def test_reserved_names_are_refused(spark, name):
    with pytest.raises(ValueError, match=name):
        with_batch_id(numbered(spark, ["a"]).withColumn(name, F.lit(1)))


def test_rows_never_gather_in_one_partition(spark):
    """Only the per-partition counts pass through a single task."""
    plan = with_batch_id(numbered(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    single = plan.index("SinglePartition")
    assert plan.count("SinglePartition") == 1
    assert "BroadcastExchange" in plan[:single]
    # below the single partition there is an aggregate, not the feed
    assert plan[single:].index("HashAggregate") < plan[single:].index("Scan")
