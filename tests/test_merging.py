import pytest
from feed_rows import GOOD
from pyspark.sql import functions as F

from shelfgauge.operators import first_results, merge_results
from shelfgauge.schema import MODEL_COLUMNS, MODEL_DEFAULTS, RESULT_SCHEMA

DEFAULTS = tuple(MODEL_DEFAULTS[name] for name in MODEL_COLUMNS)


def results_of(spark, *rows):
    base = dict.fromkeys(RESULT_SCHEMA.names)
    return spark.createDataFrame([tuple({**base, **row}.values()) for row in rows], RESULT_SCHEMA)


def model_part(merged):
    rows = merged.select("product_id", *MODEL_COLUMNS).collect()
    return sorted((tuple(row) for row in rows), key=str)


def full(product_id, **changes):
    values = {
        "product_id": product_id,
        "quality_score": "75",
        "grade": "B",
        "issues": ["one", "two; three"],
        "missing_attributes": [],
        "suggested_title": "New",
        "suggested_description": "Better.",
        "suggested_keywords": "a, b, c",
        "improvement_priority": "Low",
    }
    return {**values, **changes}


MERGED = (75, "B", "one; two; three", "New", "Better.", "a, b, c", "", "Low")


def test_match_and_defaults(spark, feed_of):
    feed = feed_of({"product_id": "1"}, {"product_id": "2"})
    merged = merge_results(feed, results_of(spark, full("1"), full("absent from the feed")))
    assert merged.columns == [*GOOD, *MODEL_COLUMNS]
    assert dict(merged.dtypes)["quality_score"] == "bigint"
    assert model_part(merged) == [("1", *MERGED), ("2", *DEFAULTS)]


def test_nulls_of_a_matched_row(spark, feed_of):
    merged = merge_results(feed_of({"product_id": "1"}), results_of(spark, {"product_id": "1"}))
    assert model_part(merged) == [("1", 0, "F", "", "", "", "", "", "High")]


def test_text_lists_and_score_texts(spark, feed_of):
    results = spark.createDataFrame(
        [("1", "x;y", "85.7"), ("2", None, "abc")],
        "product_id string, issues string, quality_score string",
    )
    feed = feed_of({"product_id": "1"}, {"product_id": "2"}, {"product_id": "3"})
    rows = model_part(merge_results(feed, results))
    assert [(r[0], r[1], r[3]) for r in rows] == [
        ("1", 85, "x;y"),
        ("2", 0, ""),
        ("3", 0, "Analysis failed"),
    ]
    # columns the results lack are defaults everywhere
    assert {r[2] for r in rows} == {"F"} and {r[8] for r in rows} == {"High"}


@pytest.mark.parametrize("hot_rows", [1, 2, 3, 1_000_000])
def test_repeated_ids_fan_out_whichever_way_they_are_joined(spark, feed_of, hot_rows):
    feed = feed_of(*[{"product_id": v} for v in ("hot", "hot", "two", "one", "none", None)])
    results = results_of(
        spark,
        *[full("hot", suggested_title=f"h{n}") for n in range(5)],
        *[full("two", suggested_title=f"t{n % 1}") for n in range(2)],
        full("one"),
        *[full("gone")] * 4,
        *[full(None)] * 4,
    )
    rows = model_part(merge_results(feed, results, hot_rows=hot_rows))
    titles = sorted((str(r[0]), r[4]) for r in rows)
    assert titles == sorted(
        [("hot", f"h{n}") for n in range(5)] * 2
        + [("two", "t0")] * 2
        + [("one", "New"), ("none", ""), ("None", "")]
    )


def test_first_result_only(spark, feed_of):
    results = results_of(
        spark, full("1", suggested_title="b"), full("1", suggested_title="a"), full("2")
    ).withColumn("no", F.when(F.col("suggested_title") == "b", 0).otherwise(1))
    assert {r.product_id: r.suggested_title for r in first_results(results, "no").collect()} == {
        "1": "b",
        "2": "New",
    }
    feed = feed_of({"product_id": "1"}, {"product_id": "1"}, {"product_id": "3"})
    merged = merge_results(feed, results, first_by=("no",))
    assert sorted((r.product_id, r.suggested_title) for r in merged.collect()) == [
        ("1", "b"),
        ("1", "b"),
        ("3", ""),
    ]


def test_null_ids_match_nothing(spark, feed_of):
    merged = merge_results(feed_of({"product_id": None}), results_of(spark, full(None)))
    assert model_part(merged) == [(None, *DEFAULTS)]


def test_numeric_ids_match_as_text(spark, feed_of):
    results = spark.createDataFrame([(7, 50)], "product_id int, quality_score int")
    feed = feed_of({}).withColumn("product_id", F.lit(7))
    assert merge_results(feed, results).first().quality_score == 50


def test_no_results_at_all(spark, feed_of):
    merged = merge_results(feed_of({"product_id": "1"}), results_of(spark, full("1")).where("false"))
    assert model_part(merged) == [("1", *DEFAULTS)]


def test_earlier_model_columns_are_kept_aside(spark, feed_of):
    once = merge_results(feed_of({"product_id": "1"}), results_of(spark, full("1")))
    twice = merge_results(once, results_of(spark, full("1", grade="A")))
    row = twice.first()
    assert (row.prev_grade, row.grade, row.prev_quality_score) == ("B", "A", 75)


def test_the_newest_earlier_columns_stay(spark, feed_of):
    merged = feed_of({"product_id": "1"})
    for grade in "ABCD":
        merged = merge_results(merged, results_of(spark, full("1", grade=grade)))
    row = merged.first()
    assert (row.grade, row.prev_grade) == ("D", "C") and merged.columns.count("prev_grade") == 1


def test_more_hot_ids_than_ever_fit_a_list(spark, feed_of):
    ids = [f"h{n}" for n in range(1500)]
    feed = spark.createDataFrame([(i,) for i in ids * 2], "product_id string")
    results = spark.createDataFrame([(i, "1") for i in ids * 3], "product_id string, quality_score string")
    merged = merge_results(feed, results, hot_rows=3)
    assert merged.where("quality_score = 1").count() == 9000 == merged.count()


def test_unique_results_are_joined_once(spark, feed_of):
    results = results_of(spark, full("1"))
    merged = merge_results(feed_of({"product_id": "1"}, {"product_id": "2"}), results, unique=True)
    assert model_part(merged) == [("1", *MERGED), ("2", *DEFAULTS)]
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_results_need_an_id(spark, feed_of):
    with pytest.raises(ValueError, match="product_id"):
        merge_results(feed_of({}), spark.range(1))


def test_hot_branch_disappears_when_there_is_none(spark, feed_of, tmp_path):
    """Without hot ids the executed plan reads the feed once."""
    feed_of(*[{"product_id": str(n)} for n in range(50)]).write.parquet(str(tmp_path / "feed"))
    feed = spark.read.parquet(str(tmp_path / "feed"))
    merged = merge_results(feed, results_of(spark, *[full(str(n)) for n in range(20)]))
    assert len(merged.collect()) == 50
    plan = merged._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def small_partitions(spark):
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield
    for key in SKEW:
        spark.conf.unset(key)


def _rows(spark, n, hot, columns):
    """``n`` rows, a third of them with one id if ``hot``."""
    own = F.concat(F.lit("p"), F.col("id").cast("string"))
    key = F.when(F.col("id") % 3 == 0, "p1").otherwise(own) if hot else own
    filler = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(n).repartition(8).select(
        key.alias("product_id"), *[filler.alias(name) for name in columns]
    )


@pytest.mark.parametrize("side", ["feed", "results"])
def test_a_hot_id_is_split_on_either_side(spark, small_partitions, side):
    feed = _rows(spark, 9000, side == "feed", [c for c in GOOD if c != "product_id"])
    results = _rows(spark, 9000, side == "results", ["suggested_title", "suggested_keywords"])
    merged = merge_results(feed, results, hot_rows=1000)
    rows = merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin(skew=true)" in plan
    # ids with % 3 == 0 exist on one side only, except that all of them are "p1" on the other
    matched = sum(row.suggested_title != "" for row in rows)
    if side == "feed":
        assert (len(rows), matched) == (9000, 9000)
    else:
        assert (len(rows), matched) == (9000 + 3000, 9000)
