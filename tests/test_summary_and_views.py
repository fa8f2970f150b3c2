import pytest
from feed_rows import LONG
from pyspark.sql import functions as F

from shelfgauge.functions import strip
from shelfgauge.operators import (
    before_after,
    find_products,
    first_products,
    grade_distribution,
    merge_results,
    missing_attribute_frequency,
    missing_badges,
    preview,
    product_badges,
    results_view,
    summarise,
    summary_scalars,
    title_comparison,
    with_pre_score,
    worst_products,
    zero_filled_counts,
)
from shelfgauge.schema import REQUIRED_COLUMNS


#: id, score, grade, issues, missing attributes, suggested title
CATALOGUE = [
    ("K01", "95.5", "A", "", "", "Fresh name"),
    ("K02", "12", "F", "no photo; size: S; M; L", "material; season", ""),
    ("K03", "59.9", "D", "text too thin", "season", "Third name"),
    ("K04", "60", "C", "None", "None", ""),
    ("K05", "88.25", "B", " ; odd start", "", "Fifth name"),
    ("K06", "40", "F", "faded", "Season ; season", "Sixth name"),
    ("K07", "40", "F", "creased", "", ""),
    ("K08", "33.3", "F", "", "price", "Eighth name"),
    ("K09", "20", "F", "torn", "season", ""),
    ("K10", "40", "F", "faded", "", ""),
    ("K11", "unrated", "X", "unread", "", ""),
]


@pytest.fixture
def enriched(spark, feed_of):
    """Products with unequal grades, a tie at the fifth place, and one without a result."""
    results = spark.createDataFrame(
        CATALOGUE,
        "product_id string, quality_score string, grade string, issues string,"
        "missing_attributes string, suggested_title string",
    )
    return merge_results(feed_of(*[{"product_id": f"K{n:02}"} for n in range(1, 13)]), results)


def test_figures(enriched):
    figures = summarise(enriched)
    assert figures.scalars.first().asDict() == {
        "total_products": 12,
        "average_quality_score": 40.6,
        "products_needing_review": 9,
        "n_columns": 20,
        "points_from_perfect": 59.4,
        "hours_saved": 2.2,
    }
    grades = {r.grade: r.n_products for r in figures.grades.collect()}
    assert grades == {"A": 1, "B": 1, "C": 1, "D": 1, "F": 7}
    worst = [(r.product_id, r.quality_score, r.top_issue) for r in figures.worst.collect()]
    assert worst == [
        ("K11", 0, "unread"),
        ("K12", 0, "Analysis failed"),
        ("K02", 12, "no photo"),
        ("K09", 20, "torn"),
        ("K08", 33, "N/A"),
    ]
    assert [r.product_id for r in worst_products(enriched, 7).collect()][-2:] == ["K06", "K07"]
    assert [tuple(r) for r in figures.attributes.collect()] == [
        ("season", 4), ("Season", 1), ("material", 1), ("price", 1),
    ]


def test_scores_that_are_texts(spark):
    rows = [("a", "100"), ("b", "30"), ("c", "9"), ("d", "85.7"), ("e", "n/a"), ("f", "38d"), ("g", None)]
    frame = spark.createDataFrame(rows, "product_id string, quality_score string").selectExpr(
        "*", "'t' title", "'A' grade", "'' issues", "'' missing_attributes", "'high' improvement_priority"
    )
    assert summary_scalars(frame.where("product_id = 'd'")).first().average_quality_score == 85.7
    worst = worst_products(frame, 5).collect()
    assert [(r.product_id, r.quality_score) for r in worst] == [("e", 0), ("f", 0), ("g", 0), ("c", 9), ("b", 30)]
    bands = {r.product_id: r.score_class for r in product_badges(frame).collect()}
    assert bands == {"a": "high", "d": "high", "b": "low", "c": "low", "e": "low", "f": "low", "g": "low"}


def test_a_summary_evaluates_its_input_once(spark, enriched):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    figures = summarise(enriched.mapInArrow(count, enriched.schema))
    for part in (figures.scalars, figures.grades, figures.worst, figures.attributes):
        assert part.count() > 0
    assert seen.value == 12


def test_empty_feed(enriched):
    nothing = enriched.where("false")
    row = summary_scalars(nothing).first()
    assert (row.total_products, row.average_quality_score, row.products_needing_review) == (0, None, 0)
    assert [r.n_products for r in grade_distribution(nothing).collect()] == [0] * 5
    assert worst_products(nothing).count() == 0


def test_unknown_grades_are_left_out(spark):
    frame = spark.createDataFrame([("A",), ("X",), (None,), ("a",)], "grade string")
    counts = {r.grade: r.n_products for r in grade_distribution(frame).collect()}
    assert counts == {"A": 1, "B": 0, "C": 0, "D": 0, "F": 0}
    odd = zero_filled_counts(frame, "grade", ["X", "none"], "n")
    assert sorted(map(tuple, odd.collect())) == [("X", 1), ("none", 0)]


def test_attribute_texts(spark):
    texts = ["material; colour", "None", " none ;material", "", ";;", None, "NONE;price "]
    frame = spark.createDataFrame([(t,) for t in texts], "missing_attributes string")
    got = [tuple(r) for r in missing_attribute_frequency(frame).collect()]
    assert got == [("material", 2), ("colour", 1), ("price", 1)]


def test_worst_is_a_top_k_not_a_sort(enriched):
    plan = worst_products(enriched)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_scalars_take_one_pass(enriched, tmp_path, spark):
    enriched.write.parquet(str(tmp_path / "e"))
    plan = summary_scalars(spark.read.parquet(str(tmp_path / "e")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1
    assert "quality_score" in text.split("ReadSchema: ")[1].split("\n")[0]
    assert "title" not in text.split("ReadSchema: ")[1].split("\n")[0]


def test_preview_tolerates_absent_columns(feed_of):
    scored = with_pre_score(feed_of({}))
    assert preview(scored).columns == [
        "product_id",
        "title",
        "quality_score",
        "pre_grade",
        "pre_issues",
    ]
    assert preview(scored.drop("title")).columns[1] == "quality_score"


def test_result_columns(enriched):
    assert results_view(enriched).columns == [
        "product_id",
        "title",
        "quality_score",
        "grade",
        "issues",
        "improvement_priority",
        "suggested_title",
        "suggested_keywords",
    ]
    assert "issues" not in results_view(enriched.drop("issues")).columns


def test_title_comparison_skips_blank_suggestions(enriched):
    rows = title_comparison(
        enriched.withColumn(
            "suggested_title",
            F.when(F.col("product_id") == "K01", "　 ").otherwise(F.col("suggested_title")),
        )
    )
    assert rows.columns == ["product_id", "original_title", "ai_suggested_title", "quality_score"]
    assert sorted(r.product_id for r in rows.collect()) == ["K03", "K05", "K06", "K08"]


def test_first_products_is_a_top_k(enriched):
    first = first_products(enriched, 3, [F.desc("product_id")])
    assert [r.product_id for r in first.collect()] == ["K12", "K11", "K10"]
    assert "TakeOrdered" in first._jdf.queryExecution().executedPlan().toString()


def test_find_products(spark, feed_of):
    feed = feed_of(
        {"product_id": "1", "title": "b"},
        {"product_id": "1", "title": "a"},
        {"product_id": "2", "title": "c"},
        {"product_id": None},
    )
    assert [(r.product_id, r.title) for r in find_products(feed, ["1", 9], "title").collect()] == [
        ("1", "a")
    ]
    ids = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "product_id string")
    found = find_products(feed, ids, "title")
    assert found.columns == feed.columns
    assert sorted((r.product_id, r.title) for r in found.collect()) == [("1", "a"), ("2", "c")]


def test_badges(feed_of):
    feed = feed_of({"price": "0.0", "season": "nan", "keywords": None, "gender": " "}, {"price": "0.00"})
    rows = missing_badges(feed).orderBy("n_missing").collect()
    assert (rows[0].missing_fields, rows[0].n_missing) == ("", 0)
    assert (rows[1].missing_fields, rows[1].n_missing) == ("price, gender, season, keywords", 4)


def test_before_and_after(enriched):
    rows = before_after(enriched.where("product_id = 'K02'").withColumn("price", F.lit("0")))
    rows = rows.orderBy("field_no").collect()
    assert [r.field for r in rows[:12]] == list(REQUIRED_COLUMNS)
    assert {r.side for r in rows[:12]} == {"before"} and {r.side for r in rows[12:]} == {"after"}
    values = {r.field: (r.value, r.missing) for r in rows}
    assert values["description"] == (LONG, False)
    assert values["price"] == ("0", True)
    assert values["suggested_title"] == ("—", False)
    assert len(rows) == 16


def test_product_badges(enriched):
    row = product_badges(enriched).where("product_id = 'K03'").first()
    assert (row.score_band, row.score_class, row.priority_class) == ("mid", "low-m", "high")
    assert row.issue_list == ["text too thin"]


def test_strip_of_blank_column(enriched):
    assert enriched.select(strip("suggested_keywords").alias("k")).distinct().collect()[0].k == ""
