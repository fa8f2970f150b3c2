"""Ordered exports and streams of files with headers of their own."""

import pathlib
import sys

import pandas as pd
import pytest
from feed_rows import GOOD
from pyspark import cloudpickle

from shelfgauge.operators import with_pre_score
from shelfgauge.schema import FEED_SCHEMA, REQUIRED_COLUMNS
from shelfgauge.sources import read_feed, write_file, write_ordered
from shelfgauge.operators import summarise
from shelfgauge.streaming import (
    batch_files, feed_of_files, figures_of, score_files, stream_feed, stream_files, write_changes, write_figures,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def products(n, first=0, **change):
    return [{**GOOD, "product_id": f"P{first + i:04}", **change} for i in range(n)]


def put(folder, name, rows, rename=None, columns=None):
    folder.mkdir(exist_ok=True)
    frame = pd.DataFrame(rows)[columns or list(REQUIRED_COLUMNS)]
    frame.rename(columns=rename or {}).to_csv(folder / name, index=False)


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture
def messy(spark):
    cells = ["plain", 'a "q", b', "two\nlines", "cr\rhere", " blanks ", None, "é日", "x;y"]
    rows = [{**GOOD, "product_id": f"P{i:03}", "title": cells[i % 8], "keywords": cells[(i // 8) % 8]} for i in range(60)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows[::-1]], FEED_SCHEMA)
    return df.repartition(7), pd.DataFrame(rows).to_csv(index=False)


def test_parts_put_together_are_the_file_pandas_writes(spark, messy, tmp_path):
    df, want = messy
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_ordered(df, f"{tmp_path}/parts")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(pathlib.Path(f"{tmp_path}/parts").glob("part-*"))
    assert "".join(p.read_bytes().decode() for p in parts) == want
    assert len(parts) > 1


def test_one_file_equals_pandas_and_is_not_replaced(messy, tmp_path):
    df, want = messy
    write_file(df, f"{tmp_path}/feed.csv")
    assert (tmp_path / "feed.csv").read_bytes().decode() == want
    with pytest.raises(FileExistsError):
        write_file(df, f"{tmp_path}/feed.csv")
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["feed.csv"]


def test_a_failed_write_leaves_nothing(spark, messy, tmp_path):
    from pyspark.sql import functions as F

    bad = messy[0].withColumn("price", F.when(F.col("product_id") == "P031", F.raise_error(F.lit("no"))).otherwise("1"))
    with pytest.raises(Exception, match="no"):
        write_file(bad, f"{tmp_path}/feed.csv")
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(Exception, match="no"):
        write_ordered(bad, f"{tmp_path}/parts")
    assert not list(tmp_path.glob("parts/part-*"))


def test_empty_and_tied_exports(spark, tmp_path):
    empty = spark.createDataFrame([], FEED_SCHEMA)
    write_file(empty, f"{tmp_path}/none.csv")
    assert (tmp_path / "none.csv").read_text() == ",".join(REQUIRED_COLUMNS) + "\n"
    rows = [{**GOOD, "product_id": key, "title": title} for key, title in [(None, "z"), ("B", "y"), ("B", "x"), ("A", None)]]
    write_file(spark.createDataFrame([tuple(r.values()) for r in rows], FEED_SCHEMA), f"{tmp_path}/ties.csv")
    assert [line.split(",")[:2] for line in (tmp_path / "ties.csv").read_text().splitlines()[1:]] == [
        ["A", ""], ["B", "x"], ["B", "y"], ["", "z"],
    ]


def test_files_with_any_header_stream_once(spark, tmp_path):
    source, out, log = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/log"
    put(source, "a.csv", products(5))
    put(source, "b.csv", products(4, 10, title="NA"), {"product_id": " Product ID", "size_range": "Size Range"}, list(REQUIRED_COLUMNS)[::-1])
    drain(score_files(stream_files(spark, str(source)), out, log))
    put(source, "c.csv", [{**p, "Extra": "x"} for p in products(3, 20, description="a\nb, c")], columns=["Extra", *REQUIRED_COLUMNS])
    drain(score_files(stream_files(spark, str(source)), out, log))
    drain(score_files(stream_files(spark, str(source)), out, log))
    found = spark.read.parquet(out).drop("run", "epoch")
    files = [str(source / f"{name}.csv") for name in "abc"]
    want = [r for f in files for r in with_pre_score(read_feed(spark, f).select(*REQUIRED_COLUMNS)).collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert len(want) == 12


def test_no_files_are_an_empty_feed(spark):
    assert feed_of_files(spark, []).count() == 0


def test_batch_numbers_go_on_and_hold_when_repeated(spark, tmp_path):
    source, out, log = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/log"
    for name, n, first in (("a.csv", 5, 0), ("b.csv", 7, 100)):
        put(source, name, products(n, first))
        drain(batch_files(stream_files(spark, str(source)), out, log, batch_size=4))
    read = lambda: sorted((r.product_id, r.batch_id, r.item_no) for r in spark.read.parquet(out).collect())
    found = read()
    assert [b for _, b, _ in found] == [0] * 4 + [1] + [2] * 4 + [3] * 3
    # the last micro-batch as if it had failed before its end was noted
    (tmp_path / "log" / "commits" / "1").unlink()
    (tmp_path / "log" / "commits" / ".1.crc").unlink(missing_ok=True)
    drain(batch_files(stream_files(spark, str(source)), out, log, batch_size=4))
    assert read() == found


def test_only_changed_products_pass_again(spark, tmp_path):
    source, out, log = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/log"
    deliver = lambda name, rows: (put(source, name, rows), drain(write_changes(stream_feed(spark, str(source)), out, log)))
    deliver("a.csv", products(6))
    deliver("b.csv", products(6)[::-1])
    assert spark.read.parquet(out).count() == 6
    changed = products(6)
    changed[3]["price"] = "30.00"
    deliver("c.csv", changed)
    deliver("d.csv", changed + changed)
    found = sorted((r.product_id, r.price) for r in spark.read.parquet(out).collect())
    assert len(found) == 7 and [f for f in found if f[0] == "P0003"] == [("P0003", "25.00"), ("P0003", "30.00")]


def test_changes_are_found_in_groups_of_ids(spark, tmp_path):
    source, out, log = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/log"
    states = []

    def deliver(name, rows):
        put(source, name, rows)
        writer = write_changes(stream_feed(spark, str(source)), out, log, groups=16)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        states.extend(state.numRowsTotal for p in query.recentProgress for state in p.stateOperators)

    nameless = [{**GOOD, "product_id": None, "title": title} for title in ("x", "x", "y")]
    changed = products(300)
    for at in (5, 299):
        changed[at]["price"] = "30.00"
    deliver("a.csv", products(300) + nameless)
    deliver("b.csv", changed + products(10, 500) + nameless)
    deliver("c.csv", products(300))
    found = sorted((r.product_id or "", r.price) for r in spark.read.parquet(out).collect())
    once = [(f"P{i:04}", "25.00") for i in [*range(300), *range(500, 510)]]
    again = [(f"P{i:04}", price) for i in (5, 299) for price in ("25.00", "30.00")]
    assert found == sorted([("", "25.00")] * 6 + once + again)
    assert max(states) == 16


def test_figures_after_each_delivery_equal_those_of_all_so_far(spark, tmp_path):
    source, out, log = (f"{tmp_path}/{name}" for name in ("in", "out", "log"))
    schema = "product_id string, title string, quality_score string, grade string, issues string, missing_attributes string"
    parts = lambda s: [sorted(map(str, df.collect())) for df in (s.scalars, s.grades, s.worst, s.attributes)]
    for at, n in enumerate((7, 1, 9, 4)):
        rows = [
            (f"{at}-{i}", "t", str((37 * (i + at)) % 101 + 0.35), "ABCDF"[(i + at) % 5], "x; y" if i % 2 else "", "colour; price" if i % 3 else None)
            for i in range(n)
        ]
        spark.createDataFrame(rows, schema).write.parquet(f"{source}/{at}")
        arriving = spark.readStream.schema(schema).parquet(f"{source}/*")
        drain(write_figures(arriving, out, log))
        assert parts(figures_of(spark, out)) == parts(summarise(spark.read.parquet(f"{source}/*")))
    (tmp_path / "log" / "commits" / "3").unlink()
    (tmp_path / "log" / "commits" / ".3.crc").unlink(missing_ok=True)
    drain(write_figures(spark.readStream.schema(schema).parquet(f"{source}/*"), out, log))
    assert parts(figures_of(spark, out)) == parts(summarise(spark.read.parquet(f"{source}/*")))
