import io
import random

import pandas as pd
import pytest
from feed_rows import GOOD

from shelfgauge.schema import REQUIRED_COLUMNS
from shelfgauge.sources import read_feed, write_feed
from shelfgauge.sources.split_csv import records


@pytest.fixture
def blocks_of(spark):
    """Have Spark split files into blocks of so many bytes."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(name) for name in names]

    def use(size):
        for name in names:
            spark.conf.set(name, str(size))

    yield use
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def cell(draw):
    some = ['"', '""', ",", "\n", "\r\n", "\r", "a", "é日", " ", "5\" pipe", "x" * 30, ""]
    return "".join(draw.choice(some) for _ in range(draw.randint(0, 5)))


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


@pytest.mark.parametrize("size, end", [(67, "\n"), (101, "\r\n"), (1 << 20, "\n")])
def test_records_equal_one_reader_whatever_the_blocks(spark, tmp_path, blocks_of, size, end):
    draw = random.Random(size)
    rows = [[cell(draw) for _ in range(3)] for _ in range(50)]
    raw = "﻿a,b,c" + end + "".join(",".join(map(quoted, row)) + end for row in rows)
    (tmp_path / "feed.csv").write_bytes(raw.encode())
    blocks_of(size)
    found = records(spark, f"{tmp_path}/feed.csv")
    want = [",".join(map(quoted, row)) for row in rows]
    assert sorted(r.record for r in found.where("not head").collect()) == sorted(want)
    assert [r.record for r in found.where("head").collect()] == ["a,b,c"]


def test_bare_quotes_blank_lines_and_no_last_line_break(spark, tmp_path, blocks_of):
    (tmp_path / "feed.csv").write_bytes(b'\na,b\n\n5" pipe,3"\n  \n"x\n\ny",z\n"",""\nlast,"one"')
    for size in (7, 100):
        blocks_of(size)
        found = [r.record for r in records(spark, f"{tmp_path}/feed.csv").where("not head").collect()]
        assert sorted(found) == sorted(['5" pipe,3"', '"x\n\ny",z', '"",""', 'last,"one"'])


def test_a_cell_of_many_blocks_and_several_files(spark, tmp_path, blocks_of):
    blocks_of(200)
    long = "line\n" * 500
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f'h,i\n1,"{long}"\n2,{name}\n', newline="")
    found = sorted(r.record for r in records(spark, str(tmp_path)).where("not head").collect())
    assert found == sorted([f'1,"{long}"'] * 2 + ["2,a", "2,b"])


@pytest.mark.parametrize("size", [900, 1 << 20])
def test_feed_equals_pandas_and_is_read_by_many_tasks(spark, tmp_path, blocks_of, size):
    draw = random.Random(size)
    rows = [{**GOOD, "product_id": f"P{i}", "description": f"first\r\nsecond \"{i}\"\nthird", "title": cell(draw)} for i in range(80)]
    frame = pd.DataFrame(rows)
    text = frame.to_csv(index=False).replace("product_id", " Product ID")
    (tmp_path / "feed.csv").write_bytes(text.encode())
    blocks_of(size)
    back = pd.read_csv(io.StringIO(text, newline=""), dtype=str)
    want = {r[0]: tuple(None if pd.isna(c) or not c.strip() else c.strip() for c in r) for r in back.itertuples(index=False)}
    df = read_feed(spark, f"{tmp_path}/feed.csv", split=True)
    assert df.columns == list(REQUIRED_COLUMNS)
    found = {r.product_id: tuple(c or None for c in r) for r in df.collect()}
    assert found == want
    lines = spark.read.text(f"{tmp_path}/feed.csv").rdd.getNumPartitions()
    assert lines > 10 if size == 900 else lines <= 4


def test_refusals(spark, tmp_path):
    header = ",".join(REQUIRED_COLUMNS)
    (tmp_path / "a.csv").write_text(f"{header}\n" + "x," * 12 + "y\n")
    with pytest.raises(Exception, match="More cells than the header"):
        read_feed(spark, f"{tmp_path}/a.csv", split=True).collect()
    (tmp_path / "b.csv").write_text(f"other,{header}\n")
    with pytest.raises(ValueError, match="different headers"):
        read_feed(spark, str(tmp_path), split=True)
    (tmp_path / "c.csv").write_text("")
    with pytest.raises(ValueError, match="No header"):
        read_feed(spark, f"{tmp_path}/c.csv", split=True)
    (tmp_path / "d.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        read_feed(spark, f"{tmp_path}/d.csv", split=True)


def test_written_feeds_come_back(spark, tmp_path, feed_of, blocks_of):
    feed = feed_of({"title": 'a "b", c'}, {"description": "x\ny"}, {"price": None})
    write_feed(feed, f"{tmp_path}/out")
    blocks_of(50)
    back = read_feed(spark, f"{tmp_path}/out", split=True)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, feed.collect()), key=repr)


def test_the_large_files_grow_in_number_with_the_feed(spark, tmp_path, monkeypatch):
    from shelfgauge.plans import queries

    documents = [(i, f"text {i}", "en", "web") for i in range(40)]
    stored = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").repartition(8)
    stored.write.parquet(f"{tmp_path}/documents.parquet")
    part = [(i, "name", "type", "brand", 1.5) for i in range(40)]
    columns = "p_partkey long, p_name string, p_type string, p_brand string, p_retailprice double"
    spark.createDataFrame(part, columns).write.parquet(f"{tmp_path}/part.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("part-*"))
    for files in (1, 4):
        written = tmp_path / f"written-{files}"
        monkeypatch.setattr(queries, "new_path", lambda spark, name: str(written))
        monkeypatch.setattr(queries, "FILE_BYTES", size // files + 1, raising=False)
        found = queries.csv_split(spark, str(tmp_path)).collect()
        assert len(list(written.glob("part-*.csv"))) == files
        assert sorted(r.product_id for r in found) == sorted(f"P{i}" for i in range(40))
        told = {r.product_id: r.description for r in found}
        assert told["P1"] == "text 1\r\n\"so\",\nMen's name" and told["P0"] is None
