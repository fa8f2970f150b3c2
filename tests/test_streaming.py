import json
import pathlib
import sys

import pytest
from feed_rows import GOOD
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException

from shelfgauge.operators import merge_results, with_pre_score
from shelfgauge.schema import FEED_SCHEMA, REQUIRED_COLUMNS, RESULT_KEYS
from shelfgauge.sources import read_feed, shared_folder, write_feed
from shelfgauge.streaming import stream_feed, write_enriched, write_scores

# the executors cannot import the test modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGES = [{}, {"title": "NA"}, {"price": "0"}, {"description": ' two\n"lines" '}, {"colour": "a/b"}]


def write_file(spark, folder, name, first):
    rows = [
        tuple({**GOOD, "product_id": f"{first + at}", **change}.values())
        for at, change in enumerate(CHANGES)
    ]
    write_feed(spark.createDataFrame(rows, FEED_SCHEMA).coalesce(1), f"{folder}/{name}")


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def table(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_stream_equals_batch_and_reads_each_file_once(spark, tmp_path):
    source, out, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    pattern = f"{source}/*"
    write_file(spark, source, "a", 0)
    drain(write_scores(stream_feed(spark, pattern), out, log))
    assert spark.read.parquet(out).count() == 5
    write_file(spark, source, "b", 100)
    write_file(spark, source, "c", 200)
    drain(write_scores(stream_feed(spark, pattern, files_per_trigger=1), out, log))
    drain(write_scores(stream_feed(spark, pattern), out, log))
    assert table(spark.read.parquet(out)) == table(with_pre_score(read_feed(spark, pattern)))


def test_scores_as_csv(spark, tmp_path):
    source, out, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    write_file(spark, source, "a", 0)
    drain(write_scores(stream_feed(spark, f"{source}/*"), out, log, sink_format="csv"))
    back = read_feed(spark, out)
    assert back.columns == [*REQUIRED_COLUMNS, "pre_score", "pre_grade", "pre_issues", "pre_missing_attributes"]
    assert back.count() == 5


def model(request):
    products = json.loads(next(line for line in request.split("\n") if line.startswith("[")))
    base = {**dict.fromkeys(RESULT_KEYS), "issues": [], "missing_attributes": []}
    return json.dumps([{**base, "product_id": p["product_id"], "quality_score": 77} for p in products])


def test_enriched_stream(spark, tmp_path):
    source, out, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    for name, first in (("a", 0), ("b", 100)):
        write_file(spark, source, name, first)
    stream = stream_feed(spark, f"{source}/*", files_per_trigger=1)
    drain(write_enriched(stream, model, out, log, batch_size=4))
    rows = spark.read.parquet(out)
    assert {r.epoch for r in rows.select("epoch").collect()} == {0, 1}
    feed = read_feed(spark, f"{source}/*")
    results = feed.selectExpr(
        "product_id", "'77' as quality_score", "'' as issues", "'' as missing_attributes"
    )
    assert table(rows.drop("epoch", "run")) == table(merge_results(feed, results))
    # nothing is left of the intermediate tables
    assert not list(pathlib.Path(shared_folder(spark)).glob("shelfgauge/stream-*/epoch-*"))


def test_streams_into_one_folder_keep_each_others_results(spark, tmp_path):
    out = str(tmp_path / "out")
    for name, first in (("a", 0), ("b", 100)):
        source, log = str(tmp_path / f"in-{name}"), str(tmp_path / f"log-{name}")
        write_file(spark, source, name, first)
        drain(write_enriched(stream_feed(spark, f"{source}/*"), model, out, log))
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 10 and {r.epoch for r in rows} == {0} and len({r.run for r in rows}) == 2


def test_stream_stops_at_surplus_cells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    cells = ",".join("x" * 12)
    (tmp_path / "in" / "a.csv").write_text(f"{','.join(REQUIRED_COLUMNS)}\n{cells}\n{cells},\n")
    stream = stream_feed(spark, str(tmp_path / "in"))
    query = write_scores(stream, str(tmp_path / "out"), str(tmp_path / "log")).trigger(
        availableNow=True
    )
    with pytest.raises(StreamingQueryException, match="More cells"):
        query.start().awaitTermination()


def test_stream_stops_at_a_wrong_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    header = ",".join(reversed(REQUIRED_COLUMNS))
    (tmp_path / "in" / "a.csv").write_text(f"{header}\n{','.join('x' * 12)}\n")
    stream = stream_feed(spark, str(tmp_path / "in"))
    query = write_scores(stream, str(tmp_path / "out"), str(tmp_path / "log")).trigger(
        availableNow=True
    )
    with pytest.raises(StreamingQueryException):
        query.start().awaitTermination()
