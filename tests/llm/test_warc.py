import base64
import hashlib
import io
import uuid

import pytest
import zstandard

from shelfgauge.llm import warc


@pytest.fixture
def pages_of(spark):
    def build(*rows):
        rows = [(page, f"http://h.example/{page}", html, "x", 1) for page, html in rows]
        return spark.createDataFrame(
            rows, "page_id long, url string, html string, bundle string, target int"
        )

    return build


def brute(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    last = {}
    for page, html in rows:
        last[digest(html)] = max(page, last.get(digest(html), page))
    return {
        page: (
            len((html or "").encode()), digest(html),
            *(("response", None) if last[digest(html)] == page else ("revisit", last[digest(html)])),
        )
        for page, html in rows
    }


@pytest.mark.parametrize("frame, bundle", [(1 << 18, 1 << 25), (300, 1500), (1, 1)])
def test_round_trip(spark, pages_of, frame, bundle):
    rows = [(i, f"<p>page {i % 13} é</p>" * (i % 13)) for i in range(60)] + [(60, None), (61, "é" * 30_000)]
    index = warc.write_archive(pages_of(*rows).repartition(3), frame=frame, bundle=bundle)
    read = warc.read_archive(index).collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read}
    assert got == brute(rows) and len(read) == len(rows)
    texts = dict(rows)
    assert all(r.payload == (texts[r.page_id] or "").encode() for r in read if r.record_type == "response")


def test_bundles_are_plain_zstandard_with_a_seek_table(pages_of, tmp_path):
    rows = [(i, f"page {i} " * 40) for i in range(40)]
    index = warc.write_archive(pages_of(*rows).coalesce(1), str(tmp_path), frame=1000).collect()
    assert {r.length > 0 for r in index} == {True} and len({r.frame for r in index}) > 5
    path = index[0].bundle
    with open(path, "rb") as file:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read()), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\nWARC-Type: response") == 40 and b"WARC-Type: warcinfo" in plain
    one = next(r for r in index if r.page_id == 23)
    bundle = warc.Bundle(one.bundle)
    fields, payload = warc.parse(bundle.frame(one.frame)[one.offset : one.offset + one.length])
    bundle.close()
    assert payload == rows[23][1].encode() and fields["WARC-Record-ID"] == one.record_id
    assert uuid.UUID(one.record_id[10:-1])


def test_damage_is_noticed(pages_of, tmp_path, spark):
    index = warc.write_archive(pages_of((1, "a" * 99)).coalesce(1), str(tmp_path)).collect()
    path = index[0].bundle
    raw = bytearray(open(path, "rb").read())
    raw[40] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        warc.read_archive(spark.createDataFrame(index)).collect()


def test_null_ids_and_repeated_rows(pages_of):
    rows = [(None, "same"), (2, "same"), (2, "same"), (None, "lone"), (None, "lone")]
    read = warc.read_archive(warc.write_archive(pages_of(*rows))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in read) == [
        (0, "response", 0, 4), (0, "response", 0, 4), (0, "revisit", 2, 4),
        (2, "response", 0, 4), (2, "response", 0, 4),
    ]


def test_odd_urls_stay_in_their_header(spark):
    own, raw = warc.record(7, "http://h/a b\r\nX: 1", b"x", None, False)
    fields, payload = warc.parse(raw)
    assert fields["WARC-Target-URI"] == "http://h/a%20b%0D%0AX:%201" and payload == b"x"


def test_empty(pages_of):
    assert warc.read_archive(warc.write_archive(pages_of((1, "a")).where("false"))).collect() == []


def test_read_back_has_tasks_by_the_bytes_of_the_records(pages_of, monkeypatch):
    rows = [(i, f"page {i} " * 100) for i in range(200)]
    index = warc.write_archive(pages_of(*rows).coalesce(1), frame=2000, bundle=5000)
    bundles = index.select("bundle").distinct().count()
    for size, tasks in ((1 << 25, 1), (40_000, range(3, 9)), (1, bundles)):
        monkeypatch.setattr(warc, "READ", size)
        read = warc.read_archive(index)
        parts = read.rdd.getNumPartitions()
        assert parts in tasks if isinstance(tasks, range) else parts == tasks
        assert read.count() == 200
    assert bundles > 20 and warc.read_archive(index.where("false")).collect() == []
