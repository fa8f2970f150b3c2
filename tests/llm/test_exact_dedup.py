import brute
import pytest
from pyspark.sql import functions as F

from shelfgauge.llm import exact_dedup


def marks(df, **options):
    return exact_dedup.mark_copies(df, **options).collect()


def test_matches_brute_force_with_and_without_frequent_digests(docs_of):
    texts = ["a b c"] * 40 + ["abc", " a\tb\x0bc  ", "", None, " \n", "ab\xa0c", "abç"] * 3 + ["x" * 50_000]
    docs = docs_of(*texts)
    want = brute.exact(list(enumerate(texts)))
    for counters in (16, 10_000):
        got = {
            r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
            for r in marks(docs.repartition(5), counters=counters)
        }
        assert got == want


def test_the_sketch_names_the_frequent_group(docs_of, spark):
    docs = docs_of(*["same text"] * 300, *[f"text {i}" for i in range(300)])
    keys = docs.repartition(6).select(exact_dedup.digest("text").alias("digest"))
    found = {r.hash for r in exact_dedup.frequent_digests(keys, 64).collect()}
    same = spark.range(1).select(F.xxhash64(F.sha2(F.lit("sametext"), 256))).first()[0]
    assert same in found


def test_repeated_rows_and_null_ids(docs_of):
    rows = marks(docs_of((1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")))
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in rows if r.keep_id) == [
        (-1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True),
    ]
    assert sorted((r.group_size, r.kept) for r in rows if r.keep_id is None) == [(2, False), (2, True)]


@pytest.mark.parametrize("counters", [16, 10_000])
def test_dropping_keeps_one_row_with_its_columns(docs_of, counters):
    docs = docs_of((3, "a b"), (1, "ab"), (2, "a b"), (2, "a b"), (4, None), (None, ""), (5, "z"))
    docs = docs.union(docs_of(*[(100 + i, "many times") for i in range(200)]))
    left = exact_dedup.drop_copies(docs.repartition(4), counters=counters)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 100]


def test_empty(docs_of):
    empty = docs_of("a").where("false")
    assert marks(empty) == [] and exact_dedup.drop_copies(empty).collect() == []


def test_main_path_runs_no_python(docs_of):
    plan = exact_dedup.mark_copies(docs_of("a"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
