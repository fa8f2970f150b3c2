import random
from itertools import combinations

import brute
import pytest

from shelfgauge.llm import simhash


def unsigned(value):
    return value % (1 << 64)


def test_every_close_pair_agrees_on_some_mask():
    masks = simhash.covering_masks()
    assert len(masks) == 31 and min(m.bit_count() for m in masks) >= 30
    draw = random.Random(4)
    for _ in range(5000):
        differ = sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4)))
        assert any(not differ & mask for mask in masks)
    small = simhash.covering_masks(2, 10)
    for size in range(3):
        for bits in combinations(range(10), size):
            assert any(not sum(1 << b for b in bits) & mask for mask in small)


def test_fingerprints_equal_brute_force():
    draw = random.Random(9)
    texts = ["", " \n", "a", "A b", "É x", "a b c d", "a a a a a a", "x " * 70_000, "ß\xa0b c d e"]
    texts += [" ".join(draw.choice(["A", "b", "Ç", "d\t"]) for _ in range(n)) for n in range(60)]
    for text in texts[:-60] + texts[-60:]:
        if len(text) < 1000:
            assert simhash.fingerprint(text) == brute.fingerprint(text), text
    assert simhash.fingerprint(texts[7]) == brute.fingerprint("x " * 8)


def chain(draw, n, step):
    """Values each within ``step`` bits of the one before."""
    value = draw.getrandbits(64)
    for _ in range(n):
        yield value
        for bit in draw.sample(range(64), step):
            value ^= 1 << bit


@pytest.mark.parametrize("large", [3, 1024])
def test_components_of_chains_clouds_and_lone_values(spark, large):
    draw = random.Random(5)
    values = {0, 1, 2**63, 2**64 - 1}
    for step in (1, 3, 4, 5):
        values |= set(chain(draw, 25, step))
    centre = draw.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a, b in combinations(range(9), 2)}
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    edges = simhash.links(frame, large)
    got = {r.b: r.a for r in simhash.stars(edges).collect()}
    want = brute.components(values)
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(got.get(simhash._signed(v), simhash._signed(v)))
    assert all(len(roots) == 1 for roots in groups.values())
    assert len({r for roots in groups.values() for r in roots}) == len(groups)


def test_documents_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute.near([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(docs).collect()}
    assert got == want


@pytest.mark.parametrize("parts", [3, 1])
def test_frequent_fingerprints_or_none_give_the_same(docs_of, monkeypatch, parts):
    monkeypatch.setattr(simhash, "FREQUENT", parts)
    draw = random.Random(2)
    texts = ["same words in this one text"] * 20 + [
        " ".join(draw.choice("abcdefghij") for _ in range(40)) for _ in range(15)
    ]
    texts += texts[25:28] + [texts[30] + " k"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(docs_of(*texts)).collect()}
    assert got == brute.near(list(enumerate(texts)))


def test_nulls_empties_and_repeats(docs_of):
    text = "one two three four five six seven eight nine ten"
    docs = docs_of((5, text), (5, text), (None, text), (7, None), (3, ""), (None, "alone here"), (9, text.upper()))
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_copies(docs).collect()}
    assert simhash.near_copies(docs).count() == 7
    assert rows[7, "0" * 16] == rows[3, "0" * 16] == 3
    assert {c for (d, f), c in rows.items() if f == f"{brute.fingerprint(text):016x}"} == {5}
    assert rows[None, f"{brute.fingerprint('alone here'):016x}"] is None
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "alone here"), (3, ""), (5, text)]


def test_empty(docs_of):
    empty = docs_of("a").where("false")
    assert simhash.near_copies(empty).collect() == []
    assert simhash.drop_near_copies(empty).collect() == []
