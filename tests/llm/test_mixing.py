import math
import random
from collections import Counter
from fractions import Fraction
from itertools import islice

import pytest

from shelfgauge.llm import mixing


@pytest.fixture
def sourced(spark):
    def build(sizes, parts=3):
        rows = [(i, name, "x", 1, 2) for name, n in sizes.items() for i in range(n)]
        random.Random(1).shuffle(rows)
        frame = spark.createDataFrame(rows, "doc_id long, source string, key string, slot int, block int")
        return frame.repartition(parts)

    return build


def test_rounds_deviate_by_less_than_a_block():
    draw = random.Random(3)
    for _ in range(200):
        parts = {f"s{i}": draw.choice([1, 2, 7, 50, 300]) for i in range(draw.randint(1, 12))}
        slots, seen = sum(parts.values()), Counter()
        order = mixing.one_round(parts)
        assert Counter(order) == parts
        for slot, name in enumerate(order, 1):
            seen[name] += 1
            assert all(abs(slot * p - seen[s] * slots) < slots for s, p in parts.items())


def test_shares_add_up_and_follow_the_weights():
    assert mixing.shares({"a": 1, "b": 1, "c": 2}, 10_000) == {"a": 2500, "b": 2500, "c": 5000}
    found = mixing.shares({"a": 1e-12, "b": 1 / 3, "c": 2 / 3}, 1000)
    assert sum(found.values()) == 1000 and found["a"] == 1


def flow(blocks, weights, slots):
    """Exact blocks of each source after each number of slots, by steps from end to end."""
    got, time = dict.fromkeys(blocks, Fraction(0)), Fraction(0)
    for slot in range(1, slots + 1):
        while time < slot:
            live = [s for s in blocks if got[s] < blocks[s]]
            total = sum(Fraction(weights[s]) for s in live)
            step = min([slot - time] + [(blocks[s] - got[s]) * total / Fraction(weights[s]) for s in live])
            for s in live:
                got[s] += step * Fraction(weights[s]) / total
            time += step
        yield got


def test_many_slots_stay_within_a_block_of_exact_targets():
    weights = {"a": 1 / 3, "b": 2 / 3 - 1e-6, "c": 1e-6}
    seen, total = Counter(), sum(map(Fraction, weights.values()))
    for name, block, phase, slot, weight in islice(mixing.turns(dict.fromkeys(weights, 10**6), weights), 200_000):
        assert block == seen[name] and phase == 0 and weight == pytest.approx(weights[name])
        seen[name] += 1
        if slot % 97 == 0:
            assert all(abs((slot + 1) * Fraction(w) / total - seen[s]) < 1 for s, w in weights.items())
    assert seen["c"] <= 1


def test_random_sources_stay_within_a_block_through_all_phases():
    draw = random.Random(8)
    for _ in range(40):
        n = draw.randint(1, 14)
        blocks = {f"s{i}": draw.choice([0, 1, 1, 2, 9, 40]) for i in range(n)}
        weights = {s: draw.choice([1, 1, 0.1, 1 / 3, 1e-9, 7, draw.random() + 1e-3]) for s in blocks}
        seen, found = Counter(), list(mixing.turns(blocks, weights))
        assert len(found) == sum(blocks.values())
        for (name, block, *_), want in zip(found, flow(blocks, weights, len(found))):
            assert block == seen[name]
            seen[name] += 1
            assert all(abs(want[s] - seen[s]) < 1 for s in blocks)


def test_many_sources_take_their_turns(sourced):
    sizes = {f"site{i}": 1 + i % 3 for i in range(1200)} | {"big": 400}
    rows = mixing.schedule(sourced(sizes), block=1).collect()
    assert Counter(r.doc.source for r in rows) == sizes
    assert sorted(r.slot for r in rows) == list(range(sum(sizes.values())))
    blocks, weights = sizes, {s: math.sqrt(n) for s, n in sizes.items()}
    first = sorted((r.slot, r.doc.source) for r in rows)[:1000]
    total = sum(weights.values())
    assert abs(sum(s == "big" for _, s in first) - 1000 * weights["big"] / total) < 1
    assert [s for _, s in first] == [t[0] for t in islice(mixing.turns(blocks, weights), 1000)]


def test_weights_must_be_positive(sourced):
    with pytest.raises(ValueError, match="not positive"):
        mixing.schedule(sourced({"a": 1}), {"a": 0})


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_every_row_once_and_each_prefix_on_target(sourced, weights):
    sizes = {"a": 700, "b": 95, "c": 160}
    rows = mixing.schedule(sourced(sizes), weights, block=4, slots=1000).collect()
    assert Counter((r.doc.source, r.doc.doc_id) for r in rows) == Counter(
        (s, i) for s, n in sizes.items() for i in range(n)
    )
    blocks = {}
    for r in rows:
        blocks.setdefault((r.slot, r.doc.source, r.block, r.phase, r.weight), []).append(r.place)
    assert sorted(key[0] for key in blocks) == list(range(sum(-(-n // 4) for n in sizes.values())))
    for (_, source, block, _, _), places in blocks.items():
        full = 4 if (block + 1) * 4 <= sizes[source] else sizes[source] % 4
        assert sorted(places) == list(range(full))
    order = [(source, block, phase, weight) for _, source, block, phase, weight in sorted(blocks)]
    next_block, phase, seen, slot = Counter(), -1, Counter(), 0
    targets = {(p, s): w for s, _, p, w in order}
    for source, block, own, _ in order:
        assert block == next_block[source]
        next_block[source] += 1
        if own != phase:
            assert own == phase + 1
            phase, seen, slot = own, Counter(), 0
        slot += 1
        seen[source] += 1
        for (p, s), w in targets.items():
            if p == phase:
                assert abs(slot * w - seen[s]) < 1


def test_the_mix_is_sorted_and_whole(sourced):
    docs = sourced({"a": 64, "b": 64})
    mixed = mixing.mix(docs, {"a": 1, "b": 1}, block=2, slots=10)
    assert mixed.columns == docs.columns
    order = [r.source for r in mixed.collect()]
    assert Counter(order) == {"a": 64, "b": 64}
    assert all(order[i : i + 4].count("a") == 2 for i in range(0, 128, 4))


def test_null_sources_repeated_rows_and_missing_weights(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "null"), (2, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.schedule(docs, {None: 1, "": 1, "null": 1}, block=1).collect()
    assert Counter((r.doc.doc_id, r.doc.source) for r in got) == Counter(rows)
    assert sorted(r.slot for r in got) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="without a weight"):
        mixing.schedule(docs, {None: 1})


def test_empty(sourced):
    empty = sourced({"a": 1}).where("false")
    assert mixing.schedule(empty).collect() == [] and mixing.mix(empty).collect() == []
