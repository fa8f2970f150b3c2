import random
import tracemalloc

import brute
import numpy as np
import pytest

from shelfgauge.llm import suffix_dedup as sd


def test_sorting_equals_python(subtests=None):
    draw = random.Random(3)
    for _ in range(2500):
        base = bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 60)))
        texts = []
        for _ in range(draw.randint(1, 12)):
            cut = draw.randint(0, len(base))
            texts.append(base[:cut] + bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 6))))
        order = sd.deep_shallow(texts, 0, draw.choice([0, 1, 4, 16]))
        assert [texts[i] for i, _ in order] == sorted(texts)
        assert sorted(i for i, _ in order) == list(range(len(texts)))
        for (a, _), (b, common) in zip(order, order[1:]):
            assert sd.shared(texts[a], texts[b]) == common


def test_every_window_holds_an_anchor_and_parts_do_not_matter(monkeypatch):
    raw = np.random.default_rng(1).integers(97, 100, 3000, np.uint8)
    whole = in_order(raw)
    gaps = np.diff(np.concatenate([[-1], whole[2], [len(raw) - sd.GRAM + 1]]))
    assert gaps.max() <= sd.BEFORE + 1
    monkeypatch.setattr(sd, "PART", 700)
    for one, other in zip(whole, in_order(raw)):
        assert (one == other).all()


def in_order(raw):
    """All anchors of a text by place."""
    columns = [np.concatenate(parts) for parts in zip(*sd.anchors(raw, sd.Hasher()))]
    return [column[np.argsort(columns[2])] for column in columns]


def test_parts_fold_to_the_same(monkeypatch):
    draw = random.Random(6)
    passages = [bytes(draw.choice(b"abcdef") for _ in range(draw.randint(150, 600))) for _ in range(4)]
    for _ in range(40):
        text = b"".join(draw.choice([*passages, b"x" * 500]) for _ in range(draw.randint(0, 12)))
        raw = np.frombuffer(text, np.uint8)
        monkeypatch.setattr(sd, "PART", 1 << 18)
        rows, cover = sd.folded(raw, sd.Hasher())
        monkeypatch.setattr(sd, "PART", draw.randint(200, 900))
        by_parts, again = sd.folded(raw, sd.Hasher())
        assert cover == again
        for i in (0, 1, 4):
            assert (rows[i] == by_parts[i]).all()


def test_a_long_text_of_one_letter_takes_the_memory_of_a_part():
    raw, hasher = np.full(6_000_000, 120, np.uint8), sd.Hasher()
    tracemalloc.start()
    rows, cover = sd.folded(raw, hasher)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    # All but the edges hold the same context.
    assert rows[4].sum() == len(raw) - sd.GRAM + 1 and rows[4].max() == len(raw) - 2 * sd.BEFORE - sd.GRAM + 1
    assert cover == [(1, len(raw) - 1)] or cover == [(0, len(raw))]


def test_long_repetitive_texts_among_others(docs_of):
    letters, pairs = "x" * 2_000_000, "ab" * 700_000
    found = {r.doc_id: r for r in rows(docs_of(letters, "short", pairs, "x" * 150))}
    assert [(found[i].n_bytes, found[i].n_removed, found[i].n_spans) for i in range(4)] == [
        (2_000_000, 2_000_000, 1), (5, 0, 0), (1_400_000, 1_400_000, 1), (150, 0, 0),
    ]


def test_groups_of_any_size_give_the_same_edges(monkeypatch):
    draw = random.Random(12)
    for _ in range(60):
        gram, cores = "g" * sd.GRAM, ["".join(draw.choice("ab") for _ in range(150)) for _ in range(3)]
        before, after = [], []
        for _ in range(draw.randint(2, 40)):
            cut, core = draw.randint(0, sd.BEFORE), draw.choice(cores)
            before.append((core[:cut] + "x" * draw.randint(0, 9))[: sd.BEFORE].encode())
            cut = draw.randint(0, sd.BEFORE)
            after.append((gram + draw.choice(cores)[:cut] + "y" * draw.randint(0, 9))[: sd.WINDOW].encode())
        alone = [draw.random() < 0.8 for _ in before]
        monkeypatch.setattr(sd, "PAIRS", 10**6)
        by_pairs = sd.edges(before, after, alone)
        monkeypatch.setattr(sd, "PAIRS", 0)
        assert sd.edges(before, after, alone) == by_pairs


def rows(df, **options):
    texts = sd._read(df, "text", "doc_id")
    return sd._removed(texts, sd.covered(texts, **options)).collect()


@pytest.mark.parametrize("large", [2, 20_000])
def test_equals_brute_force(docs_of, large):
    draw = random.Random(8)
    letters = "abcdefgh é"
    random_text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    passages = [random_text(draw.randint(120, 900)) for _ in range(10)]
    texts = ["", " ", "x" * 199, "x" * 200, "x" * 201, "ab" * 500, "ab" * 500 + "c" * 300]
    for _ in range(120):
        text = ""
        for _ in range(draw.randint(1, 5)):
            passage = draw.choice(passages)
            start = draw.randint(0, len(passage))
            text += passage[start : draw.randint(start, len(passage))] + random_text(draw.randint(0, 120))
        texts.append(text)
    texts += texts[20:24]
    got = {r.doc_id: r[1:5] for r in rows(docs_of(*texts), large=large)}
    assert [tuple(got[i]) for i in range(len(texts))] == brute.repeats(texts)


def test_given_documents_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id long, text string")
    got = {r.doc_id: tuple(r[1:5]) for r in sd.remove_repeats(df).collect()}
    assert [got[r.doc_id] for r in docs] == brute.repeats([r.text for r in docs])


def test_nulls_and_repeated_rows(docs_of):
    text = "".join(chr(97 + i * i % 23) for i in range(260))
    found = sd.remove_repeats(docs_of((1, text), (1, text), (None, None), (None, "short"))).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in found) == [
        (0, 0, 0, 0, b""), (0, 5, 0, 0, b"short"), (1, 260, 260, 1, b""), (1, 260, 260, 1, b""),
    ]


def test_empty(docs_of):
    assert sd.remove_repeats(docs_of("a").where("false")).collect() == []
