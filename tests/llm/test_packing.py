import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfgauge.llm import common, packing, tokens
from shelfgauge.llm.tokens import Tokens


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_file(reference):
    draw = random.Random(1)
    letters = "ab'sT 1٣²é\n\t\r \x85\xa0 \x1c\x0b日本🎉́ß<|endoftext|>_-.,"
    encoder = Tokens()
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 14)))
        assert encoder.encode(text) == np.array(reference(text), "<u4").tobytes(), text


def test_added_tokens_are_one_id_as_in_the_tokenizer_file(docs_of):
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda text: found.encode(text, add_special_tokens=False).ids
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    draw = random.Random(6)
    some = ["<|endoftext|>", " ", "\n", "  ", "a", "'s", "1", "é", "<|", "|>", "endoftext", "🎉"]
    encoder = Tokens()
    for _ in range(4000):
        text = "".join(draw.choice(some) for _ in range(draw.randint(0, 12)))
        assert encoder.encode(text) == np.array(ids(text), "<u4").tobytes(), text
        assert encoder.count(text) == len(ids(text))
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 70]
    check(packing.pack(docs_of(*texts), window=64).collect(), 64, dict(enumerate(map(ids, texts))))


def test_the_tree_finds_the_tightest_room():
    draw = random.Random(2)
    for window in (5, 16, 100):
        rooms, plain = packing.Rooms(window), []
        for number in range(3000):
            if draw.random() < 0.5:
                room = draw.randint(1, window)
                rooms.put(room, number)
                plain.append(room)
            else:
                need = draw.randint(1, window)
                found = rooms.take(need)
                best = min((r for r in plain if r >= need), default=None)
                assert (found and found[1]) == best
                if found:
                    plain.remove(best)


def check(rows, window, ids_of):
    """All ids once, in gapless sequences; returns the tokens of each sequence."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for key, found in documents.items():
        ids, at = [*ids_of[key], 0], 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    return [sum(length for _, length in found) for found in sequences.values()]


@pytest.mark.parametrize("window, shard", [(1024, 20_000), (64, 50), (1, 10)])
def test_pieces(docs_of, reference, window, shard):
    draw = random.Random(window)
    words = ["alpha", "beta", "gamma", "é日", "x1"]
    texts = ["", None, "a" * 5000]
    texts += [" ".join(draw.choice(words) for _ in range(draw.randint(1, 200))) for _ in range(60)]
    rows = packing.pack(docs_of(*texts).repartition(3), window=window, shard=shard).collect()
    totals = check(rows, window, {i: reference(t or "") for i, t in enumerate(texts)})
    if window == 64:
        assert sum(totals) >= 0.97 * window * len(totals)


def test_little_padding_on_the_given_documents(spark, folder):
    rows = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"))
    used = rows.groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in used)
    assert total >= 0.97 * 1024 * (len(used) - 1)


def test_repeated_rows_and_null_ids(docs_of):
    rows = packing.pack(docs_of((1, "a b"), (1, "a b"), (None, "c"), (None, None))).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_the_same_rows_give_the_same_windows(docs_of):
    docs = docs_of(*[f"text {i} " * (i % 9) for i in range(200)]).coalesce(1)
    once, again = (sorted(map(tuple, packing.pack(docs, shard=30).collect())) for _ in range(2))
    assert once == again


def test_empty(docs_of):
    assert packing.pack(docs_of("a").where("false")).collect() == []


def test_runs_of_white_space_equal_the_tokenizer_file(monkeypatch):
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokens, "_LONG", re.compile(tokens._LONG.pattern.replace("50000", "3")))
    draw, encoder = random.Random(1), Tokens()
    some = ["<|endoftext|>", " ", "\n", "  ", "a", "'s", "\x1c", "é", "\xa0", "\u3000", "   ", "\t"]
    for _ in range(5000):
        text = "".join(draw.choice(some) for _ in range(draw.randint(0, 14)))
        want = found.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(want, "<u4").tobytes(), text


def test_very_long_runs_amid_other_rows(docs_of):
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a b", " " * 2_000_000, "x" + "\n" * 2_000_000 + " y", " \t\n" * 700_000, "a" * 2_000_000, ""]
    ids = {i: found.encode(text, add_special_tokens=False).ids for i, text in enumerate(texts)}
    check(packing.pack(docs_of(*texts)).collect(), 1024, ids)


def test_sequences_hold_the_ids(docs_of, reference):
    texts = ["", None, "alpha beta " * 300, *(f"word {i} " * (i % 17) for i in range(200))]
    docs = docs_of(*texts).repartition(3)
    rows = packing.pack_sequences(docs, window=100, shard=90, pad=7).collect()
    tokens_of = {i: [*reference(text or ""), 0] for i, text in enumerate(texts)}
    left = dict(tokens_of)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        power = r.n_tokens & (r.n_tokens - 1) == 0
        assert len(ids) == (r.n_tokens if power else 100) and set(ids[r.n_tokens :]) <= {7}
        assert [p.offset for p in r.pieces] == [
            sum(p.length for p in r.pieces[:at]) for at in range(len(r.pieces))
        ] and sum(p.length for p in r.pieces) == r.n_tokens
        for p in r.pieces:
            own = tokens_of[p.doc_id]
            assert ids[p.offset : p.offset + p.length] == own[p.start : p.start + p.length]
            assert p.doc_tokens == len(own)
            left[p.doc_id] = left[p.doc_id][p.length :]
    assert not any(left.values()) and len({r.sequence_id for r in rows}) == len(rows)


def test_pieces_carry_their_ids(docs_of):
    rows = packing.pack(docs_of("a b c", "d " * 3000)).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_file_order_outlasts_filters_and_projections(spark, tmp_path):
    """Files of unequal size, read longest first: numbers follow the files, whatever is left out."""
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('word ', 1 + cast(id % 50 as int)) as text", "1 as x")
    path = f"{tmp_path}/docs"
    docs.coalesce(1).write.option("maxRecordsPerFile", 700).parquet(path)
    read = spark.read.parquet(path)
    some = read.where("doc_id % 3 = 0").withColumn("y", read.x + 1).drop("x")
    assert common.from_files(some) and not common.from_files(docs)
    rows = packing.pack(some, window=64, shard=100, files=True).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.sequence_id >> 32, []).append(r.doc_id)
    flat = [key for _, own in sorted(by_shard.items()) for key in sorted(own)]
    assert flat == [i for i in range(4000) if i % 3 == 0]


def test_ids_of_any_size_travel():
    for ids in ([0], [5, 65_535], [65_536], [1, 1 << 31, 0], list(range(1024))):
        raw = np.array(ids, "<u4").tobytes()
        assert packing.wide(packing.slim(raw), len(ids)) == raw
    assert len(packing.slim(np.array([5, 65_535], "<u4").tobytes())) == 4
