import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from shelfgauge.llm import spelling as sp


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, shortest=7, least=2, ratio=10):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            value = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if value % 31 == 0:
                at = value % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) <= 1 and levenshtein(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def texts_of(draw, n, letters="abAé", longest=9):
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(6, longest))) for _ in range(25)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(draw.randint(0, 60)):
            word = list(draw.choice(stems))
            if draw.random() < 0.1:
                word[draw.randrange(len(word))] = draw.choice(["", "x", "a", "éb"])
            words.append("".join(word))
        texts.append(draw.choice([" ", "-", "\n1"]).join(words))
    return texts


@pytest.mark.parametrize("large", [50_000, 5, 1])
def test_equals_brute_force(docs_of, large):
    draw = random.Random(large)
    texts = texts_of(draw, 60)
    rows = list(enumerate(texts)) + [(7, None), (7, ""), (7, texts[0]), (None, texts[1]), (7, texts[0])]
    df = sp.group_variants(docs_of(*rows).repartition(3), large=large, ratio=3)
    want = brute(rows, ratio=3)
    assert got(df) == want
    assert sum(v[0] is not None for v in want.values()) > 5 and max(v[3] for v in want.values()) >= 3


def test_long_chains_of_forms_end_at_the_root(docs_of):
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx"]
    text = " ".join(word for i, word in enumerate(words) for _ in range(2 * 2**i))
    rows = [(next(i for i in range(99) if all(sp.variant(str(i), word) == word for word in words)), text)]
    found = got(sp.group_variants(docs_of(*rows), ratio=2))
    assert found == brute(rows, ratio=2)
    assert found["abcdefgh"][1] == "abcvwzyx"


def test_pairs_of_any_length_are_found_once():
    draw = random.Random(5)
    for length in (7, 8, 63, 64, 65, 66, 200):
        stem = "".join(draw.choice("abc") for _ in range(length))
        words = {stem}
        for _ in range(40):
            word = list(draw.choice(sorted(words)))
            at = draw.randrange(len(word))
            word[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "b", "c"])
            words.add("".join(word))
        words = sorted(words)
        pairs = [tuple(sorted(p)) for p in sp.near_pairs(words)]
        want = [(i, j) for i, j in combinations(range(len(words)), 2) if levenshtein(words[i], words[j]) == 1]
        assert sorted(pairs) == want
        assert all(sp.is_near(words[i], words[j]) == ((i, j) in set(want)) for i, j in combinations(range(len(words)), 2))


def test_near_words_share_the_signature_in_which_they_count():
    draw, vectors = random.Random(8), sp.Vectors()
    for _ in range(3000):
        a = "".join(draw.choice("abcdeé") for _ in range(draw.randint(7, 14)))
        at = draw.randrange(len(a))
        b = a[:at] + draw.choice(["", "x", "a", "ab", "é" + a[at]]) + a[at + 1 :]
        if not sp.is_near(a, b):
            continue
        one, other = vectors.signatures([a, b])
        shared = [at for at in range(len(one)) if one[at] == other[at]]
        assert shared and shared[0] == sp.first_shared(a, b)
        assert all(one & 255 == range(len(one)))


def test_very_long_words_and_one_word_everywhere(docs_of):
    long = "ab" * 200_000
    rows = [(1, long), (2, long + " " + long[:-1]), (3, long[:-1]), (4, "the same words " * 20_000), (5, long[1:] + " " + long[1:])]
    found = got(sp.group_variants(docs_of(*rows)))
    plain = Counter()
    for key, text in rows:
        for run in text.split():
            if len(word := sp.variant(str(key), run)) >= 7:
                plain[word] += 1
    words = [w for w, n in plain.items() if n > 1]
    assert {w: v[2] for w, v in found.items()} == {w: plain[w] for w in words}
    assert all(found[w][3] == sum(sp.is_near(w, o) for o in words) for w in words)
    assert any(v[3] for v in found.values())


def test_given_documents_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(sp.group_variants(docs)) == brute_by_deletions(rows)


def brute_by_deletions(rows):
    """As ``brute``, with near words found by what is left when a character goes."""
    plain = brute(rows, ratio=10**9, least=10**9)
    assert plain == {}
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = sp.variant(str(key), re.sub("[A-Z]", lambda m: m[0].lower(), run))
            if len(word) >= 7:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    shared = {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            shared.setdefault(v, []).append(w)
    near = {w: set() for w in words}
    for found in shared.values():
        for a, b in combinations(found, 2):
            if levenshtein(a, b) == 1:
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_empty(docs_of):
    assert sp.group_variants(docs_of("a").where("false")).collect() == []
    assert sp.group_variants(docs_of(None, "", "no word here twice")).collect() == []
