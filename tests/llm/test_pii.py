import hashlib
import random

import brute

from shelfgauge.llm import pii


def base(spans):
    return {kind: spans[kind] for kind in pii.BASE}


def test_base_spans_equal_plain_expressions_on_random_texts():
    draw = random.Random(11)
    anchors = pii._automaton()
    for alphabet in ("ab@@..12345 -+()%é\n", "1.2. -+4", "4111 -", "a@b.c-_%"):
        for _ in range(4000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))
            assert base(pii.find(text, anchors)) == brute.personal(text), text


def test_known_spans():
    text = (
        "Write to ann.b+c@mail.example.org. Card 4111 1111 1111 1111, host 10.0.0.255 not 10.0.0.256, "
        "call +1 (017) 555-7713; api_key = 'abcd1234efgh' and https://joe:secret1@host.example/x"
    )
    spans = pii.find(text, pii._automaton())
    cut = {kind: [text[a:b] for a, b in found] for kind, found in spans.items()}
    assert cut == {
        "email": ["ann.b+c@mail.example.org", "secret1@host.example"],
        "ip": ["10.0.0.255"],
        "card": ["4111 1111 1111 1111"],
        "phone": ["+1 (017) 555-7713"],
        "login": ["https://joe:secret1@host.example"],
        "account": ["abcd1234efgh"],
    }
    clean = pii.redacted(text, spans)
    assert "4111" not in clean and "joe" not in clean and clean.startswith("Write to <EMAIL>. Card <CARD>,")


def test_cues_in_any_case_and_joined_forms():
    anchors = pii._automaton()
    for text in (
        "API key: abcd1234efgh", "Api Key: abcd1234efgh", "SecretKey=abcd1234efgh", "PassWord = abcd1234efgh",
        "secret_access_key = abcd1234efgh", "my_secret_key: abcd1234efgh", "Access-Key=abcd1234efgh",
    ):
        (start, end), = pii.find(text, anchors)["account"]
        assert text[start:end] == "abcd1234efgh"
    assert pii.find("É token = abcd1234efgh", anchors)["account"] == [(10, 22)]


def test_clean_texts_are_left_alone():
    anchors = pii._automaton()
    for text in (
        "The token was lost; a secret is no secret. Tokens 12345678 and accounting 2024-2025.",
        "Version 1.2.3 of 12 parts at 3.14, @home, a@b, + 12, https://example.com/a?b=c@d",
        "password: yes",
    ):
        assert not any(pii.find(text, anchors).values()), text


def test_very_long_texts_take_linear_time():
    anchors = pii._automaton()
    for text in ("1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1(" * 100_000, "a" * 300_000 + "@b"):
        assert base(pii.find(text, anchors))["phone"] == []


def test_parts_with_very_many_zeros():
    anchors = pii._automaton()
    zeros = "0" * 5000
    assert pii.find(f"{zeros}1.2.3.4", anchors)["ip"] == [(0, 5007)]
    assert pii.find(f"1.{zeros}255.3.{zeros}", anchors)["ip"] == [(0, 10008)]
    assert pii.find(f"1.{zeros}256.3.4", anchors)["ip"] == []


def test_rows(docs_of):
    rows = pii.find_spans(docs_of((1, "x@y.zz"), (1, "x@y.zz"), (None, None), (2, ""))).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_email, r.spans) for r in rows] == [
        (1, 1, "email:0:6"), (1, 1, "email:0:6"), (None, 0, ""), (2, 0, ""),
    ]
    assert rows[0].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert rows[2].base_sha256 == nothing and rows[0].redacted == "<EMAIL>"


def test_empty(docs_of):
    assert pii.find_spans(docs_of("a").where("false")).collect() == []
