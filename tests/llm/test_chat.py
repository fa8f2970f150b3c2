import hashlib
import random

import pytest

from shelfgauge.llm import chat
from shelfgauge.llm.tokens import Tokens

SCHEMA = "conv_id long, turn long, role string, text string, window_no string, loss int"


@pytest.fixture
def turns_of(spark):
    return lambda rows: spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)


def brute(rows):
    """(conv_id, turn, role, text) rows in order: what reading back must give."""
    out = {}
    for conv, _, role, text in rows:
        out.setdefault(conv, []).append((role or "", text or ""))
    want = {}
    for conv, turns in out.items():
        learnt = "".join(text for role, text in turns if role == "assistant")
        turned = "".join(f"{role}\n{text}\n" for role, text in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[conv] = (len(turns), sha(turned), len(learnt), sha(learnt))
    return want


def test_escaping_is_reversible_and_leaves_no_control_string():
    draw = random.Random(6)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "TURN]", "TEXT]", "SYS>>", "|im_end|>", "a", "\n"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        for mark in (chat.TURN, chat.TEXT, chat.END, "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_end|>"):
            assert mark not in out


@pytest.mark.parametrize("budget, history", [(1024, 256), (60, 20), (30, 0), (9, 100)])
def test_round_trip_through_windows(turns_of, budget, history):
    draw = random.Random(budget)
    rows = []
    for conv in range(25):
        roles = ["system"] * (conv % 3 == 0) + ["user", "assistant", "tool", "assistant"] * 5
        for turn, role in enumerate(roles):
            words = [draw.choice(["ok", "[INST]", "</s>", "[TURN]", "é\\", "x\n"]) for _ in range(draw.randint(0, 30))]
            rows.append((conv, turn, role, " ".join(words)))
    shuffled = draw.sample(rows, len(rows))
    windows = chat.format_conversations(turns_of(shuffled), budget, history)
    got = {r.conv_id: tuple(r[1:5]) for r in chat.read_back(windows).collect()}
    assert got == brute(rows)
    straight = chat.read_back(chat.format_conversations(turns_of(shuffled), budget, history), adjacent=True)
    assert {r.conv_id: tuple(r[1:5]) for r in straight.collect()} == got
    encoder = Tokens()
    for w in windows.collect():
        assert w.n_tokens == encoder.count(w.text)
        old = w.n_system * (w.window_no > 0) + w.n_history
        assert w.n_tokens <= budget or (w.n_new <= 1 and w.n_history == 0)
        assert w.text.count(chat.TURN) == w.n_system + w.n_history + w.n_new
        learnt = [chat.unescape(w.text[s.start : s.end]) for s in w.loss]
        turns = [tuple(map(chat.unescape, m.groups())) for m in chat._TURNS.finditer(w.text)]
        assert learnt == [text for role, text in turns[old:] if role == "assistant"]


def test_long_conversations_repeat_the_system_turn_and_history(turns_of):
    rows = [(1, 0, "system", "Be brief.")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"word {t} " * 8) for t in range(1, 40)]
    windows = chat.format_conversations(turns_of(rows), 200, 70).orderBy("window_no").collect()
    assert len(windows) > 3
    assert all(w.text.startswith("[TURN]system[TEXT]Be brief.[/TURN]") for w in windows)
    assert all(w.n_history >= 1 for w in windows[1:]) and windows[0].n_history == 0
    assert sum(w.n_new for w in windows) == 39


def test_nulls_ties_and_repeats(turns_of):
    rows = [
        (None, None, None, None), (None, 0, "user", "a"),
        (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, 1, "system", "late"), (3, 0, "system", "only"),
    ]
    got = {r.conv_id: tuple(r[1:5]) for r in chat.read_back(chat.format_conversations(turns_of(rows))).collect()}
    assert got == brute(rows)
    assert got[2][2] == 2


def test_empty(turns_of):
    none = turns_of([(1, 0, "user", "a")]).where("false")
    assert chat.read_back(chat.format_conversations(none)).collect() == []


def test_many_short_turns_stay_within_the_budget(turns_of):
    rows = [(1, t, "assistant" if t % 2 else "user", "<|x|> ok") for t in range(400)]
    rows += [(2, t, "", "") for t in range(400)]
    encoder = Tokens()
    windows = chat.format_conversations(turns_of(rows)).collect()
    assert len(windows) > 4
    assert all(encoder.count(w.text) == w.n_tokens <= chat.BUDGET for w in windows)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, " \n\t" * 700_000, "a" * 2_000_000])
def test_very_long_texts(turns_of, text):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, "user", "ok"), (2, 0, "assistant", text)]
    got = {r.conv_id: tuple(r[1:5]) for r in chat.read_back(chat.format_conversations(turns_of(rows))).collect()}
    assert got == brute(rows)
