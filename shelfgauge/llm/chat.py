"""Chat formatting (8): windows of whole turns within a token budget.

Turns are formatted by a template whose control strings cannot occur inside a text: where
a text has one, a backslash is put after its first character, and one more where there
are some already, so that taking one away gives the text back. A conversation that does
not fit the budget is cut between turns. Sums of the turns' tokens give the spans: every
window starts with the system turn, if there is one, then repeats as many of the last
turns as ``HISTORY`` tokens hold, then takes new turns while the budget lasts. History
makes way for a long new turn, and a turn that alone exceeds the budget is a window of
its own, whole. The loss mask of a window covers the new assistant texts only, so that
each is learnt once.

Rows are turns, in order of ``turn`` (nulls first, then by role and text). Null texts and
roles count as empty; equal rows are turns like others; rows with a null conversation id
form one conversation. An empty table gives an empty result. Other columns make no
difference. A conversation streams through one task, with one window in memory.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfgauge.llm.common import map_rows, pieces, whole
from shelfgauge.llm.tokens import Tokens

BUDGET = 1024
HISTORY = 256
#: The marks of this template, and how other control strings go on after
#: their first character.
TURN, TEXT, END = "[TURN]", "[TEXT]", "[/TURN]"
_CONTROL = r"(?=/?s>|/?SYS>>|/?INST\]|/?TURN\]|TEXT\]|\|[A-Za-z_]+\|>)"
_PLAIN = re.compile(rf"([<\[])(\\*){_CONTROL}")
_ESCAPED = re.compile(rf"([<\[])\\(\\*){_CONTROL}")
_TURNS = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)

WINDOWS = (
    "window_no long, n_system long, n_history long, n_new long, n_tokens long, "
    "text string, loss array<struct<start: long, end: long>>"
)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def marked(role: str, text: str) -> str:
    """One turn as it is written."""
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


def written(turns: list[tuple[str, str]], n_old: int) -> tuple[str, list[dict[str, int]]]:
    """The formatted turns, and where the texts of assistants after the first ``n_old`` lie."""
    parts, loss, at = [], [], 0
    for place, (role, text) in enumerate(turns):
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if place >= n_old and role == "assistant":
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts.append(f"{head}{body}{END}")
        at += len(parts[-1])
    return "".join(parts), loss


class Cutter:
    """Turns of one conversation in, windows out."""

    def __init__(self, budget: int, history: int, shared: int = 0) -> None:
        """Where two turns meet, ``shared`` tokens fewer are needed than for each alone."""
        self.budget, self.history, self.shared = budget - shared, history, shared
        self.system: list[tuple[str, str]] = []
        self.system_tokens = self.n = self.n_old = 0
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]  # tokens of the first turns of the window, after the system turn

    def window(self) -> tuple:
        text, loss = written(
            self.system + self.turns, len(self.system) * (self.n > 0) + self.n_old
        )
        n_system = len(self.system)
        row = (
            self.n, n_system, self.n_old, len(self.turns) - self.n_old,
            self.system_tokens + self.sums[-1] + self.shared, text, loss,
        )
        self.n += 1
        return row

    def _reach_back(self, room: int) -> None:
        """Keep the last turns that ``room`` tokens hold, as history."""
        first = bisect_left(self.sums, self.sums[-1] - max(0, room))
        self.turns = self.turns[first:]
        self.sums = [total - self.sums[first] for total in self.sums[first:]]
        self.n_old = len(self.turns)

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        tokens -= self.shared
        if role == "system" and not self.n and not self.turns and not self.system:
            self.system, self.system_tokens = [(role, text)], tokens
            return
        if len(self.turns) > self.n_old and self.system_tokens + self.sums[-1] + tokens > self.budget:
            yield self.window()
            self._reach_back(min(self.history, self.budget - self.system_tokens - tokens))
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + tokens)

    def close(self) -> Iterator[tuple]:
        if len(self.turns) > self.n_old or (self.system and not self.n):
            yield self.window()


def format_conversations(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, ranks: str | None = None
) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` to windows: ``conv_id`` and ``WINDOWS``.

    ``loss`` holds the spans of ``text``, in code points, that are learnt. The system turn
    of later windows and the history are not. ``n_tokens`` counts the tokens of ``text``,
    marks and escapes included; it exceeds ``budget`` only where one new turn, with the
    system turn, does. Windows of a conversation follow each other in one partition.
    """
    ordered = (
        turns.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = Tokens(ranks)
        shared = encoder.count(END[-1]) + encoder.count(TURN[0]) - encoder.count(END[-1] + TURN[0])
        cutter = key = None
        for part in pieces(batches, "conv_id", "role", "text"):
            for own, role, text in zip(*part):
                if cutter is None or own != key:
                    if cutter:
                        yield from ((key, *row) for row in cutter.close())
                    cutter, key = Cutter(budget, history, shared), own
                tokens = encoder.count(marked(role, text))
                yield from ((key, *row) for row in cutter.add(role, text, tokens))
        if cutter:
            yield from ((key, *row) for row in cutter.close())

    return map_rows(ordered, f"conv_id {kind}, {WINDOWS}", run)


class Reader:
    """The windows of one conversation, read in order."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.formatted = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, n_old: int, text: str, loss: list[dict[str, int]]) -> None:
        self.formatted += len(text)
        for place, found in enumerate(_TURNS.finditer(text)):
            if place >= n_old:
                role, body = map(unescape, found.groups())
                self.n_turns += 1
                self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        for span in loss:
            body = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(body)
            self.loss.update(body.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (
            self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.formatted,
        )


def read_back(windows: DataFrame, adjacent: bool = False) -> DataFrame:
    """Per conversation, from its windows alone: turns, learnt text, and their hashes.

    Windows that come straight from :func:`format_conversations` are ``adjacent``; then
    they need not be shuffled.
    """
    ordered = windows
    if not adjacent:
        ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window_no")
    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader = key = None
        names = ("conv_id", "window_no", "n_system", "n_history", "text", "loss")
        for part in pieces(batches, *names):
            for own, window, n_system, n_history, text, loss in zip(*part):
                if reader is None or own != key:
                    if reader:
                        yield key, *reader.row()
                    reader, key = Reader(), own
                reader.read(n_system * (window > 0) + n_history, text, loss)
        if reader:
            yield key, *reader.row()

    return map_rows(ordered, schema, run)
