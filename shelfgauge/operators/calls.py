"""Calling a model from tasks: a log of every answer, and one rate for all tasks.

Requests are dealt to shards, a task each. A task notes every answer in the log of its
shard as soon as it has it, and asks nothing that the log holds, so a task or a run that
starts again goes on where the last one stopped. The rate is shared out by the clock: a
minute has as many slots as calls are allowed, and the slots go round the shards.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs

#: Answers of a log file. Where a file system shows data only when a file is closed, a
#: task that is lost loses the answers since the last file.
ROLL = 100


class CallLog:
    """The answers of one shard, a line each, in files of the task attempts that got them."""

    def __init__(self, folder: str, shard: int, roll: int = ROLL) -> None:
        self.system, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.folder, self.roll = f"{path}/shard={shard}", roll
        self.stream, self.lines = None, 0

    def read(self) -> Iterator[dict]:
        """All answers that were noted to the end of their line, in any order."""
        found = self.system.get_file_info(pyarrow.fs.FileSelector(self.folder, allow_not_found=True))
        for file in sorted(info.path for info in found if info.is_file):
            with self.system.open_input_stream(file) as stream:
                held = b""
                while block := stream.read(1 << 20):
                    *lines, held = (held + block).split(b"\n")
                    yield from map(json.loads, lines)

    def write(self, answer: dict) -> None:
        if self.stream is None:
            self.system.create_dir(self.folder, recursive=True)
            self.stream = self.system.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
        self.stream.write(json.dumps(answer).encode() + b"\n")
        self.stream.flush()
        self.lines += 1
        if self.lines >= self.roll:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
        self.stream, self.lines = None, 0


class Slots:
    """The times at which a shard may call: its own slots of the clock that all tasks share."""

    def __init__(
        self,
        shard: int,
        shards: int,
        per_minute: float | None,
        clock: Callable[[], float] = time.time,
        sleep: Callable[[float], None] = time.sleep,
    ) -> None:
        self.shard, self.shards, self.clock, self.sleep = shard, shards, clock, sleep
        self.step = 60 / per_minute if per_minute else 0.0
        self.last = -1

    def wait(self) -> None:
        if not self.step:
            return
        least = max(math.ceil(self.clock() / self.step), self.last + 1)
        self.last = least + (self.shard - least) % self.shards
        while (left := self.last * self.step - self.clock()) > 0:
            self.sleep(left)


def answered(scorer: Callable[[str], str], request: str) -> tuple[str | None, str | None]:
    """The answer, or null and what went wrong. A failed call counts as an unusable answer."""
    try:
        answer = scorer(request)
        if answer is not None:
            answer.encode()  # text only, and text that can be stored
        return answer, None
    except Exception as failure:
        return None, f"{type(failure).__name__}: {failure}"


def ask(
    scorer: Callable[[str], str],
    attempt: int,
    folder: str,
    shards: int,
    pause: float = 0.0,
    per_minute: float | None = None,
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas`` over ``batch_id, n, request, shard``, shard by shard."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
        log = held = None
        known: set[int] = set()
        called = False
        for frame in frames:
            for batch_id, n, request, shard in zip(*(frame[c].tolist() for c in ("batch_id", "n", "request", "shard"))):
                if shard != held:
                    if log:
                        log.close()
                    log, held, known = CallLog(folder, shard), shard, set()
                    slots = Slots(shard, shards, per_minute)
                    for answer in log.read():
                        if answer["batch_id"] not in known:
                            known.add(answer["batch_id"])
                            yield answer
                if batch_id in known:
                    continue
                if called and pause:
                    time.sleep(pause)
                slots.wait()
                called = True
                raw, error = answered(scorer, request)
                answer = {"batch_id": batch_id, "n": n, "attempt": attempt, "raw": raw, "error": error}
                log.write(answer)
                yield answer
        if log:
            log.close()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for answer in rows(frames):
            held.append(answer)
            if len(held) >= ROLL:
                yield _frame(held)
                held = []
        if held:
            yield _frame(held)

    return run


def _frame(answers: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(answers, columns=["batch_id", "n", "attempt", "raw", "error"])
    return frame.astype({"raw": object, "error": object})
