"""Token ids of a public byte-level vocabulary."""

from __future__ import annotations

import base64
import json
import re

import numpy as np

#: Runs of white space that are cut out by hand: the splitting pattern backtracks through
#: a run and fails on one of about a million characters.
_LONG = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{50000,}")


class Tokens:
    """``encode(text)``: the ids as little-endian 32-bit numbers, no special tokens added.

    Reads the vocabulary as merge ranks, which gives the ids that the tokenizer file of
    the same vocabulary gives, several times as fast. Tokens that the file adds to the
    vocabulary, such as ``<|endoftext|>``, are one id where a text holds them, as there.
    Given ``ranks`` of another vocabulary have the added tokens of ``tokenizer``, if any.
    """

    def __init__(self, ranks: str | None = None, tokenizer: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        if ranks is None and tokenizer is None:
            tokenizer = public_tokenizers.path("byte_bpe_50k.json")
        added = {}
        if tokenizer is not None:
            with open(tokenizer, encoding="utf-8") as file:
                added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            pairs = (line.split() for line in file)
            merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.added = tuple(added)
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=added
        )

    def _ids(self, text: str) -> list[int]:
        ids, at = [], 0
        for run in _LONG.finditer(text):
            # The pattern leaves the last character of a run to what follows in the same stretch.
            end = run.end() - (run.end() < len(text) and not text.startswith(self.added, run.end()))
            ids += self.encoding.encode(text[at : run.start()], allowed_special="all")
            ids += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.encoding.encode(text[at:], allowed_special="all")

    def encode(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def count(self, text: str) -> int:
        return len(self._ids(text))
