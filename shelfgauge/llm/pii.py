"""Personal data (2): anchors found in one pass, spans grown from them by local parsers.

One automaton finds every at-sign, plus sign, digit, scheme and identifier cue of a
text. Each anchor goes to the parser of its kind, which looks only at the characters
around it, expands to the boundaries of an email address, network address, card,
phone number, credential or account number, and validates what it found.

Every part of a text is parsed a bounded number of times, so very long texts take
linear time. Null texts count as empty and have no spans; null and repeated ids are
carried through, a row each; other columns do not matter to the spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfgauge.llm.common import map_rows, pieces, whole

#: Kinds in the order in which spans are listed; the first four are the base ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")

#: Words that announce an identifier.
CUES = (
    "access key", "access-key", "access_key", "accesskey",
    "account", "acct", "api key", "api-key", "api_key", "apikey", "iban", "passport",
    "passwd", "password", "pwd", "secret", "secret access key", "secret key", "secret-key",
    "secret_access_key", "secret_key", "secretkey", "ssn", "token",
)

#: Cues are found in any case; the lower-cased copy has the length of the text.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.:-]+")
_ACCOUNT = re.compile(
    r"""["']?(?: ?(?:no\.?|number|id))?[ ]?(?:[:=]+>?|is|#)[ ]?["']?((?:[A-Za-z0-9_./+-]+)(?: [0-9A-Z]{2,4}(?![A-Za-z0-9]))*)"""
)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, (sign, 1))
    found.add_word("://", ("://", 3))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def _octet(digits: str) -> bool:
    """At most 255, with any number of zeros before."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _account(text: str, cue: int, end: int) -> tuple[int, int] | None:
    """The identifier after a cue: eight characters or more, a digit among them."""
    if (cue and text[cue - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return None
    found = _ACCOUNT.match(text, end)
    if not found:
        return None
    value = found[1].rstrip(".-/")
    if len(value) < 8 or not any(c in "0123456789" for c in value):
        return None
    return found.start(1), found.start(1) + len(value)


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, each in order; ends are exclusive."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)  # up to where each kind has used the text
    for last, (sign, width) in anchors.iter(text.lower() if text.isascii() else text.translate(_LOWER)):
        at = last - width + 1
        if sign == "@":
            start, low = at, done["email"]
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (domain := _DOMAIN.match(text, at + 1)):
                done["email"] = domain.end()
                spans["email"].append((start, domain.end()))
        elif sign == "+":
            if number := _PHONE.match(text, at):
                if 9 <= len(_NUMBER.findall(number[0])) <= 15:
                    spans["phone"].append(number.span())
        elif sign == "://":
            scheme = _SCHEME.search(text, max(done["login"], at - 16), at)
            if scheme and (login := _LOGIN.match(text, last + 1)):
                done["login"] = login.end()
                spans["login"].append((scheme.start(), login.end()))
        elif sign == "cue":
            if at >= done["account"] and (value := _account(text, at, last + 1)):
                done["account"] = value[1]
                spans["account"].append(value)
        else:
            if at >= done["card"] and (card := _CARD.match(text, at)):
                done["card"] = card.end()
                digits = card[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(card.span())
            if at >= done["ip"]:
                if address := _IP.match(text, at):
                    done["ip"] = address.end()
                    if all(map(_octet, address.groups())):
                        spans["ip"].append(address.span())
                else:  # no later start within these digits can match either
                    done["ip"] = _DIGITS.match(text, at).end()
    return spans


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans[kind])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with a tag in place of each span; of overlapping spans the first counts."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, kind) for kind in KINDS for s, e in spans[kind]):
        if end <= at:
            continue
        out += [text[at : max(at, start)], f"<{kind.upper()}>" if start >= at else ""]
        at = end
    return "".join((*out, text[at:]))


def find_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: id, counts of the base kinds, hash of the base spans, all spans, the others'
    counts, and the redacted text."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, n_login long, n_account long, redacted string"
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        anchors = _automaton()
        for ids, texts in pieces(batches, "doc_id", "text"):
            for key, value in zip(ids, texts):
                spans = find(value, anchors)
                base = hashlib.sha256(listed(spans, BASE).encode()).hexdigest()
                n = [len(spans[kind]) for kind in KINDS]
                yield key, *n[:4], base, listed(spans, KINDS), *n[4:], redacted(value, spans)

    return map_rows(narrow, schema, parse)
