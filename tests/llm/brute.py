"""Plain readings of the operators' contracts, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(rows):
    """(id, text) rows: id -> (keep, size, kept, digest) for rows with distinct ids."""
    plain = {key: re.sub(r"[\x20\x09-\x0D]", "", text or "") for key, text in rows}
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[plain[key]].append((-len(text or ""), key))
    return {
        key: (
            min(groups[plain[key]])[1],
            len(groups[plain[key]]),
            min(groups[plain[key]])[1] == key,
            hashlib.sha256(plain[key].encode()).hexdigest(),
        )
        for key, _ in rows
    }


def luhn(digits):
    total = 0
    for place, digit in enumerate(digits[::-1]):
        value = int(digit) * (1 + place % 2)
        total += value if value < 10 else value - 9
    return total % 10 == 0


def personal(text):
    """Spans of the base kinds by plain regular expressions."""
    digits = lambda found: re.sub("[^0-9]", "", found)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            lambda m: all(int(part) <= 255 for part in m.split(".")),
        ),
        "card": (
            r"[0-9]([\x20-]?[0-9])+",
            lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)),
        ),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {
        kind: [m.span() for m in re.finditer(rule, text) if valid(m[0])]
        for kind, (rule, valid) in rules.items()
    }


def quality(text):
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for at in range(len(words) - 4):
        windows[tuple(words[at : at + 5])].append(at)
    repeated = {at + i for found in windows.values() if len(found) > 1 for at in found for i in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        n < 10 or 100 * len(repeated) > 20 * n,
    )


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    """Distinct fingerprints to the least one that links reach."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                a_root, b_root = root(a), root(b)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return {v: root(v) for v in values}


def near(rows):
    """(id, text) rows with distinct ids: id -> (fingerprint, component)."""
    prints = {key: fingerprint(text or "") for key, text in rows}
    of = components(prints.values())
    least = {}
    for key, value in prints.items():
        least[of[value]] = min(key, least.get(of[value], key))
    return {key: (f"{value:016x}", least[of[value]]) for key, value in prints.items()}


def repeats(texts):
    """Per text: bytes, bytes removed, runs removed, hash of the rest."""
    raw = [text.encode() for text in texts]
    counts = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        runs = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        rest = bytes(c for c, x in zip(b, gone) if not x)
        out.append((len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5
