"""Conversation prefix trie (11): balanced parentheses per shard, shared spines merged.

A conversation is the sequence of the digests of its turns (role and text, 128 bits).
Sorted by these sequences, conversations come in the order in which a walk through the
trie of their prefixes meets them, so a range of them is a shard with a trie of its own.
A shard writes that trie as balanced parentheses; blocks of the running excess with
their least values, and a tree of minima over the blocks, give the closing parenthesis
of every node at once (``find_close``). It delimits the node's subtree: members and
savings are differences of cumulative arrays, leaves are ranks of the pairs ``()``.

A node that several shards have is a prefix of a shard's first or last sequence: it lies
on its left or right spine. Nodes elsewhere are final. Spines go on as strands, with what
hangs beside them summed up for each of their nodes, and are put together ``FAN`` shards
at a time by the same code until one group is left. Ids of the conversations that end at
a spine node are hashed from each shard's part of them, in order.

Rows are turns in order of ``turn`` (nulls first, ties by digest). Null roles and texts
count as empty, equal rows are turns like others, and rows with a null conversation id
belong to no conversation. An empty table has no nodes. Other columns make no
difference. The digests of one conversation (24 bytes a turn) must fit in a task; texts
of any length are read once, in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfgauge.llm.common import map_rows, pieces, store, whole

#: Turns of a shard, about, and shards whose spines meet in one task.
SHARD = 200_000
FAN = 256
#: Parentheses of a block.
BLOCK = 256
_WIDTH = 16
_NONE = np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()

#: What belongs to a strand's nodes beside the spine, an entry for each depth.
_BESIDE = ("n", "least", "kids", "leaves", "saved")
_STRAND = "path binary, words array<long>, " + ", ".join(f"{name}_here array<long>" for name in _BESIDE)
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
#: Rows of four kinds: final nodes, strands, parts of spine nodes' ends, keys of spine nodes.
_OUT = f"kind int, shard long, {_NODE}, key binary, parent_key binary, side int, {_STRAND}, ids string"


# --- balanced parentheses -----------------------------------------------------------


def find_close(parens: np.ndarray) -> np.ndarray:
    """The place of the closing parenthesis for each opening one (1 opens, 0 closes)."""
    excess = np.cumsum(parens.astype(np.int64) * 2 - 1)
    opens = np.flatnonzero(parens)
    wanted = excess[opens] - 1
    n_blocks = -(-len(parens) // BLOCK)
    padded = np.full(n_blocks * BLOCK, _NONE, np.int64)
    padded[: len(excess)] = excess
    size = 1 << max(0, (n_blocks - 1)).bit_length()
    least = np.full(2 * size, _NONE, np.int64)
    least[size : size + n_blocks] = padded.reshape(n_blocks, BLOCK).min(axis=1)
    for at in range(size - 1, 0, -1):
        least[at] = min(least[2 * at], least[2 * at + 1])
    close = np.full(len(opens), -1, np.int64)
    open_ones = _scan(padded, wanted, close, np.arange(len(opens)), opens + 1)
    if len(open_ones):
        node = opens[open_ones] // BLOCK + size
        target = wanted[open_ones]
        climbing = np.ones(len(node), bool)
        while climbing.any():  # up, until the next subtree of blocks holds the value
            found = (node & 1 == 0) & (least[np.minimum(node + 1, 2 * size - 1)] <= target) & climbing
            node = np.where(found, node + 1, np.where(climbing, node >> 1, node))
            climbing &= ~found
        while (going := node < size).any():  # down, to the first block that holds it
            left = np.where(going, 2 * node, node)
            node = np.where(going & (least[left] > target), left + 1, left)
        _scan(padded, wanted, close, open_ones, (node - size) * BLOCK)
    return close


def _scan(excess: np.ndarray, wanted: np.ndarray, close: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Look through the rest of each block; returns those not found there."""
    lost = []
    while len(asked):
        inside = (at < len(excess)) & ((at % BLOCK > 0) | (close[asked] == -1))
        found = inside & (excess[np.minimum(at, len(excess) - 1)] == wanted[asked])
        close[asked[found]] = at[found]
        at = at + 1
        over = ~found & ((at % BLOCK == 0) | (at >= len(excess)))
        lost.append(asked[over])
        going = ~found & ~over
        asked, at = asked[going], at[going]
    return np.concatenate(lost) if lost else asked


def common_turns(a: bytes, b: bytes) -> int:
    """How many digests two sequences share at their beginning, by halving."""
    low, high = 0, min(len(a), len(b)) // _WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * _WIDTH : middle * _WIDTH] == b[low * _WIDTH : middle * _WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def prefix_keys(path: bytes) -> list[bytes]:
    """A digest of each prefix, the empty one first."""
    state = hashlib.md5()
    keys = [state.digest()]
    for at in range(0, len(path), _WIDTH):
        state.update(path[at : at + _WIDTH])
        keys.append(state.digest())
    return keys


class Shard:
    """The trie of sequences that come in order; nodes are numbered as their parentheses open."""

    def __init__(self) -> None:
        self.parens = bytearray(b"\1")
        self.first = self.path = None
        self.chain = [0]
        self.depth, self.parent, self.words = [0], [-1], [0]
        self.beside = {name: [_NONE if name == "least" else 0] for name in _BESIDE}
        self.ends: list[tuple[int, list[int]]] = []
        self.strands_in: list[tuple[list[int], bytes]] = []

    def _open(self, path: bytes, words: list[int]) -> None:
        deep = len(path) // _WIDTH
        keep = 0
        if self.first is None:
            self.first = path
        else:
            keep = common_turns(self.path, path)
            self.parens += b"\0" * (len(self.path) // _WIDTH - keep)
        new = range(len(self.depth), len(self.depth) + deep - keep)
        self.parens += b"\1" * len(new)
        if new:
            self.parent += [self.chain[keep], *new[:-1]]
            self.depth += range(keep + 1, deep + 1)
            self.words += words[keep:]
            for name, values in self.beside.items():
                values += [_NONE if name == "least" else 0] * len(new)
        self.chain[keep + 1 :] = new
        self.path = path

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        """A conversation, after all that come before it by path and id."""
        self._open(path, words)
        node = self.chain[-1]
        self.beside["n"][node] += 1
        self.beside["least"][node] = min(self.beside["least"][node], conv_id)
        if not self.ends or self.ends[-1][0] != node:
            self.ends.append((node, []))
        self.ends[-1][1].append(conv_id)

    def add_strand(self, path: bytes, words: list[int], beside: dict[str, list[int]]) -> None:
        """A spine of a smaller shard; the shard's left one comes before its right one."""
        self._open(path, words)
        self.strands_in.append((list(self.chain), path))
        for name, values in beside.items():
            own = self.beside[name]
            for node, value in zip(self.chain, values):
                own[node] = min(own[node], value) if name == "least" else own[node] + value

    def close(self, last: bool) -> None:
        """Work out all nodes; if it is the ``last`` shard of all, no node is on a spine."""
        parens = np.frombuffer(bytes(self.parens) + b"\0" * (len(self.path) // _WIDTH + 1), np.uint8)
        opens = np.flatnonzero(parens)
        until = np.arange(len(opens)) + (find_close(parens) - opens + 1) // 2

        def within(values: np.ndarray) -> np.ndarray:
            """Sums over each node's subtree."""
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[until] - sums[: len(values)]

        self.depth, self.parent, self.words = (np.array(x, np.int64) for x in (self.depth, self.parent, self.words))
        beside = {name: np.array(values, np.int64) for name, values in self.beside.items()}
        n_left = len(self.first) // _WIDTH + 1
        self.left, self.right = np.arange(n_left), np.array(self.chain)
        self.spine = np.zeros(len(opens), bool)
        if not last:
            self.spine[self.left] = self.spine[self.right] = True
        self.n = within(beside["n"])
        self.kids = np.bincount(self.parent[1:], minlength=len(opens)) + beside["kids"]
        pair = parens[opens + 1] == 0
        self.leaves = within((pair & (beside["kids"] == 0) & ~self.spine) + beside["leaves"])
        self.saved = within(np.where(self.spine, 0, (self.n - 1) * self.words) + beside["saved"])
        self.least = beside["least"]
        order = np.argsort(self.depth, kind="stable")
        bounds = np.searchsorted(self.depth[order], np.arange(self.depth.max() + 2))
        for deep in range(len(bounds) - 2, 0, -1):  # smallest members, from the deepest nodes up
            nodes = order[bounds[deep] : bounds[deep + 1]]
            nodes = nodes[~self.spine[nodes]]
            np.minimum.at(self.least, self.parent[nodes], self.least[nodes])

    def strands(self) -> Iterator[dict]:
        """The spines, with what is beside them."""
        on_spine = np.flatnonzero(self.spine)[1:]
        here = {"n": self.n.copy(), "kids": self.kids.copy(), "leaves": self.leaves.copy(), "saved": self.saved.copy()}
        for name, values in here.items():
            taken = np.ones(len(on_spine), np.int64) if name == "kids" else getattr(self, name)[on_spine]
            np.subtract.at(values, self.parent[on_spine], taken)
        here["least"] = self.least
        both = [self.left] if self.first == self.path else [self.left, self.right]
        for side, nodes in enumerate(both):
            row = {"side": side, "path": (self.first, self.path)[side], "words": self.words[nodes][1:]}
            told = nodes < len(self.left) if side else np.zeros(len(nodes), bool)
            for name in _BESIDE:
                nothing = _NONE if name == "least" else 0
                row[f"{name}_here"] = np.where(told, nothing, here[name][nodes])
            yield row

    def spine_keys(self) -> dict[int, bytes]:
        """Keys of the spine's nodes."""
        keys = dict(zip(self.left.tolist(), prefix_keys(self.first)))
        return keys | dict(zip(self.right.tolist(), prefix_keys(self.path)))


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.field("element", pa.int64())),
}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (column.split() for column in _OUT.split(", "))])


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch with the given columns; the others are null."""
    arrays = [
        pa.array(columns[field.name], field.type) if field.name in columns else pa.nulls(n, field.type)
        for field in _ARROW
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _final(shard: Shard, own: int, keys: dict[int, bytes], ends: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The nodes that no other shard has. Nodes whose parent is on the spine name its key."""
    nodes = np.flatnonzero(~shard.spine)
    for at in range(0, len(nodes), 50_000):
        some = nodes[at : at + 50_000]
        parent = shard.parent[some]
        away = (parent >= 0) & shard.spine[parent]
        yield _rows(
            len(some),
            kind=np.zeros(len(some), np.int32),
            shard=np.full(len(some), own),
            conv_id=shard.least[some],
            depth=shard.depth[some],
            parent_conv_id=pa.array(shard.least[parent], mask=away | (parent < 0)),
            n_convs=shard.n[some],
            n_children=shard.kids[some],
            n_leaves=shard.leaves[some],
            saved_tokens=shard.saved[some],
            ends_sha256=[ends[i] for i in some] if ends else pa.nulls(len(some), pa.string()),
            key=[keys.get(i) for i in some.tolist()],
            parent_key=[keys[p] if far else None for p, far in zip(parent.tolist(), away)],
        )


def _strand_rows(shard: Shard, own: int) -> Iterator[pa.RecordBatch]:
    for row in shard.strands():
        yield _rows(1, kind=[1], shard=[own], **{name: [value] for name, value in row.items()})


def _leaf_shard(shard: Shard, own: int) -> Iterator[pa.RecordBatch]:
    """What a shard of conversations gives."""
    shard.close(last=False)
    keys = shard.spine_keys()
    ends = [_NO_ENDS] * len(shard.depth)
    for node, ids in shard.ends:
        if shard.spine[node]:
            yield _rows(1, kind=[2], shard=[own], key=[keys[node]], ids=[_joined(ids)])
        else:
            ends[node] = hashlib.sha256(_joined(ids).encode()).hexdigest()
    yield from _final(shard, own, keys, ends)
    yield from _strand_rows(shard, own)
    told = sorted(set(keys.values()))
    yield _rows(len(told), kind=[3] * len(told), shard=[own] * len(told), key=told)


def _shards(sequences: DataFrame, size: int) -> DataFrame:
    """All rows of the lowest shards, written."""
    turns = sequences.agg(F.sum(F.octet_length("path") / _WIDTH + 1)).first()[0] or 0
    ordered = sequences.repartitionByRange(max(1, -(-int(turns) // size)), "path", "conv_id")
    ordered = ordered.sortWithinPartitions("path", "conv_id").withColumn(
        "shard", F.spark_partition_id().cast("long")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = Shard(), None
        for part in pieces(batches, "shard", "conv_id", "path", "words", rows=1000):
            for own, *row in zip(*part):
                shard.add(*row)
        if own is not None:
            yield from _leaf_shard(shard, own)

    return store(ordered.mapInArrow(run, _OUT), "trie-shards")


def _merged(strands: DataFrame, fan: int, last: bool) -> DataFrame:
    """Groups of ``fan`` shards put together, written; rows as those of :func:`_shards`."""
    grouped = strands.withColumn("group", F.expr(f"shard div {fan}"))
    ordered = grouped.repartition("group").sortWithinPartitions("group", "shard", "side")
    names = [f"{name}_here" for name in _BESIDE]

    def finished(shard: Shard, own: int) -> Iterator[pa.RecordBatch]:
        shard.close(last)
        keys = _all_keys(shard)
        yield from _final(shard, own, keys)
        if not last:
            yield from _strand_rows(shard, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = own = None
        for part in pieces(batches, "group", "path", "words", *names, rows=16):
            for group, path, words, *beside in zip(*part):
                if group != own:
                    if shard:
                        yield from finished(shard, own)
                    shard, own = Shard(), group
                shard.add_strand(path, words, dict(zip(_BESIDE, beside)))
        if shard:
            yield from finished(shard, own)

    return store(ordered.mapInArrow(run, _OUT), "trie-spines")


def _all_keys(shard: Shard) -> dict[int, bytes]:
    """Keys of all nodes of a shard made of strands."""
    keys: dict[int, bytes] = {}
    for chain, path in shard.strands_in:
        if any(node not in keys for node in chain):
            keys |= zip(chain, prefix_keys(path))
    return keys


def _end_hashes(parts: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of spine nodes, from the shards' parts in order; streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = state = None
        for part in pieces(batches, "key", "ids", rows=16):
            for key, ids in zip(*part):
                if key != held:
                    if state:
                        yield held, state.hexdigest()
                    held, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
        if state:
            yield held, state.hexdigest()

    ordered = parts.repartition("key").sortWithinPartitions("key", "shard")
    return map_rows(ordered, "key binary, ends_sha256 string", run)


def trie(sequences: DataFrame, size: int = SHARD, fan: int = FAN) -> DataFrame:
    """Nodes of the trie of ``conv_id, path, words``: digests end to end, words of each turn."""
    low = _shards(sequences, size)
    strands = low.where("kind = 1")
    n_shards = (low.agg(F.max("shard")).first()[0] or 0) + 1
    tops = []
    while True:
        n_shards = -(-n_shards // fan)
        level = _merged(strands, fan, last=n_shards == 1)
        tops.append(level.where("kind = 0"))
        if n_shards == 1:
            break
        strands = level.where("kind = 1")
    spine = tops[0]
    for top in tops[1:]:
        spine = spine.unionByName(top)
    named = store(spine.select("key", F.col("conv_id").alias("spine_conv")), "spine-ids")
    columns = [name.split()[0] for name in _NODE.split(", ")]

    def with_parent(nodes: DataFrame, told: DataFrame, on: list[str]) -> DataFrame:
        parents = told.withColumnRenamed("key", "parent_key")
        found = nodes.join(parents, on, "left")
        return found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "spine_conv")).select(*columns)

    ends = _end_hashes(low.where("kind = 2").select("key", "shard", "ids"))
    spine = spine.drop("ends_sha256").join(ends, "key", "left")
    spine = spine.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    # A shard's own list of spine nodes spreads the children of a node that all shards have.
    links = low.where("kind = 3").select("shard", "key").join(named, "key")
    nodes = low.where("kind = 0")
    return (
        nodes.where("parent_key is null").select(*columns)
        .unionByName(with_parent(nodes.where("parent_key is not null"), links, ["shard", "parent_key"]))
        .unionByName(with_parent(spine, named, ["parent_key"]))
    )


# --- conversations ------------------------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """Hexadecimal; the role's length keeps role and text apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def gathered(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: per conversation its turns' digests and words, in order."""
    role, text = whole("role"), whole("text")
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            turn_digest(role, text).alias("digest"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        ).alias("at"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that begin with the first turns of another one.

    Conversation c gets the first h turns of c - c % ``every``, then its own after its
    first h, where h is the checksum of c modulo ``heads``.
    """
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    found = gathered(turns).select("conv_id", base, "turns")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, max(1, heads - 1))))
    n_head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    headed = found.select(
        "conv_id",
        "turns",
        n_head.alias("h"),
        F.coalesce(head.over(Window.partitionBy("base")), F.slice("turns", 1, 0)).alias("head"),
    )
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return headed.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), own).alias("turns"))


def prefix_trie(conversations: DataFrame, size: int = SHARD, fan: int = FAN) -> DataFrame:
    """Nodes of the trie of ``conv_id, turns`` as :func:`gathered` gives them."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    words = F.transform("turns", lambda t: t["words"])
    narrow = conversations.select("conv_id", path.alias("path"), words.alias("words"))
    return trie(store(narrow, "conversation-paths"), size, fan)
