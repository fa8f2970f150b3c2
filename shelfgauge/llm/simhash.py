"""SimHash near-dedup (6): covering masks find every pair of close fingerprints.

The fingerprint of a text is the bitwise majority of the hashes of its word shingles.
Two fingerprints are linked if at most ``RADIUS`` of their 64 bits differ. Each bit gets
a vector of ``RADIUS + 1`` bits, and each non-zero vector v a mask of the bits whose
vector is not orthogonal to v. Any ``RADIUS`` vectors leave some v orthogonal to them
all, so every linked pair agrees on some mask: equality on one of 31 masks finds all
links, without chance.

Only distinct fingerprints are compared, and each bucket of a mask yields a forest of its
links, never all pairs. In a large bucket, fingerprints meet at midpoints: two are within
four bits exactly if some value is within two bits of both, and a midpoint has at most a
few hundred values around it, so this is linear however large the bucket. Components
come from rounds of star contraction, each round a written table.

Null texts count as empty; a text without words has fingerprint zero and is linked like
any other. Fewer words than a shingle make one shingle. Rows with null or repeated ids
are linked by their texts; a component of null ids alone has a null component id. An
empty table gives an empty result. Other columns make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shelfgauge.llm.common import map_rows, numbered, pieces, store, whole

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Buckets of more fingerprints meet at midpoints; smaller ones are compared in memory.
LARGE = 1024
#: Fingerprints of more than one in so many rows are frequent: there are fewer than that.
FREQUENT = 1000
#: Hashes whose bits are summed at once.
CHUNK = 1 << 16


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask per non-zero vector; bits take the vectors in turn."""
    vectors = range(1, 1 << (radius + 1))
    own = [vectors[bit % len(vectors)] for bit in range(bits)]
    return [sum(1 << b for b in range(bits) if (own[b] & v).bit_count() & 1) for v in vectors]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bitwise majority of the shingles' hashes, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1]]
    stops = ends[len(words) - n :]
    ones = np.zeros(BITS, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        some = zip(starts[at : at + CHUNK], stops[at : at + CHUNK])
        hashes = np.array([hashed(joined[a : b - 1], SEED) for a, b in some], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and the signed fingerprint ``fp`` of each row."""
    narrow = docs.select(*keep, whole(text).alias("whole_text"))
    names = [field for field in narrow.schema if field.name != "whole_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in names), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in pieces(batches, *keep, "whole_text"):
            for *kept, value in zip(*part):
                yield *kept, _signed(fingerprint(value))

    return map_rows(narrow, schema, run)


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(values: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint under each mask: ``mask, key, fp``."""
    cut = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(mask))) for mask in masks))
    return values.select("fp", F.posexplode(cut).alias("mask", "key"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Stars from the smallest member of each linked group of a bucket."""
    for (buckets,) in pieces(batches, "members", rows=32):
        for bucket in buckets:
            values = np.array(sorted(bucket), np.int64)
            bits = values.view(np.uint64)
            near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS
            label = np.arange(len(values))
            while True:
                lower = np.where(near, label[None, :], len(values)).min(axis=1)
                lower = lower[lower]
                if (lower == label).all():
                    break
                label = lower
            for at in np.flatnonzero(label != np.arange(len(values))):
                yield int(values[label[at]]), int(values[at])


def _midpoints(hot: DataFrame, masks: list[int]) -> DataFrame:
    """Links within large buckets: stars around every value within two bits of members."""
    flips = []
    for mask in masks:
        free = [b for b in range(BITS) if not mask >> b & 1]
        some = [(), *combinations(free, 1), *combinations(free, 2)]
        flips.append([_signed(sum(1 << b for b in picked)) for picked in some])
    by_mask = store(
        hot.sparkSession.createDataFrame(list(enumerate(flips)), "mask int, flips array<long>"),
        "flips",
    )
    return (
        hot.join(F.broadcast(by_mask), "mask")
        .select("mask", "fp", F.explode("flips").alias("flip"))
        .select("mask", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
        .groupBy("mask", "middle")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a < b")
    )


def links(values: DataFrame, large: int = LARGE) -> DataFrame:
    """Forests ``a < b`` that join exactly the linked groups of distinct fingerprints ``fp``."""
    masks = covering_masks()
    keys = _keys(values, masks)
    buckets = store(
        keys.groupBy("mask", "key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where((F.col("n") > 2) | ((F.col("n") == 2) & (_differ(F.col("a"), F.col("b")) <= RADIUS))),
        "buckets",
    )
    pairs = buckets.where("n = 2").select("a", "b")
    small = (
        keys.join(buckets.where(f"n between 3 and {large}").select("mask", "key"), ["mask", "key"])
        .groupBy("mask", "key")
        .agg(F.collect_list("fp").alias("members"))
        .select("members")
    )
    small = map_rows(small, "a long, b long", _forest)
    hot = keys.join(buckets.where(f"n > {large}").select("mask", "key"), ["mask", "key"])
    return pairs.union(small).union(_midpoints(hot, masks)).distinct()


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Per linked node ``b`` other than the least of its component: that least node ``a``.

    Ends when no node is both a centre and a member, which is when all trees are stars.
    """
    edges = store(edges, "links")
    while True:
        edges = store(_smaller_to_least(_larger_to_least(edges)), "links")
        centres, members = edges.select(F.col("a").alias("node")), edges.select(F.col("b").alias("node"))
        twice = edges.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
        if members.join(centres, "node", "left_semi").isEmpty() and twice.isEmpty():
            return edges


def components(rows: DataFrame) -> DataFrame:
    """Rows of ``fp, doc_id, ...`` with ``root``, the least fingerprint of the component, and
    ``component_id``, the least id that links reach.

    Rows of frequent fingerprints get them where they are read, the others by a shuffle.
    """
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    values = store(values, "fingerprints")
    total = values.agg(F.sum("n")).first()[0] or 0
    tree = stars(links(values.select("fp")))
    linked = tree.union(tree.select("a", F.col("a").alias("b")).distinct())
    linked = linked.join(values, linked.b == values.fp).select("a", "fp", "least_id")
    roots = linked.groupBy("a").agg(F.min("least_id").alias("component_id"))
    found = linked.select("a", "fp").join(roots, "a")
    alone = F.col("a").isNull()
    named = values.join(found, "fp", "left").select(
        "fp",
        F.coalesce("a", "fp").alias("root"),
        F.when(alone, F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("n") * FREQUENT > total).alias("often"),
    )
    named = store(named, "components")
    often, seldom = (named.where(f).drop("often") for f in ("often", "not often"))
    frequent = rows.join(F.broadcast(often), "fp")
    others = rows.join(F.broadcast(often.select("fp")), "fp", "left_anti").join(seldom, "fp")
    return frequent.unionByName(others)


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, fingerprint, component_id``."""
    rows = store(
        fingerprints(docs.select(F.col(doc_id).alias("doc_id"), text), text, "doc_id"), "documents-fp"
    )
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return components(rows).select("doc_id", shown, "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, that with the least id, with its columns.

    What goes is decided on narrow rows and written, so that Spark knows its size: where it
    is small it is broadcast and no text moves.
    """
    kept = numbered(docs.select(F.struct("*").alias("doc")), "documents")
    narrow = kept.select(
        "row",
        F.col("doc").getField(doc_id).alias("doc_id"),
        F.col("doc").getField(text).alias("text"),
    )
    rows = store(fingerprints(narrow, "text", "row", "doc_id"), "documents-fp")
    found = store(components(rows).select("root", "doc_id", "row"), "documents-root")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    stay = found.groupBy("root").agg(best.alias("best")).select("best.row")
    gone = store(found.join(stay, "row", "left_anti").select("row"), "near-copies")
    return kept.join(gone, "row", "left_anti").select("doc.*")
