"""Exact dedup (1): frequent digests apart, the rest through one shuffle.

A Misra-Gries sketch (Spark's frequent-items aggregate) names the digests that may be
frequent. Their groups are counted exactly, with partial sums before the shuffle, and
the rows that stay are broadcast, so that frequent copies are decided where they are
read. Whatever the sketch does not name is rare: a group of it holds at most a few
ten-thousandths of all rows and takes an ordinary shuffle.

Null texts count as empty, and so do texts of white space alone. Null ids sort after
all others. Of rows that agree in text and id exactly one stays, whichever. An empty
table gives an empty result. Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfgauge.llm.common import SPACE, numbered, store, whole

#: Counters of the sketch; at most so many groups are broadcast.
COUNTERS = 10_000
#: Sketches are merged in so many groups before the last merge.
MERGERS = 256


def normalised(text: str) -> Column:
    """The text without white space; equal texts have equal normal forms."""
    out = whole(text)
    for character in SPACE:
        out = F.replace(out, F.lit(character), F.lit(""))
    return out


def digest(text: str) -> Column:
    return F.sha2(normalised(text), 256)


def _rank(doc_id: str) -> Column:
    """Order within a group; the smallest stays."""
    return F.struct(
        (-F.col("size")).alias("size"),
        F.col(doc_id).isNull().alias("no_id"),
        F.col(doc_id).alias("id"),
        F.col("row").alias("row"),
    )


def frequent_digests(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """64-bit hashes of all digests that may be frequent, at most ``counters`` rows."""
    state = f"approx_top_k_accumulate(hash, {counters})"
    merge = f"approx_top_k_combine(state, {counters})"
    return (
        keys.select(
            F.xxhash64("digest").alias("hash"),
            (F.spark_partition_id() % MERGERS).alias("part"),
        )
        .groupBy("part")
        .agg(F.expr(state).alias("state"))
        # By a key, since a task without rows would hand on a sketch without a type.
        .groupBy(F.pmod("part", F.lit(1)).alias("all"))
        .agg(F.expr(merge).alias("state"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(state, {counters})")).alias("found"))
        .select(F.col("found.item").alias("hash"))
    )


def _winners(keys: DataFrame, counters: int) -> DataFrame:
    """The exact size and the row that stays of each frequent group; at most ``counters`` rows.

    Two digests may share a hash, so the full digest is what groups.
    """
    frequent = frequent_digests(keys, counters)
    return store(
        keys.withColumn("hash", F.xxhash64("digest"))
        .join(F.broadcast(frequent), "hash", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min("rank").alias("best"))
        .where("group_size > 1"),
        "frequent-digests",
    )


def _keys(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One narrow row per document, written once: number, id, size and digest."""
    narrow = docs.select(
        F.col(doc_id).alias("id"), F.length(whole(text)).alias("size"), digest(text).alias("digest")
    )
    return numbered(narrow, "digests").withColumn("rank", _rank("id"))


def mark_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the one with the most code points stays, then the smallest id.
    """
    keys = _keys(docs, text, doc_id)
    winners = F.broadcast(_winners(keys, counters))
    named = (
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    frequent = keys.join(winners, "digest").select(*named)
    group = Window.partitionBy("digest")
    rare = (
        keys.join(winners, "digest", "left_anti")
        .withColumn("best", F.min("rank").over(group))
        .withColumn("group_size", F.count("*").over(group))
        .select(*named)
    )
    return frequent.unionByName(rare)


def drop_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Frequent copies go where they are read; the others move once, with their texts.
    """
    winners = F.broadcast(_winners(_keys(docs, text, doc_id), counters))
    packed = docs.select(
        F.struct("*").alias("doc"),
        F.col(doc_id).alias("id"),
        F.length(whole(text)).alias("size"),
        digest(text).alias("digest"),
    )
    same = (F.col("best.size") == -F.col("size")) & F.col("best.id").eqNullSafe(F.col("id"))
    frequent = packed.join(winners, "digest").where(same).dropDuplicates(["digest"])
    order = Window.partitionBy("digest").orderBy(F.desc("size"), F.col("id").asc_nulls_last())
    rare = (
        packed.join(winners, "digest", "left_anti")
        .withColumn("place", F.row_number().over(order))
        .where("place = 1")
    )
    return frequent.select("doc.*").unionByName(rare.select("doc.*"))
