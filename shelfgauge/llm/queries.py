"""The registered queries: every operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfgauge.llm import (
    chat, exact_dedup, mixing, packing, pii, prefix_trie, quality_model, quality_rules, simhash, spelling,
    substring_dedup, suffix_dedup, warc,
)
from shelfgauge.llm.common import table


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_spans(table(spark, folder, "documents")).drop("redacted")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_lines(table(spark, folder, "documents"))


def op5_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_model.score_quality(docs, labels)


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.write_archive(table(spark, folder, "pages"))
    return warc.read_archive(index).drop("payload", "record_id")


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    turns = turns.unionByName(spark.createDataFrame(extra, turns.schema))
    return chat.read_back(chat.format_conversations(turns), adjacent=True)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), files=True).drop("ids")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in blocks of 16, each source to the root of its size."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mixing.schedule(docs).select("doc.*", "block", "phase", "slot", "place", "weight")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, folder, "conversations")))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_passages(table(spark, folder, "documents")).drop("kept")


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_quality_model": op5_quality_model,
    "op6_simhash": op6_simhash,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_chat": op8_chat,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling": op13_spelling,
}
