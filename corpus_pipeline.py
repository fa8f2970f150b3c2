"""The corpus pipeline: raw documents to packed sequences, each stage a written table.

``STAGES`` names the stages in order. Each takes the session, the documents that its
predecessor kept and the folder of the tables. All but the last return documents, with
the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfgauge.llm import exact_dedup, mixing, packing, quality_rules, simhash
from shelfgauge.llm.common import from_files, store, table


def clean_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that failed."""
    return quality_rules.clean(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One of each group of texts whose fingerprints are linked."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, in the order in which their sources take turns."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents, their token ids and their places in sequences."""
    return packing.pack(docs, files=from_files(docs))


STAGES = [
    ("quality rules", clean_lines),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_windows),
]

#: Fingerprints and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
