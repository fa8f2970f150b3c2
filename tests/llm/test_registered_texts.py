"""The registered queries: names, columns, and their SQL where there is some."""

import pytest
from oracle_check import differences

from shelfgauge.llm.oracles import ORACLES
from shelfgauge.llm.queries import QUERIES

COLUMNS = {
    1: "doc_id keep_id group_size kept text_sha256",
    2: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    3: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    4: "page_id payload_bytes payload_digest record_type refers_to",
    5: "doc_id held_out score predicted",
    6: "doc_id fingerprint component_id",
    7: "doc_id n_bytes n_removed n_spans kept_sha256",
    8: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    9: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    10: "doc_id source slot",
    11: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    12: "doc_id n_words n_removed kept_sha256",
    13: "word form root n n_near form_n",
}


def test_entry_points_register_the_queries():
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, folder, name):
    df = QUERIES[name](spark, folder)
    number = int(name[2:].split("_")[0])
    assert set(COLUMNS[number].split()) <= set(df.columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), folder, ORACLES[name]) == ""
