"""Registered queries: SQL twins, whole tables, and their columns."""

import pytest

import __spark_entry__ as entry
from check import database, difference
from foliant.llm import oracle, queries
from tests.conftest import SMALL

COLUMNS = {
    "op1_html_extract": {"page_id", "url", "text", "n_chars"},
    "op2_warc_archive": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op4_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op6_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op7_decontaminate": {"doc_id", "item_id", "n_edits"},
    "op8_packing": {"doc_id", "bin", "capacity", "length"},
    "op9_quality_rules": {
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    },
    "op11_source_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op12_periodic_runs": {
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    },
    "op13_hard_negatives": {
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    },
    "op10_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}
PER_ROW = {"op1_html_extract": "pages", "op2_warc_archive": "pages"} | {
    k: "documents"
    for k in ("op4_near_dedup", "op5_secret_scan", "op6_substring_dedup", "op9_quality_rules", "op10_sharding", "op11_source_mixing", "op12_periodic_runs")
}


def test_all_are_registered():
    assert set(queries.QUERIES) >= set(COLUMNS)
    assert set(entry.queries()) >= set(queries.QUERIES) | {"pipeline"}


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(spark, name):
    ours = queries.QUERIES[name](spark, SMALL).toPandas()
    theirs = database(SMALL).execute(oracle.SQL[name]).fetchdf()
    assert difference(ours, theirs) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert set(df.columns) >= COLUMNS[name]
    if name in PER_ROW:
        assert df.count() == spark.read.parquet(f"{SMALL}/{PER_ROW[name]}.parquet").count()
