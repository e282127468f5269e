"""The registered queries over the smallest tables: SQL where there is some, and the promised columns everywhere."""

import os

import duckdb
import pytest

from brook.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontamination": "doc_id item_id start_word end_word edits",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op5_quality_classifier": "doc_id held_out score p_content p_metadata kept",
    "op6_jaccard_join": "doc_id n_shingles component_id",
    "op7_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "pii_base": "doc_id n_email n_ip n_card n_phone base_sha256",
    "license_base": "doc_id n_words n_base first_word last_word base_labels",
    "quality_counts": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed",
}


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def test_all_are_there():
    assert set(QUERIES) == set(COLUMNS) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    promised = COLUMNS[name].split()
    assert df.columns[: len(promised)] == promised
    rows = sorted(str(tuple(r)) for r in df.collect())
    if name in ORACLES:
        want = tables.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
        assert rows == sorted(str(r) for r in want)
    elif name not in ("op1_decontamination", "op8_packing"):
        assert len(rows) == 200
