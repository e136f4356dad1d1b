"""Registered queries of the subpackage: SQL where there is some, and that each keeps its contract's columns."""

import duckdb
import pytest

from siftlog.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_near_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op9_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op11_pieces": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op13_spelling": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op10_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
}


def test_all_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, DIR)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()


def test_licences_equal_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = c.sql(ORACLES["op1_license_scan"])
    columns = sorted(want.columns)
    got = QUERIES["op1_license_scan"](spark, DIR).select(*columns).collect()
    at = [want.columns.index(x) for x in columns]
    assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
