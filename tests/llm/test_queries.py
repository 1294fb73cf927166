from __future__ import annotations

import re

import pytest
from llm.conftest import SF

from precursor.llm import queries

COLUMNS = {
    1: {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    2: {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    3: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    4: {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    5: {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    6: {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    11: {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    12: {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint",
         "audit": "string", "repaired_sha256": "string"},
    13: {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
         "near_edited": "double", "near_next": "double"},
    9: {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
}


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = int(re.match(r"op(\d+)_", name)[1])
    assert COLUMNS.get(n, {}).items() <= dict(df.dtypes).items()
    rows = df.count()
    if n in (1, 2, 3, 4, 5, 7, 13):
        assert rows == spark.read.parquet(f"{SF}/documents.parquet").count()
    if n == 12:
        assert rows == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    if n == 9:
        assert rows == spark.read.parquet(f"{SF}/pages.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb
    import oracle_compare as oc

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert oc.frame_digest(got) == oc.frame_digest(con.execute(queries.ORACLE_SQL[name]).df())
