from __future__ import annotations

import pytest

from precursor.llm.common import importable

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def _workers_import(spark):
    importable(spark)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or full rows, with extra columns whose names clash with the operators' own."""

    def make(rows, n_files: int = 3):
        full = [r if len(r) == 5 else (r[0], r[1], "en", "src1", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(n_files)
        clash = ["keep_id", "kept", "_id", "_row", "_text", "_bucket", "shard", "size", "start", "count", "class_id"]
        return df.selectExpr("*", *[f"doc_id AS `{c}`" for c in clash])

    return make


LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
#: Nulls in any column, empty and blank texts, repeated rows, ties, one very long text, odd characters.
EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, "one two three four"), (6, "one  two three\tfour"),
    (None, "no id at all but some words here"), (None, None), (7, LONG), (7, "same id, other text"),
    (8, "été naïve　日本語 \U0001f600 \x00 end"), (9, None, None, None, None), (10, "x" * 5000, None, None, None),
    (11, "1234 5678"), (-5, "a negative id sorts first of all"),
]
