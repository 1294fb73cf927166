from __future__ import annotations

import re

import public_tokenizers
from llm.conftest import EDGE, SF
from llm.test_similarity import _classes, _contained
from tokenizers import Tokenizer

import corpus_pipeline
from precursor.llm import queries, zstd_langid


def _brute(spark, rows, sf_dir):
    """(id, text) left by the first four stages, one document at a time."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    compressors = zstd_langid.learn(docs, ~queries.held_out()).compressors()
    left = [(r[0], r[1]) for r in rows if zstd_langid.classify(r[1], compressors)[1] >= zstd_langid.MIN_MARGIN]
    first = {}
    for i, t in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    left = list(first.values())
    left = [(i, t) for (i, t), (_, c, n, _) in zip(left, _classes(left), strict=True) if n == 1 or i == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {x[0] for x in _contained(left, items)}
    return [(i, t) for i, t in left if i not in leaks]


def test_pipeline_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    left = _brute(spark, rows, SF)
    assert 0 < len(left) < len(rows)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}


def test_stages_keep_columns_and_take_edge_rows(spark, make_docs):
    docs = make_docs(EDGE)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        assert stage(spark, make_docs([]), SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "benchmark_leaks", "packing"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(EDGE)
