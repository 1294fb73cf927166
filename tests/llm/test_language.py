from __future__ import annotations

from llm.conftest import EDGE, SF

from precursor.llm import zstd_langid
from precursor.llm.queries import held_out, op3_zstd_language


def test_held_out_accuracy(spark):
    got = op3_zstd_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learns_only_from_labelled_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = zstd_langid.learn(docs, ~held_out())
    texts = {r["text"] for r in docs.where(~held_out()).collect()}
    whole = {zstd_langid._bytes(t) for t in texts if t}
    assert [k for k, _ in model.dictionaries] == ["de", "en", "es", "fr"]
    for _, content in model.dictionaries:
        assert any(t in content for t in whole)
    # the labels of held-out rows don't matter
    changed = docs.selectExpr("doc_id", "text", "if(pmod(crc32(cast(doc_id AS string)), 5) = 0, 'xx', lang) AS lang")
    assert zstd_langid.learn(changed, ~held_out()) == model


def test_narrow_margin_is_rejected_and_edge_rows(spark, make_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = zstd_langid.learn(docs, ~held_out())
    got = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in zstd_langid.identify(make_docs(EDGE), model).collect()}
    for i in (1, 2, 3, 11):
        assert (i, "und", True) in got
    compressors = model.compressors()
    assert zstd_langid.classify("zzqxj", compressors)[1] < 0.2
    kept = zstd_langid.keep_identified(make_docs(EDGE), model)
    assert kept.columns == make_docs(EDGE).columns
    assert not {r["doc_id"] for r in kept.collect()} & {1, 2, 3, 11}


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(1, "text", None, None, None)])
    model = zstd_langid.learn(docs, ~held_out())
    assert model.dictionaries == ()
    assert [(r["lang_pred"], r["score"]) for r in zstd_langid.identify(docs, model).collect()] == [("und", 0.0)]
    assert zstd_langid.identify(make_docs([]), model).count() == 0
