from __future__ import annotations

import math

import numpy as np
import pytest
from llm.conftest import SF

from precursor.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """n, exact deviations, |whitened| and explained of vectors as a (rows, dimensions) array, plainly."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[j] for row in x) for j in range(d)]
    deviation = [sum((n * row[j] - s[j]) ** 2 for j in range(d)) for row in x]
    c = np.array([[(n * row[j] - s[j]) / n for j in range(d)] for row in x])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, deviation, np.abs(c @ u / np.sqrt(np.maximum(e, 1e-300))), e / np.trace(v)


def compare(rows, vectors, components):
    n, deviation, whitened, explained = plain([v for _, v in vectors])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * components
    for i, (id, _) in enumerate(vectors):
        for k in range(components):
            r = got[id, k + 1]
            assert (r.n, r.deviation) == (n, deviation[i])
            assert abs(r.whitened) == pytest.approx(whitened[i][k], abs=1e-6)
            assert r.explained == pytest.approx(explained[k], rel=1e-9)
            assert r.identity_error < 1e-9
    for k in range(components):  # one sign for all rows of a component
        w = np.array([got[id, k + 1].whitened for id, _ in vectors])
        assert abs(w.mean()) < 1e-9 and w.var() == pytest.approx(1)


def test_query_against_numpy(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(queries.op11_block_whitening(spark, SF).collect(), vectors, 32)


def test_small_blocks_and_bad_rows(spark, monkeypatch):
    """Many blocks in both directions, several partial products, and rows that can't be used."""
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 5 * 7)
    monkeypatch.setattr(whitening, "PART_BYTES", 8 * 5 * 30)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 2)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(100, 5)) @ rng.normal(size=(5, 5)) + 3
    good = [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(v)]
    bad = [None, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e20] * 5, [], [1.0, 2.0], [0.0] * 6]
    df = spark.createDataFrame([(i, x, 0) for i, x in good] + [(1000 + i, x, 1) for i, x in enumerate(bad)], SCHEMA).repartition(7)
    df = df.selectExpr("*", "vec_id AS _id", "label AS component", "label AS _block")
    rows = whitening.whiten(df).collect()
    compare(rows, good, 5)


def test_ties_and_null_ids(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 0.5], 0), (2, [2.0, 2.0], 0), (3, [-1.0, 2.0], 0)], SCHEMA)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 10 and sum(r.vec_id is None for r in rows) == 2
    assert len({(r.whitened, r.deviation) for r in rows if r.vec_id == 1 and r.component == 1}) == 1


def test_no_variance(spark):
    flat = [(i, [float(i % 3), 2.0 * (i % 3), 1.0], 0) for i in range(9)]
    rows = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert len(rows) == 27
    assert {r.component for r in rows if r.whitened is not None} == {1}
    assert rows[0].identity_error < 1e-9
    one = whitening.whiten(spark.createDataFrame(flat[:1], SCHEMA)).collect()
    assert [(r.whitened, r.explained, r.deviation, r.n) for r in one] == [(None, 0.0, 0, 1)] * 3


def test_empty(spark):
    for rows in ([], [(1, None, 0)], [(1, [], 0)]):
        df = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert df.count() == 0 and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_is_exact_or_null():
    x = np.array([[10**6 + 2**50], [10**6]], dtype=np.int64)
    c, dev = whitening.centred(x, 2, [2 * 10**6 + 2**50])
    assert dev == [None, None] and c[:, 0].tolist() == [2**49, -(2**49)]
    x = np.array([[10**6 + 2**30], [10**6]], dtype=np.int64)
    assert whitening.centred(x, 2, [2 * 10**6 + 2**30])[1] == [2**60, 2**60]
