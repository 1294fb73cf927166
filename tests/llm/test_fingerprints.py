from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from llm.conftest import EDGE, SF
from pyspark.sql import functions as F

from precursor.llm import one_permutation as O
from precursor.llm import queries

BINS, BITS = O.BINS, O.BITS


def words_of(text):
    return [w for w in re.split("[ \t\n\v\f\r]+", text) if w]


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little"), seed)
    return seed


def plain_fingerprint(text):
    """Packed low bits of the bins, in hex: bins filled shingle by shingle, empty ones by probing."""
    h = [chained([w.encode()]) for w in words_of(text)]
    if not h:
        return ""
    shingles = [chained(h[i:i + 5]) for i in range(max(1, len(h) - 4))]
    bins = [None] * BINS
    for s in shingles:
        signed = s - (1 << 64) if s >> 63 else s
        b = (signed >> (64 - 8)) + BINS // 2
        if bins[b] is None or signed < bins[b]:
            bins[b] = signed
    first, start, stride = O.probe_order()
    full = list(bins)
    for b in range(BINS):
        if bins[b] is None:
            probes = [p[b] for p in first] + [(start[b] + t * stride[b]) % BINS for t in range(BINS)]
            full[b] = next(bins[p] for p in probes if bins[p] is not None)
    return "".join(f"{v & 255:02X}" for v in full)


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    m = sum(a[i:i + 2] == b[i:i + 2] for i in range(0, len(a), 2)) / BINS
    return max(0.0, (m - 1 / 256) / (1 - 1 / 256))


def plain(rows):
    """(id, n_chars, edited sha, fingerprint, edited fingerprint, near_edited, near_next) of rows of distinct ids."""
    rows = sorted((-(1 << 63) if i is None else i, i, t or "") for i, t in rows)
    out = {}
    for k, (_, i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        fp, efp, nfp = plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(following)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp, efp, plain_likeness(fp, efp), plain_likeness(fp, nfp))
    return out


def told(df):
    rows = df.select("doc_id", "n_chars", "edited_sha256", *[O.as_text(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")],
                     "near_edited", "near_next").collect()
    out = {r["doc_id"]: tuple(r)[1:6] + (r["near_next"],) for r in rows}
    assert len(out) == len(rows)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4], k
        assert got[k][4:] == pytest.approx(w[4:], abs=1e-12)


def test_against_plain_computation(make_docs):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "日本語", "\U0001f600"]
    rows = [(i * 7 % 1009, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 6, 30, 300, 2000])))) for i in range(150)]
    rows += [(2000 + i, "the same text in several rows " * 3) for i in range(5)]
    rows += [(3000 + k, t) for k, (_, t, *_) in enumerate(EDGE)] + [(None, "no id"), (-4, "odd\x1fspaces\xa0are　letters here and there")]
    want = plain(rows)
    same(told(O.fingerprints(make_docs(rows))), want)
    same(told(O.fingerprints(make_docs(rows), bucket_bytes=300)), want)  # many buckets, some of them empty
    assert len({want[2000 + i][2] for i in range(5)}) == 1


def test_few_rows_and_ties(spark, make_docs):
    assert O.fingerprints(make_docs([])).count() == 0
    same(told(O.fingerprints(make_docs([(5, "alone in the table and its own next")]))), plain([(5, "alone in the table and its own next")]))
    rows = O.fingerprints(make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (1, None), (None, None), (None, "x")])).collect()
    assert len(rows) == 5 and [r["near_edited"] for r in rows if r["n_chars"] == 0] == [1.0, 1.0]


def test_one_id_may_hold_most_rows(spark, make_docs):
    """A hot id is spread over the buckets by a hash of the text, which is the order of its rows."""
    rows = [(7, f"text number {i} of a hot id {i * i}") for i in range(300)] + [(i, f"other text {i} of its own") for i in range(100)]
    def place(row):
        h = xxhash.xxh64_intdigest(row[1].encode(), 42)
        return row[0], h - (1 << 64) if h >> 63 else h

    rows.sort(key=place)
    want = []
    for k, (_, text) in enumerate(rows):
        half = len(text) // 2
        want.append(hashlib.sha256((text[:len(text) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in O.fingerprints(make_docs(rows)).collect()) == sorted(want)


def test_estimates_are_near_the_similarity(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs.sort()
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for _, t in docs]
    got = {r["doc_id"]: r for r in queries.op13_one_permutation(spark, SF).collect()}
    assert len(got) == len(docs)
    errors = []
    for k, (i, _) in enumerate(docs):
        a, b = sets[k], sets[(k + 1) % len(docs)]
        errors.append(abs(got[i]["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(errors) < 0.1 and sum(errors) / len(errors) < 0.01


def test_bias_correction():
    """Chance agreement of unequal values is taken off: unrelated fingerprints estimate about 0, not 1 / 256."""
    rng = random.Random(1)
    make = lambda: "".join(f"{rng.randrange(256):02X}" for _ in range(BINS))
    assert plain_likeness(make(), make()) < 0.02 and plain_likeness("AB" * BINS, "AB" * BINS) == 1.0


def test_no_python_in_the_plan(spark):
    text = queries.op13_one_permutation(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
