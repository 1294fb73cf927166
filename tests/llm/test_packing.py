from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from llm.conftest import EDGE, SF
from tokenizers import Tokenizer

from precursor.llm.ss_packing import CAPACITY, END_ID, SumOfSquares, encoder, pack

TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _ids(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, END_ID]


def _check(pieces, rows):
    """Pieces give back the ids of every row, sequences are gapless and at most CAPACITY long."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(_ids(t))
    assert by_doc.keys() == want.keys()
    for i, parts in by_doc.items():
        if len(want[i]) == 1:
            ids, at = want[i][0], 0
            for p in sorted(parts, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], dtype="<u4").tobytes())
                at += p["length"]
            assert at == len(ids)
        assert sum(p["length"] for p in parts) == sum(map(len, want[i]))
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= CAPACITY
    return by_seq


def test_round_trip_and_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seqs = _check(pack(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    short = [s for s in seqs.values() if sum(p["length"] for p in s) < CAPACITY]
    assert len(short) <= docs.rdd.getNumPartitions()


def test_edge_rows(make_docs):
    _check(pack(make_docs(EDGE)).collect(), [(r[0], r[1]) for r in EDGE])
    assert pack(make_docs([])).count() == 0


def test_ids_equal_the_tokenizer():
    rng = np.random.default_rng(3)
    parts = ["a", "É", "é", " ", "  ", "\n", "\t", "\x1c", " ", "Σ", "'s", "'", "1", "12", "!", "?!", "<|endoftext|>", "ß",
             "\r", "İ", "한", "ᄀ", "Thtion", "ÿ", "×", "ª", "..", "a.b", "It's", "\x00", "\U0001f600"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]
    got = encoder(None)(texts)
    for t, b in zip(texts, got, strict=True):
        assert np.frombuffer(b, dtype="<u4").tolist() == _ids(t)[:-1], repr(t)


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(4)
    packer = SumOfSquares(20, 0)
    for _ in range(800):
        size, count = int(rng.integers(1, 21)), packer.count.copy()
        level = packer.level(size)

        def cost(g, size=size, count=count):
            n = count.copy()
            if g:
                n[g] -= 1
            if g + size < 20:
                n[g + size] += 1
            return int((n[1:20] ** 2).sum())

        open_levels = [0, *(g for g in range(1, 21 - size) if count[g])]
        assert level in open_levels and cost(level) == min(cost(g) for g in open_levels)
        list(packer.add((0, 0, b"\x01\0\0\0" * size, size), size))
    left = list(packer.fill_up())
    assert sum(sum(len(p[2]) // 4 for p in pieces) < 20 for _, pieces in left) <= 1


def test_plain_words_are_merged_without_the_tokeniser():
    from precursor.llm.ss_packing import _HELD, _word_encoder
    lines = ["Über 12 Straßen, 3.5% (ÉTÉ)!", "", "foo_bar&&& a|b -- c"]
    ids, ends, held = _word_encoder(TOK)("\n".join([*lines, ""]))
    assert [p.tolist() for p in np.split(ids, ends)[:1]] == [_ids(lines[0])[:-1]]
    assert len(ends) == 3 and not len(held)
    assert _word_encoder(TOK)(f"a {_HELD} b\n")[2].tolist() == [1]


def test_other_parts_stand_among_plain_words():
    texts = ["don't stop 日本 now\n\x01 x\ty", "", "\x01", "a<|endoftext|>b c", "'s", "é é ²", "a  b", "x'y z'"]
    got = encoder(None)(texts)
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [_ids(t)[:-1] for t in texts]
