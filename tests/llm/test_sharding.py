from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from llm.conftest import EDGE

from precursor.llm.hilbert_shards import hilbert_index, hilbert_shards


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_unit_steps(n, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    index = hilbert_index(list(cells.T), bits)
    assert sorted(index) == list(range(1 << (n * bits)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards_keep_every_row_and_their_law(make_docs, law):
    rows = [(i, "w " * (i * 37 % 101), "en" if i % 3 else "de", f"src{i % 7}" if i % 2 else "hot", i * 37 % 101)
            for i in range(500)] + [r if len(r) == 5 else (*r, "fr", "src1", None) for r in EDGE]
    got = hilbert_shards(make_docs(rows), n_shards=6, law=law).toPandas()
    text = lambda t: ("" if t is None else t).encode()
    want = sorted((-1 if r[0] is None else r[0], len(text(r[1])) + 8, zlib.crc32(text(r[1]))) for r in rows)
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32, strict=True)) == want
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    ordered = got.sort_values(["shard", "slot"])
    assert ordered.hilbert.is_monotonic_increasing
    if law == "rows":
        n = got.groupby("shard").size()
        assert len(n) == 6 and n.max() - n.min() <= 1
    else:
        total, largest = got["size"].sum(), got["size"].max()
        assert (got.groupby("shard")["size"].sum() - total / 6).abs().max() <= largest


def test_one_hot_cell_is_cut_by_id(make_docs):
    got = hilbert_shards(make_docs([(i, "same", "en", "hot", 4) for i in range(240)]), n_shards=24).toPandas()
    assert got.groupby("shard").size().tolist() == [10] * 24
    assert got.sort_values(["shard", "slot"]).doc_id.tolist() == list(range(240))


def test_empty_and_bad_law(make_docs):
    assert hilbert_shards(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        hilbert_shards(make_docs([]), law="key")


def test_shards_against_a_plain_computation(make_docs):
    """Cells, order, cuts and slots of every row as computed in memory, with sources that share long prefixes."""
    import math
    import random
    import zlib
    from bisect import bisect_right

    import numpy as np

    from precursor.llm.hilbert_shards import hilbert_index, hilbert_shards

    rng = random.Random(9)
    rows = []
    for i in range(700):
        text = "é" * rng.randrange(30) + "x" * rng.randrange(200)
        source = rng.choice([None, "", "crawl-2023-05", "crawl-2023-40", "crawl-2023-40", *[f"crawl-2023-{k}" for k in range(100, 200)]])
        rows.append((i, text, rng.choice(["de", "en", "fr", None]), source, rng.choice([None, rng.randrange(500)])))
    bits, shards = 6, 24

    def cells(values, numeric):
        known = sorted(v for v in values if v is not None)
        if numeric:
            cuts = [known[math.ceil(k * len(known) / 64) - 1] for k in range(1, 64)]
        else:
            firsts = {}
            for rank, v in enumerate(known):
                if rank == 0 or v != known[rank - 1]:
                    firsts.setdefault(rank * 64 // len(known), v)
            cuts = sorted(firsts.values())[1:]
        return [0 if v is None else bisect_right(cuts, v) for v in values]

    at = hilbert_index([np.array(cells([None if r[3] is None else r[3].encode() for r in rows], False)),
                        np.array(cells([None if r[2] is None else r[2].encode() for r in rows], False)),
                        np.array(cells([r[4] for r in rows], True))], bits)
    size = {r[0]: len(r[1].encode()) + 8 for r in rows}
    order = sorted(range(len(rows)), key=lambda k: (int(at[k]), rows[k][0]))
    total, before, want, slots = sum(size.values()), 0, {}, {}
    for k in order:
        i, text = rows[k][:2]
        shard = (2 * before + size[i]) * shards // (2 * total)
        want[i] = (size[i], zlib.crc32(text.encode()), shard, slots.get(shard, 0), int(at[k]))
        slots[shard], before = slots.get(shard, 0) + 1, before + size[i]
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"], r["hilbert"]) for r in hilbert_shards(make_docs(rows)).collect()}
    assert got == want
    assert len({want[r[0]][4] for r in rows if r[3] == "crawl-2023-05"} & {want[r[0]][4] for r in rows if r[3] == "crawl-2023-199"}) == 0
