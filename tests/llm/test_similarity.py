from __future__ import annotations

import random

import pytest
from llm.conftest import EDGE, LONG

from precursor.llm import chosen_path, decontaminate
from precursor.llm.components import components


def _set(text):
    w = (text or "").split()
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def _classes(rows, threshold=0.8):
    """(id, class, size, links) by comparing all pairs."""
    sets = [_set(t) for _, t in rows]
    links = [[j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        for i, near in enumerate(links):
            root[i] = min([root[i], *(root[j] for j in near)])
    out = []
    for i, (id, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root[j] == root[i]]
        known = [m for m in members if m is not None]
        out.append((id, min(known) if known else None, len(members), len(links[i])))
    return out


def _family_rows(seed, families=25, size=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rng.shuffle(rows)
    return rows


def _got(df):
    return sorted(((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"leaf": 8, "block": 4, "depth": 2, "runs": 40}])
def test_classes_equal_brute_force(make_docs, sizes):
    rows = _family_rows(1)
    assert _got(chosen_path.similarity_classes(make_docs(rows), **sizes)) == sorted(_classes(rows), key=str)


def test_one_large_family_in_blocks(make_docs):
    rows = _family_rows(2, families=1, size=1)
    base = [f"v{i}" for i in range(80)]
    rng = random.Random(3)
    for i in range(150):
        t = list(base)
        t[rng.randrange(80)] = f"u{i}"
        rows.append((1000 + i, " ".join(t)))
    got = _got(chosen_path.similarity_classes(make_docs(rows), leaf=40, block=16, depth=2, runs=20))
    assert got == sorted(_classes(rows), key=str)


def test_edge_rows_and_empty_table(make_docs):
    rows = [(r[0], r[1]) for r in EDGE]
    assert _got(chosen_path.similarity_classes(make_docs(rows))) == sorted(_classes(rows), key=str)
    assert chosen_path.similarity_classes(make_docs([])).count() == 0
    assert chosen_path.keep_one_per_class(make_docs([])).count() == 0


def test_filter_keeps_one_row_per_class(make_docs):
    rows = _family_rows(4) + [(r[0], r[1]) for r in EDGE]
    docs = make_docs(rows)
    out = chosen_path.keep_one_per_class(docs)
    assert out.columns == docs.columns
    want = {}
    for (i, t), (_, c, size, _) in zip(rows, _classes(rows), strict=True):
        if size == 1 or i == c:
            want.setdefault((c, t if size == 1 else None), (i, t))
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.values()))


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"{a:03}", f"{b:03}") for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(180))]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]  # a long chain
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


# ---------------------------------------------------------------------------- benchmark items
def _contained(docs, items):
    out = []
    for d, t in docs:
        whole = _set(t)
        for i, item in items:
            s = _set(item)
            if s and 5 * len(s & whole) >= 4 * len(s):
                out.append((d, i, len(s & whole), len(s)))
    return sorted(out, key=str)


def _leaks(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate((5, 6, 9, 12, 20, 33, 60, 130, 300, 20, 20))]
    docs = []
    for d in range(120):
        t = say(rng.choice((0, 3, 40, 400, 3000)))
        if d % 3 == 0:
            item = items[rng.randrange(len(items))][1].split()
            for _ in range(rng.randint(0, 2)):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(t))
            t = t[:at] + item + t[at:]
        docs.append((d, " ".join(t)))
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_SHINGLES, 64])
def test_containment_equals_brute_force(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (block,))
    docs, items = _leaks(6)
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, items[4][1])], "item_id long, text string")
    got = decontaminate.find_contained(make_docs(docs), bench)
    rows = [(r["doc_id"], r["item_id"], r["shared_shingles"], r["item_shingles"]) for r in got.collect()]
    want = _contained(docs, items)
    # the item without an id is a copy of item 4
    assert sorted(rows, key=str) == sorted([*want, *((d, None, n, m) for d, i, n, m in want if i == 4)], key=str)
    left = decontaminate.drop_contaminated(make_docs(docs), bench)
    assert left.columns == make_docs(docs).columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {x[0] for x in _contained(docs, items)}


def test_containment_edge_rows(spark, make_docs):
    item = " ".join(LONG.split()[30_000:30_030])
    bench = spark.createDataFrame([(1, item), (2, "one")], "item_id long, text string")
    rows = [(r[0], r[1]) for r in EDGE]
    got = decontaminate.find_contained(make_docs(rows), bench)
    assert sorted(((r["doc_id"], r["item_id"], r["shared_shingles"], r["item_shingles"]) for r in got.collect()), key=str) \
        == _contained(rows, [(1, item), (2, "one")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contained(make_docs(rows), none).count() == 0
    assert decontaminate.drop_contaminated(make_docs(rows), none).count() == len(rows)
    assert decontaminate.find_contained(make_docs([]), bench).count() == 0


@pytest.mark.parametrize("longer", [0, 3])
def test_short_items_are_never_missed(spark, make_docs, longer):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(5 + i % 4))) for i in range(600)] + [(1000, items_twice := " ".join(say(5))), (1001, items_twice)]
    items += [(2000 + i, " ".join(say(40))) for i in range(longer)]
    docs = [(d, " ".join([*say(200), item, *say(200), item])) for d, (_, item) in enumerate(items)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contained(make_docs(docs), bench).collect()
    rows = [(r["doc_id"], r["item_id"], r["shared_shingles"], r["item_shingles"]) for r in got]
    want = [(d, i, n, n) for d, (j, t) in enumerate(items) for i, u in items if t == u for n in [len(_set(t))]]
    assert sorted(rows) == sorted(want)
