from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from llm.conftest import SF

from precursor.llm import conversation_repair as R
from precursor.llm import queries

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
STOPS = ".!?"


def plain_repair(rows):
    """(cost, audit, lines) by trying every edit of every prefix of the grammar; rows are (role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(i, kept, inserted):
        # kept: "", "s", "u" or "a", the last initial, and whether anything stands before it
        options = []
        if i == len(rows) and kept in ("", "a"):
            options.append((0, "", ()))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[kept]
        if inserted < 3:
            for r, name in (("u", "user"), ("a", "assistant")):
                if r in follows:
                    c, a, out = best(i, r, inserted + 1)
                    options.append((c + 3, "I" + a, ((name, ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, out = best(i + 1, kept, 0)
            options.append((c + 4, "D" + a, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in follows:
                    c, a, out = best(i + 1, role[:1], 0)
                    options.append((c + more, "K" + a, ((role, text), *out)))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in follows:
                        c, a, out = best(i + 1, r, 0)
                        options.append((c + 3 + more, "R" + a, ((name, text), *out)))
        return min(options, default=(float("inf"), "", ()))

    return best(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")[-1:]
        out.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen
                    else "truncated" if end not in STOPS else ""))
        seen.add((role, text))
    return out


def brute(table, damage=True):
    sys.setrecursionlimit(10_000)
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20 if damage else 19
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in rows if t is not None}
        told = faults([r[1:] for r in rows])
        kinds = [f for _, _, f in told]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        cost, audit, lines = plain_repair(tuple(told))
        assert GRAMMAR.match("".join(r[:1] for r, _ in lines))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"),
                     kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def told(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op12_suffix_dawg(spark, SF)) == brute(table)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    texts = ["Done.", "Done.", "cut", " \t", "", None, "Why? ", "Yes!\n", "été.", " ", "a. b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "aside"]
    rows = [(rng.randrange(60) if rng.random() < .95 else None, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts))
            for _ in range(400)]
    rows += [(100, t, ("user", "assistant")[t % 2], f"line {t}{'.' * (t % 7 > 0)}") for t in range(400)]  # a long one
    rows += [(200 + i, t, r, x) for i in range(50) for t, (r, x) in enumerate([("user", "Hello."), ("assistant", "Hi.")])]
    rows += [(101, 0, "user", "dropped with its conversation."), (102, -5, "assistant", "a negative turn."), (102, 2**40, "user", "far")]
    return rows + rows[:20]


def test_odd_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.selectExpr("*", "conv_id AS `_conv`", "role AS `_plan`", "turn AS position")
    assert told(R.report(R.damaged(R.rows_of(df)))) == brute(odd_rows)
    assert told(R.report(R.rows_of(df))) == brute(odd_rows, damage=False)


def test_repaired_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string").repartition(3)
    lines, audits = {}, {}
    for r in sorted(R.repair(df).collect(), key=lambda r: (str(r.conv_id), r.position)):
        audits[r.conv_id] = audits.get(r.conv_id, "") + r.edit
        if r.edit != "D":
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, want in brute(odd_rows, damage=False).items():
        assert audits.get(conv, "") == want[6]
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == want[7]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.report(R.damaged(R.rows_of(df))).count() == 0
    assert R.repair(df).count() == 0


def test_nodes_are_shared():
    """Signatures in the order of their ends make one node per distinct suffix; every one costs what brute force says."""
    words = {"".join(w) for n in range(6) for w in itertools.product("suaSd", repeat=n)}
    graph = R.SuffixGraph()
    roles = {"s": "system", "u": "user", "a": "assistant"}
    for back in sorted(w[::-1] for w in words):
        cost, audit = graph.best(back)
        if len(back) < 5:
            rows = tuple((roles.get(c.lower(), "user"), str(i), {"d": "blank", "S": "truncated"}.get(c, ""))
                         for i, c in enumerate(back[::-1]))
            assert (cost, audit) == plain_repair(rows)[:2]
    assert graph.made == len({w[i:] for w in words for i in range(len(w) + 1)})
