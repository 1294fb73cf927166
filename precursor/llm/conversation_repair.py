"""Conversation structure repair with a suffix-shared automaton over all conversations.

Role initials of a repaired conversation follow ``(s?(ua)+)?``.  Rows are kept (free), re-roled to user
or assistant (3), deleted (4; blank and duplicate rows must be) or preceded by an inserted empty row
(3); a truncated row that stays costs 3 more.  The cheapest edits win, ties by the ASCII-least audit.

1. Rows of a conversation, in turn order, become a signature: one symbol per row from its role and fault.
2. The distinct signatures of all conversations are sorted from their ends, so that neighbours share
   suffixes.  Each suffix is one node of a word graph that is minimised from the end: a task walks the
   sorted signatures, keeps the nodes of the present suffix, and adds only the nodes that the next
   signature does not share.
3. A node has, for every state of the grammar, its cost-to-go and the first edit of the best audit
   suffix (the rest is the best suffix of the node behind it).  The first edits of two choices always
   differ, so ties are settled without comparing suffixes.  The step from a node to the one before
   depends on the costs up to a constant, so equal steps are computed once.
4. The best audit is joined back by signature, and rows and audit meet in turn order to be edited.

A signature that many conversations share is one row of the sort; its join back reads written tables,
so a hot one is split.  A conversation's rows stream through a task in order (sorting spills);
only its signature and its audit, one byte per row, are held whole, as they are in the result.

Defined results: rows are ordered by turn (nulls first), then role and text; null roles and texts are one
space (so a null text is blank, and a null role fits no grammar); rows of a null conv_id are one
conversation; a role's initial decides, so any role that starts with ``u`` counts as a user; a conversation
without rows is repaired to none; repeated rows are duplicates; an empty table gives an empty
result; other columns of the input are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precursor.llm.common import attach, trimmed, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
_STOPS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; the conversation may end in 0 and 3.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (True, False, False, True)
#: Symbols: role initial of a row that may stay (upper case: truncated; x: no role of the grammar), d: must go.
_TRUNCATED = {"s": "S", "u": "U", "a": "A", "x": "X"}

Step = tuple[tuple[int, ...], tuple[tuple[str, int], ...]]


# ---------------------------------------------------------------------------- the automaton
def _with_inserts(costs: list[float], firsts: list[tuple[str, int] | None]) -> Step:
    """Costs and first edits per state when rows may also be inserted before the next symbol."""
    changed = True
    while changed:
        changed = False
        for q, moves in enumerate(MOVES):
            for letter in ROLES:
                to = moves.get(letter)
                if to is not None and (costs[to] + INSERT, "I") < (costs[q], firsts[q][0] if firsts[q] else "Z"):
                    costs[q], firsts[q], changed = costs[to] + INSERT, ("I", to), True
    return tuple(int(c) for c in costs), tuple(firsts)


def end_step() -> Step:
    """Costs per state behind the last row; an edit of ``""`` ends the audit."""
    return _with_inserts([0 if e else float("inf") for e in ENDS], [("", q) if e else None for q, e in enumerate(ENDS)])


def step(symbol: str, behind: tuple[int, ...]) -> Step:
    """Costs per state in front of ``symbol``, given those behind it, and each state's first edit: (letter, next state).

    ``I`` stays at the node, the other letters go on to the node behind.
    """
    costs, firsts = [], []
    extra = TRUNCATED if symbol.isupper() else 0
    role = symbol.lower()
    for q, moves in enumerate(MOVES):
        choices = [(behind[q] + DELETE, "D", q)]
        if symbol != "d":
            if role in moves:
                choices.append((behind[moves[role]] + KEEP + extra, "K", moves[role]))
            choices += [(behind[moves[r]] + REROLE + extra, "R", moves[r]) for r in ROLES if r in moves]
        cost, letter, to = min(choices)
        costs.append(cost)
        firsts.append((letter, to))
    return _with_inserts(costs, firsts)


class SuffixGraph:
    """Nodes of the present suffix: costs-to-go (less a constant) and first edits, shared by signatures in order."""

    def __init__(self) -> None:
        costs, firsts = end_step()
        self.symbols: list[str] = []  # from the end
        self.nodes: list[tuple[tuple[int, ...], int, tuple]] = [(costs, 0, firsts)]
        self.made = 1
        self._steps: dict[tuple[str, tuple[int, ...]], tuple[tuple[int, ...], int, tuple]] = {}

    def _node(self, symbol: str, behind: tuple[int, ...], base: int) -> tuple[tuple[int, ...], int, tuple]:
        known = self._steps.get((symbol, behind))
        if known is None:
            costs, firsts = step(symbol, behind)
            low = min(costs)
            known = self._steps[symbol, behind] = (tuple(c - low for c in costs), low, firsts)
        return known[0], base + known[1], known[2]

    def best(self, reverse: str) -> tuple[int, str]:
        """Cost and audit of the signature whose symbols from the end are ``reverse``."""
        shared, most = 0, min(len(reverse), len(self.symbols))
        while shared < most and reverse[shared] == self.symbols[shared]:
            shared += 1
        del self.symbols[shared:], self.nodes[shared + 1:]
        for symbol in reverse[shared:]:
            self.symbols.append(symbol)
            self.nodes.append(self._node(symbol, *self.nodes[-1][:2]))
            self.made += 1
        costs, base, _ = self.nodes[-1]
        return costs[0] + base, "".join(self._audit())

    def _audit(self) -> Iterator[str]:
        at, q = len(self.nodes) - 1, 0
        while True:
            letter, q = self.nodes[at][2][q]
            if not letter:
                return
            yield letter
            at -= letter != "I"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    graph = SuffixGraph()
    for b in batches:
        back = b.column("_back").to_pylist()
        found = [graph.best(r) for r in back]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[::-1] for r in back], pa.string()), pa.array([c for c, _ in found], pa.int64()),
             pa.array([a for _, a in found], pa.string())], names=["_signature", "cost", "audit"])


def best_audits(signatures: DataFrame) -> DataFrame:
    """(_signature, cost, audit) of every distinct ``_signature``, solved in the order of their ends."""
    back = signatures.select(F.reverse("_signature").alias("_back")).distinct()
    return back.orderBy("_back").mapInArrow(_solve, "_signature string, cost long, audit string")


# ---------------------------------------------------------------------------- rows
def _ordered(rows: DataFrame) -> DataFrame:
    """Rows (_conv, _turn, _role, _text, _gone) by conversation and turn, with _again: an equal row came earlier.

    A row that is _gone only tells that its conversation exists.
    """
    order = [F.col("_turn").asc_nulls_first(), "_role", "_text"]
    same = Window.partitionBy("_conv", "_gone", "_role", F.sha2("_text", 256)).orderBy(F.col("_turn").asc_nulls_first())
    return (rows.repartition("_conv").withColumn("_again", F.row_number().over(same) > 1)
            .sortWithinPartitions("_conv", "_gone", *order, "_again"))


FACTS = "_conv long, gaps long, blank long, duplicate long, truncated long, illegal long, _signature string"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of ordered rows: its counts and its signature."""
    names = [f.split()[0] for f in FACTS.split(", ")]
    kinds = [*[pa.int64()] * 6, pa.string()]
    out: list[tuple] = []
    conv, first = None, True
    low = turn = before = None
    distinct = blank = duplicate = truncated = illegal = 0
    signature: list[str] = []

    def told() -> tuple:
        return (conv, 0 if low is None else turn - low + 1 - distinct, blank, duplicate, truncated, illegal, "".join(signature))

    for b in batches:
        for c, t, role, text, gone, again in zip(*(b.column(n).to_pylist() for n in (
                "_conv", "_turn", "_role", "_text", "_gone", "_again")), strict=True):
            if first or c != conv:
                if not first:
                    out.append(told())
                conv, first = c, False
                low = turn = before = None
                distinct = blank = duplicate = truncated = illegal = 0
                signature = []
            if gone:
                continue
            if t is not None and t != turn:
                low, turn, distinct = t if low is None else low, t, distinct + 1
            initial = role[:1]
            if before is not None:
                illegal += before + initial not in LEGAL
            before = initial
            symbol = initial if initial and initial in "sua" else "x"
            end = text.rstrip(_BLANK)[-1:]
            if not end:
                blank, symbol = blank + 1, "d"
            elif again:
                duplicate, symbol = duplicate + 1, "d"
            elif end not in _STOPS:
                truncated, symbol = truncated + 1, _TRUNCATED[symbol]
            signature.append(symbol)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if not first:
        out.append(told())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, edit, role, text, turn) of every edit; ``rows`` are (conv, audit, turn, role, text), the audit row first.

    A deleted row has its own role and text, an inserted one no turn.
    """
    audit, at, state, conv, first = "", 0, 0, None, True

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            letter = next(r for r in ROLES if r in MOVES[state])
            state, at = MOVES[state][letter], at + 1
            yield conv, "I", ROLES[letter], "", None

    for c, plan, turn, role, text in rows:
        if plan is not None:
            if not first:
                yield from inserts()
            conv, audit, at, state, first = c, plan, 0, 0, False
            continue
        yield from inserts()
        edit, at = audit[at], at + 1
        if edit == "K":
            state = MOVES[state][role[0]]
        elif edit == "R":
            letter = next(r for r in ROLES if r in MOVES[state])
            state, role = MOVES[state][letter], ROLES[letter]
        yield conv, edit, role, text, turn
    if not first:
        yield from inserts()


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in ("_conv", "_plan", "_turn", "_role", "_text")), strict=True)


REPAIRED = "conv_id long, position long, edit string, role string, text string, turn long"


def _rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    out: list[tuple] = []
    last, position, size = object(), 0, 0
    for conv, edit, role, text, turn in _edited(_tuples(batches)):
        position = position + 1 if conv == last else 0
        last, size = conv, size + len(text)
        out.append((conv, position, edit, role, text, turn))
        if len(out) >= 5000 or size >= 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_conv, repaired_sha256) of conversations that keep a row: their ``role:text`` lines, hashed as they stream by."""
    found: list[tuple] = []
    last, digest = None, None
    for conv, edit, role, text, _ in chain(_edited(_tuples(batches)), [(None, "", None, None, None)]):
        if edit == "" or digest is None or conv != last:
            if digest is not None and digest[1]:
                found.append((last, digest[0].hexdigest()))
            last, digest = conv, [hashlib.sha256(), 0]
        if edit not in ("D", ""):
            digest[0].update(("\n" if digest[1] else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            digest[1] += 1
        if len(found) >= 10_000 or edit == "":
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([h for _, h in found], pa.string())],
                                             names=["_conv", "repaired_sha256"])
            found = []


def rows_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """The operator's view of a table: nulls of role and text as one space."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(F.col(conv).cast("long").alias("_conv"), F.col(turn).cast("long").alias("_turn"),
                                space(role).alias("_role"), space(text).alias("_text"), F.lit(False).alias("_gone"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted damage, by checksum of ``conv:turn``: dropped, emptied, cut, repeated or re-roled.

    A dropped row stays as a row that is ``_gone``, so that its conversation is not forgotten.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("_conv"), F.lit(":"), part("_turn")).cast("binary")), F.lit(20))
    rows = rows.withColumn("_kind", kind)
    text = (F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", ""))
            .otherwise(F.col("_text")))
    rows = rows.select("_conv", "_turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("_role"),
                       text.alias("_text"), (F.col("_kind") == 0).alias("_gone"), "_kind")
    copies = F.when(F.col("_kind") == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy", "_kind")


def plan_repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: _conv, gaps, fault counts, illegal pairs, cost and audit (a written table)."""
    facts = written(_ordered(rows).mapInArrow(lambda it: trimmed(_facts(it)), FACTS), "repair-facts")
    audits = written(best_audits(facts), "repair-audits")
    return written(attach(facts, audits, "_signature").drop("_signature"), "repair-plans")


def _meeting(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows and the audit of each conversation, the audit first, in the order of the audit's letters."""
    marks = plans.select("_conv", F.col("audit").alias("_plan"), *[
        F.lit(None).cast(k).alias(n) for n, k in (("_turn", "long"), ("_role", "string"), ("_text", "string"))])
    both = rows.where("not _gone").select("_conv", F.lit(None).cast("string").alias("_plan"), "_turn", "_role", "_text").unionByName(marks)
    return both.repartition("_conv").sortWithinPartitions(
        "_conv", F.col("_plan").asc_nulls_last(), F.col("_turn").asc_nulls_first(), "_role", "_text")


def repair(conversations: DataFrame, **names: str) -> DataFrame:
    """The edits of every conversation in order: conv_id, position, edit (K, R, D, I), role, text, turn.

    The repaired conversation is what is left without the rows whose edit is D.
    """
    rows = rows_of(conversations, **names)
    return _meeting(rows, plan_repair(rows)).mapInArrow(_rows_out, REPAIRED)


def report(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: counts of faults, cost, audit and the SHA-256 of the repaired lines."""
    plans = plan_repair(rows)
    digests = written(_meeting(rows, plans).mapInArrow(lambda it: trimmed(_digests(it)), "_conv long, repaired_sha256 string"), "repair-digests")
    nothing = hashlib.sha256().hexdigest()
    return plans.join(digests.withColumnRenamed("_conv", "_c"), F.col("_conv").eqNullSafe(F.col("_c")), "left").select(
        F.col("_conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))

