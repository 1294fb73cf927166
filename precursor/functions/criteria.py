"""Target criteria as Column algebra.

A criterion tests one field of the flat interval table.  Conditions keep SQL's
three-valued logic on purpose: ``NOT (NULL AND TRUE)`` is NULL and drops a row,
exactly as a WHERE clause does, so no condition is "simplified" with coalesce
unless the criterion's own ``if_null`` asks for it.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from enum import Enum
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from precursor.fixed import REFERENCE_BEGAN_REASON


class Field(Enum):
    """Payload fields a criterion can test: name -> flat column."""

    LEVEL = "level"
    SOURCE = "source"
    REASON = "reason"
    DISPLAY = "display"
    CAUSE = "cause"
    LOCATOR_TYPE = "locator_type"
    KEYS_DISRUPTION = "disruption"
    KEYS_ROUTE = "route"
    KEYS_CONNECTION = "connection"
    KEYS_BACKEND_DISRUPTION_NAME = "backend"
    MESSAGE_HUMAN_MESSAGE = "message"
    NAMESPACE = "namespace"
    NODE = "node"
    POD = "pod"


_OPS = {
    "=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne,
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


def _compare(lhs: Column, op: str, value) -> Column:
    op_u = op.strip().upper()
    if op_u == "LIKE":
        return lhs.like(value)
    if op_u == "NOT LIKE":
        return ~lhs.like(value)
    if op_u in _OPS:
        return _OPS[op_u](lhs, F.lit(value))
    raise ValueError(f"unsupported operator {op!r}")


def _field_col(f: "Field | str", prefix: str = "") -> Column:
    """A flat column, or - for a JSON path such as ``$.message.foo`` outside the flat
    schema - the scalar at that path of the row's payload (parsed for this test only)."""
    name = f.value if isinstance(f, Field) else f
    if name.startswith("$"):
        from precursor.functions.payload import json_scalar_text
        return json_scalar_text(F.col(prefix + "payload"), name)
    return F.col(prefix + name)


@dataclass(frozen=True)
class FieldLike:
    """``IFNULL(field, if_null) <op> value``.

    * string value with ``=``: becomes ``LIKE`` with ``if_null=''`` so the test
      is never NULL and is safe under NOT; ``%`` and ``_`` are wildcards.
    * any other operator keeps ``if_null=None``: a missing field gives NULL.
    * bool value: compared as the text ``'true'``/``'false'``.
    * int/float value: the field is cast with ``try_cast`` to double.
    """

    field: "Field | str"
    value: object
    op: str = "="
    if_null: object = None

    def _norm(self) -> tuple[str, object, object]:
        op, value, if_null = self.op, self.value, self.if_null
        if isinstance(value, bool):
            value = "true" if value else "false"
        elif isinstance(value, str) and op.strip() in ("=", "=="):
            op = "LIKE"
            if if_null is None:
                if_null = ""
        return op, value, if_null

    def column(self, prefix: str = "") -> Column:
        op, value, if_null = self._norm()
        lhs = _field_col(self.field, prefix)
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            lhs = lhs.try_cast("double")
        if if_null is not None:
            lhs = F.coalesce(lhs, F.lit(if_null))
        return _compare(lhs, op, value)

    @property
    def label(self) -> str:
        op, value, _ = self._norm()
        name = self.field.name if isinstance(self.field, Field) else str(self.field)
        shown = f'"{value}"' if isinstance(self.value, str) else str(value)
        return f"{name} {op} {shown}"


@dataclass(frozen=True)
class NamespaceIs:
    """operator on the namespace (``namespace`` falling back to ``ns``); NULL propagates."""

    namespace: str
    op: str = "="

    def column(self, prefix: str = "") -> Column:
        return _compare(F.col(prefix + "namespace"), self.op, self.namespace)

    @property
    def label(self) -> str:
        return f"namespace {self.op} {self.namespace}"


def all_of(criteria: Iterable, prefix: str = "", empty: bool = True) -> Column:
    """AND of the criteria's columns; ``lit(empty)`` for an empty list."""
    cols = [c.column(prefix) for c in criteria]
    if not cols:
        return F.lit(empty)
    return functools.reduce(operator.and_, cols)


@dataclass(frozen=True)
class Target:
    """a target = AND of target criteria, plus an optional ignore conjunction.

    ``condition()`` selects anchors (and removes the target's own rows from the
    context); ``ignore_condition()`` removes known noise from the context and is
    ``FALSE`` when there is no ignore list.
    """

    criteria: tuple
    ignore: tuple = ()
    name: str | None = None

    def __init__(self, criteria: Sequence, ignore: Sequence | None = None, name: str | None = None):
        object.__setattr__(self, "criteria", tuple(criteria))
        object.__setattr__(self, "ignore", tuple(ignore or ()))
        object.__setattr__(self, "name", name)

    def condition(self, prefix: str = "") -> Column:
        return all_of(self.criteria, prefix, empty=True)

    def ignore_condition(self, prefix: str = "") -> Column:
        return all_of(self.ignore, prefix, empty=False)

    @property
    def label(self) -> str:
        """human text of the target criteria."""
        return "[" + " AND ".join(c.label for c in self.criteria) + "]"

    @property
    def ignore_label(self) -> str:
        return "[" + " AND ".join(c.label for c in self.ignore) + "]" if self.ignore else ""


def disruption_target(backend_like: str, *extra, began_reason: str = REFERENCE_BEGAN_REASON,
                      name: str | None = None) -> Target:
    """preset target - backend LIKE x AND reason = began AND display = true, plus extras."""
    crit = list(extra) + [
        FieldLike(Field.KEYS_BACKEND_DISRUPTION_NAME, backend_like, op="LIKE"),
        FieldLike(Field.REASON, began_reason),
        FieldLike(Field.DISPLAY, True),
    ]
    return Target(crit, name=name)


def target_case(targets: Sequence[Target], kind: str = "condition", prefix: str = "",
                target_col: str = "target_id") -> Column:
    """Per-row condition of the row's own target: ``CASE target_id WHEN i THEN cond_i END``.

    Used after the window join, where each row carries the id of the target whose
    anchor it belongs to.  Three-valued logic of each condition is preserved.
    """
    tid = F.col(target_col)
    expr = None
    for i, t in enumerate(targets):
        cond = t.condition(prefix) if kind == "condition" else t.ignore_condition(prefix)
        expr = F.when(tid == i, cond) if expr is None else expr.when(tid == i, cond)
    return expr if expr is not None else F.lit(None).cast("boolean")


def matching_targets(targets: Sequence[Target], prefix: str = "") -> Column:
    """array of the ids of all targets whose condition is TRUE for the row."""
    ids = [F.when(t.condition(prefix), F.lit(i)) for i, t in enumerate(targets)]
    return F.filter(F.array(*ids), lambda x: x.isNotNull())


@dataclass
class NoiseRule:
    """drop context rows where ``anchor_pred AND event_pred`` (Kleene logic).

    ``anchor_pred`` reads anchor columns (``d_*``), ``event_pred`` reads the
    context row's flat columns.  A NULL anchor field makes the conjunction NULL
    when the event predicate is TRUE, and the row is dropped, as in SQL.
    """

    anchor_pred: Column
    event_pred: Column

    def keep(self) -> Column:
        return ~(self.anchor_pred & self.event_pred)


def job_name_filter(name_col: Column, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> Column:
    """every ``includes`` pattern matches (LIKE %x%) and no ``excludes`` pattern does."""
    conds = [name_col.like(f"%{x}%") for x in includes] + [~name_col.like(f"%{x}%") for x in excludes]
    return functools.reduce(operator.and_, conds) if conds else F.lit(True)


__all__ = [
    "Field", "FieldLike", "NamespaceIs", "Target", "NoiseRule", "disruption_target",
    "all_of", "target_case", "matching_targets", "job_name_filter",
]
