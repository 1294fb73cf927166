"""Scalar string functions used to normalise context rows.

All are built-in Column expressions (JVM side, whole-stage codegen); none is a
Python UDF.  Patterns use Java regex; they differ from Python's only on unusual
line terminators around ``.`` and ``$``.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from precursor.fixed import (DISPLAY_SEPARATOR, HEX_MASK, HEX_PATTERN, NODE_MISSING, NODE_NAME_PATTERN,
                             NODE_PRESENT, NULL_PLACEHOLDER, NUMBER_MASK, NUMBER_PATTERN, POD_SUFFIX_MASK,
                             POD_SUFFIX_PATTERN, TOKEN_ASSIGN, TOKEN_SEPARATOR, NAME_DELIMITER)



def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_pod_suffix(pod: Column | str) -> Column:
    """A dash + 8-10 hex digits and everything after it -> ``-xxxxxxxxxx``."""
    return F.regexp_replace(_c(pod), POD_SUFFIX_PATTERN, POD_SUFFIX_MASK)


def node_flag(node: Column | str, compat: bool = False) -> Column:
    """``no`` when the node is missing, ``yes`` when present.

    ``compat=True`` reproduces the observed behaviour of filling ``no`` first and
    then replacing every run of name characters with ``yes`` (so a missing node
    also becomes ``yes``, ``''`` stays ``''`` and ``a_b`` becomes ``yes_yes``).
    """
    n = _c(node)
    if compat:
        return F.regexp_replace(F.coalesce(n, F.lit(NODE_MISSING)), NODE_NAME_PATTERN, NODE_PRESENT)
    return F.when(n.isNull(), F.lit(NODE_MISSING)).otherwise(F.lit(NODE_PRESENT))


def mask_hex(msg: Column | str) -> Column:
    """Runs of 8-30 hex digits -> ``xxxxxxxxxx``."""
    return F.regexp_replace(_c(msg), HEX_PATTERN, HEX_MASK)


def mask_numbers(msg: Column | str) -> Column:
    """Runs of 1-30 digits -> ``###`` (apply after :func:`mask_hex`)."""
    return F.regexp_replace(_c(msg), NUMBER_PATTERN, NUMBER_MASK)


def mask_message(msg: Column | str) -> Column:
    """N3 then N4."""
    return mask_numbers(mask_hex(msg))


def dash_prefixes(name: Column | str, delimiter: str = NAME_DELIMITER) -> Column:
    """All delimiter-boundary prefixes of ``name``: ``a-b-c`` -> [a, a-b, a-b-c]."""
    parts = F.split(_c(name), _regex_literal(delimiter), -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), delimiter),
    )


def _regex_literal(s: str) -> str:
    return re.escape(s)


def event_token(fields: Sequence[str]) -> Column:
    """``field=value`` pairs joined by ``:``; NULL values become ``_``."""
    return F.concat_ws(TOKEN_SEPARATOR, *[
        F.concat(F.lit(f + TOKEN_ASSIGN), F.coalesce(F.col(f).cast("string"), F.lit(NULL_PLACEHOLDER)))
        for f in fields
    ])


def event_hash(token: Column | str) -> Column:
    """64-bit identity of a token (xxhash64, signed long)."""
    return F.xxhash64(_c(token))


def display_text(token: Column | str) -> Column:
    """Token as readable text - every ``:`` becomes a blank."""
    return F.translate(_c(token), TOKEN_SEPARATOR, DISPLAY_SEPARATOR)


def is_subsequence(sequence: Column | str, pattern: Column | str) -> Column:
    """TRUE when ``pattern`` occurs in ``sequence`` in order, gaps allowed.

    A greedy left-to-right scan of the sequence with a pointer into the pattern,
    written as the higher-order function ``aggregate`` (no UDF).
    """
    pat = _c(pattern)
    matched = F.aggregate(
        _c(sequence), F.lit(0),
        lambda i, x: F.when((i < F.size(pat)) & (F.get(pat, i) == x), i + 1).otherwise(i),
    )
    return matched == F.size(pat)
