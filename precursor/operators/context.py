"""Context: the intervals of a run inside the search window round its anchor.

The window join (:func:`window_join`) is an equi join on ``(job_id, time
bucket)`` with the exact time range as a residual condition.  Anchors hold at
most one row per (target, run), so the join emits at most ``#targets`` rows per
interval before the range cuts them; the anchor side is broadcast by the
optimizer when its size allows it.  The date range is applied to the context
side as a literal filter as well, so it reaches the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precursor import fixed as fx
from precursor.functions.criteria import NoiseRule, Target, target_case
from precursor.operators.anchors import time_range
from precursor.schema import CONTEXT_FIELDS


#: Hash buckets of the runs with an anchor (what the run filter broadcasts at most).
RUN_BUCKETS = 1 << 18


def _interval(td: dt.timedelta) -> Column:
    return F.lit(td)  # DayTimeInterval literal


def relative_position(d_time: Column | str = "d_from_time", e_time: Column | str = "e_from_time") -> Column:
    """``at_d`` when whole seconds ``d - e`` is 0, ``after_d`` when negative, else ``before_d``.

    The difference truncates toward zero, so anything less than one second away
    counts as ``at_d``.
    """
    d = F.col(d_time) if isinstance(d_time, str) else d_time
    e = F.col(e_time) if isinstance(e_time, str) else e_time
    diff = F.timestamp_diff("SECOND", e, d)
    return (F.when(diff == 0, F.lit(fx.AT_ANCHOR)).when(diff <= 0, F.lit(fx.AFTER_ANCHOR))
            .otherwise(F.lit(fx.BEFORE_ANCHOR)))


def exclude_closing(reason: str, keep_null_reason: bool = False) -> Column:
    """``reason NOT LIKE x``; a NULL reason gives NULL and drops the row (Q6).

    ``keep_null_reason=True`` keeps rows without a reason instead.
    """
    cond = ~F.col("reason").like(reason)
    return (cond | F.col("reason").isNull()) if keep_null_reason else cond


def began_unless(began_reason: str, keep_backend_like: str) -> Column:
    """drop rows with the began reason unless their backend matches ``keep_backend_like``."""
    return (~F.col("reason").like(began_reason)) | F.col("backend").like(keep_backend_like)


def in_window(lookback: dt.timedelta, lookahead: dt.timedelta) -> Column:
    """J2 range: ``e.from_time BETWEEN d - lookback AND d + lookahead``."""
    d = F.col("d_from_time")
    return F.col("from_time").between(d - _interval(lookback), d + _interval(lookahead))


def time_bucket(ts: Column, width_us: int) -> Column:
    """Time bucket of ``ts``: whole ``width_us`` steps since the (zone-less) epoch."""
    micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)
    return F.floor(micros / F.lit(width_us)).cast("long")


def _run_bucket() -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(RUN_BUCKETS)).cast("int")


def window_join(e: DataFrame, anchors: DataFrame, lookback: dt.timedelta, lookahead: dt.timedelta) -> DataFrame:
    """Intervals of the anchor's run within ``[d - lookback, d + lookahead]``.

    The equi key is ``(job_id, time bucket)`` with buckets as wide as the window:
    each interval carries the bucket of its own time, each anchor is exploded to
    the (at most two) buckets its window covers, so every matching pair meets in
    exactly one bucket.  Small anchor sets are broadcast by the optimizer; beyond
    the threshold the shuffle is keyed by run *and* time, so a run holding a
    large share of all rows is spread over its buckets instead of one task.

    Rows of runs without an anchor are dropped before that, where they are scanned, by the
    hash buckets of the anchors' runs (a broadcast of bounded size).
    """
    e = e.join(F.broadcast(anchors.select(_run_bucket().alias("_r")).distinct()), _run_bucket() == F.col("_r"), "left_semi")
    width = max(1, int((lookback + lookahead) / dt.timedelta(microseconds=1)))
    d = F.col("d_from_time")
    a = anchors.withColumn("_b", F.explode(F.sequence(time_bucket(d - _interval(lookback), width),
                                                      time_bucket(d + _interval(lookahead), width))))
    e = e.withColumn("_b", time_bucket(F.col("from_time"), width))
    return e.join(a, ["job_id", "_b"]).where(in_window(lookback, lookahead)).drop("_b")


def context_projection(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor columns plus the ``e_*`` fields and ``e_diff`` (payloads: see payloads.py)."""
    anchor_cols = [c for c in anchors.columns if c.startswith("d_")]
    return df.select(
        "target_id", "job_id", "job_name", "job_url", "row_num", *anchor_cols,
        *[F.col(src).alias(dst) for dst, src in CONTEXT_FIELDS.items()],
        relative_position("d_from_time", "from_time").alias("e_diff"),
    )


def context_events(flat: DataFrame, anchors: DataFrame, targets: Sequence[Target], start, end,
                   lookback: dt.timedelta, lookahead: dt.timedelta,
                   closing_reason: str | None = None,
                   began_reason: str | None = None, began_keep_backend: str | None = None,
                   noise_rules: Sequence[NoiseRule] = (), keep_null_reason: bool = False) -> DataFrame:
    """Context rows of every anchor, after all exclusions (F10-F14), projected.

    The window join moves the anchors' keys, time and the columns that noise rules look at; the
    other anchor columns are attached to the rows that are left.
    """
    used = " ".join(str(rule.keep()) for rule in noise_rules)
    seen = [c for c in anchors.columns if c.startswith("d_") and c != "d_from_time" and c in used]
    narrow = anchors.select("target_id", "job_id", "d_from_time", *seen)
    rest = anchors.select("target_id", "job_id", *[c for c in anchors.columns if c not in narrow.columns])
    e = flat.where(time_range("from_time", start, end))
    if closing_reason is not None:
        e = e.where(exclude_closing(closing_reason, keep_null_reason))
    if began_reason is not None:
        e = e.where(began_unless(began_reason, began_keep_backend))
    joined = window_join(e, narrow, lookback, lookahead)
    joined = joined.where(~target_case(targets, "condition"))   # F11: not the target itself
    joined = joined.where(~target_case(targets, "ignore"))      # F12: not on the ignore list
    for rule in noise_rules:                                     # F14
        joined = joined.where(rule.keep())
    return context_projection(joined.join(rest, ["target_id", "job_id"]), anchors)
