"""Payload columns of anchors and context rows by late materialisation.

Anchors and context are found on narrow columns.  The payload, the widest column of the flat table,
is fetched afterwards for the surviving rows alone, by (day, run, event id): the days of these rows
prune the partitions of the scan, and the join is keyed by run and day, so that no run's payloads
meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precursor.functions.payload import parse_payload, payload_text
from precursor.operators.anchors import time_range
from precursor.sources.flat import DAY, day_range, date_of


def time_bounds(rows: DataFrame, col: str):
    """(min, max) of a time column - two scalars, the only values brought to the driver."""
    b = rows.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return (b["lo"], b["hi"]) if b is not None and b["lo"] is not None else (None, None)


def between(flat: DataFrame, lo, hi) -> DataFrame:
    """Rows of the flat table in a time range, by partition and by time (none where there are no bounds)."""
    if lo is None:
        return flat.where(F.lit(False))
    rows = flat.where(time_range("from_time", lo, hi))
    return rows.where(day_range(date_of(lo), date_of(hi))) if DAY in flat.columns else rows


def with_payload(rows: DataFrame, flat: DataFrame, id: str, time: str, out: str) -> DataFrame:
    """``rows`` (job_id, ``id``, ``time``, ...) with ``out``: the canonical payload text of that interval.

    NULL where the interval has no payload or none that parses, or where its id is NULL.
    """
    day = F.col(DAY) if DAY in flat.columns else F.to_date("from_time")
    at = [F.col("job_id").alias("_run"), F.col(id).alias("_event"), F.to_date(time).alias("_day")]
    wide = between(flat, *time_bounds(rows, time)).select(
        F.col("job_id").alias("_run"), F.col("event_id").alias("_event"), day.alias("_day"), "payload")
    found = wide.join(rows.select(*at).distinct(), ["_run", "_event", "_day"]).select(
        "_run", "_event", "_day", payload_text(parse_payload("payload")).alias(out))
    return rows.select("*", *at).join(found, ["_run", "_event", "_day"], "left").drop("_run", "_event", "_day")


def anchor_payloads(anchors: DataFrame, flat: DataFrame) -> DataFrame:
    """P5: the anchors with ``d_payload``."""
    return with_payload(anchors, flat, "d_event_id", "d_from_time", "d_payload")


def context_payloads(context: DataFrame, anchors: DataFrame, flat: DataFrame) -> DataFrame:
    """Context rows with ``d_payload`` (of ``anchors`` that have it) and ``e_payload``."""
    found = with_payload(context, flat, "e_event_id", "e_from_time", "e_payload")
    return found.join(anchors.select("target_id", "job_id", "d_payload"), ["target_id", "job_id"], "left")
