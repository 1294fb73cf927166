"""Anchors: the first admitted interval of each job run that meets a target.

All targets are handled in one pass: every admitted row gets the array of the
targets it meets and is exploded to ``(target_id, row)``; one window keyed by
``(target_id, job_id)`` then picks the first row per run and target.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precursor.fixed import DISPLAY_TRUE
from precursor.functions.criteria import Target, job_name_filter, matching_targets
from precursor.schema import ANCHOR_FIELDS


def time_range(col: Column | str, start, end) -> Column:
    """``col BETWEEN start AND end`` (both inclusive) with literal bounds.

    Literal bounds reach the parquet scan as pushed filters and prune partitions.
    """
    c = F.col(col) if isinstance(col, str) else col
    return c.between(F.to_timestamp_ntz(F.lit(str(start))), F.to_timestamp_ntz(F.lit(str(end))))


def filter_jobs(jobs: DataFrame, start, end, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """F7 + F8 on the job table: name patterns and start time inside the range."""
    return jobs.where(time_range("job_start", start, end) & job_name_filter(F.col("job_name"), includes, excludes))


def anchor_admission(excluded_origin: str | None, display_value: str | None = DISPLAY_TRUE) -> Column:
    """origin differs from ``excluded_origin`` (a NULL origin is dropped) and display = 'true'."""
    cond = F.lit(True)
    if excluded_origin is not None:
        cond = cond & (F.col("origin") != excluded_origin)
    if display_value is not None:
        cond = cond & (F.col("display") == display_value)
    return cond


def match_targets(flat: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """one row per (row, target met): adds ``target_id``."""
    return (flat.withColumn("_targets", matching_targets(targets))
            .where(F.size("_targets") > 0)
            .withColumn("target_id", F.explode("_targets"))
            .drop("_targets"))


def first_anchor(candidates: DataFrame, keys: Sequence[str] = ("target_id", "job_id")) -> DataFrame:
    """First row per key by ``(from_time, event_id)``; event_id breaks ties deterministically."""
    w = Window.partitionBy(*keys).orderBy(F.col("from_time").asc(), F.col("event_id").asc())
    return (candidates.withColumn("row_num", F.row_number().over(w))
            .where(F.col("row_num") == 1))


def anchor_projection(df: DataFrame) -> DataFrame:
    """P5: run name, id, url, ``row_num`` and the ``d_*`` fields of the anchor (``d_payload``: see payloads.py)."""
    return df.select(
        "target_id", "job_id", "job_name", "job_url", "row_num",
        *[F.col(src).alias(dst) for dst, src in ANCHOR_FIELDS.items()],
    )


def find_anchors(flat: DataFrame, jobs: DataFrame, targets: Sequence[Target], start, end,
                 includes: Sequence[str] = (), excludes: Sequence[str] = (),
                 excluded_origin: str | None = None, display_value: str | None = DISPLAY_TRUE) -> DataFrame:
    """At most one anchor per ``(target_id, job_id)``.

    The job table is joined without a hint: the optimizer broadcasts it when its
    estimated (or, with AQE, measured) size is under the broadcast threshold and
    falls back to a sort-merge join otherwise.
    """
    cand = flat.where(time_range("from_time", start, end) & anchor_admission(excluded_origin, display_value))
    cand = match_targets(cand, targets)
    jobs_f = filter_jobs(jobs, start, end, includes, excludes).select("job_id", "job_name", "job_url")
    joined = cand.join(jobs_f, "job_id")
    return anchor_projection(first_anchor(joined))
