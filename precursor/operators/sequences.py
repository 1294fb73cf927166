"""From context rows to one ordered event sequence per run.

Ordering, repeat-collapsing and grouping share one partitioning: the window is
keyed by ``(target_id, job_id)`` and the following ``groupBy`` on the same keys
reuses it, so the whole stage costs one shuffle.  A sequence holds the events of
one run inside one search window, which bounds its length.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precursor.functions.text import event_hash, event_token, mask_message, mask_pod_suffix, node_flag
from precursor.operators.context import time_bucket
from precursor.operators.names import apply_mappings, blank_rare, prefix_mappings
from precursor.schema import EVENT_FIELDS, EVENT_SORT_FIELDS

KEYS = ("target_id", "job_id")


# Within one target every run has exactly one anchor, so the anchor's interval id
# identifies the run: a long, which keeps "seen in >= 2 runs" a hash aggregation.
RUN_KEY = "d_event_id"
NAME_COLS = ("e_pod", "e_ns")


def masked_context(ctx: DataFrame, node_compat: bool = False) -> DataFrame:
    """Pod suffix masked, node flagged."""
    return (ctx.withColumn("e_pod", mask_pod_suffix("e_pod"))
            .withColumn("e_node", node_flag("e_node", compat=node_compat)))


def name_mappings(ctx: DataFrame, token_boundary: bool = False, min_runs: int = 2) -> DataFrame:
    """N6 for pods and namespaces of the context: ``(kind, target_id, name, mapped)``."""
    return prefix_mappings(masked_context(ctx), list(NAME_COLS), ("target_id",), RUN_KEY,
                           min_runs=min_runs, token_boundary=token_boundary)


def normalize_context(ctx: DataFrame, node_compat: bool = False, token_boundary: bool = False,
                      min_runs: int = 2, mappings: DataFrame | None = None) -> DataFrame:
    """N1-N6 on context rows: mask pods, flag nodes, generalise pods and namespaces, mask and blank messages.

    ``mappings`` is the (materialised) result of :func:`name_mappings`; without it
    the mapping is planned inline.
    """
    df = masked_context(ctx, node_compat)
    m = mappings if mappings is not None else name_mappings(ctx, token_boundary, min_runs)
    df = apply_mappings(df, m, list(NAME_COLS), ("target_id",))
    df = df.withColumn("e_message", mask_message("e_message"))
    return blank_rare(df, "e_message", ("target_id",), RUN_KEY, min_runs=min_runs)


def drop_all_null(df: DataFrame, fields: Sequence[str] = tuple(f for f in EVENT_FIELDS if f not in ("e_diff", "e_node"))) -> DataFrame:
    """drop rows whose event fields are all NULL."""
    return df.na.drop(how="all", subset=list(fields))


def add_tokens(df: DataFrame) -> DataFrame:
    """``event`` token text and its 64-bit ``event_hash``."""
    return df.withColumn("event", event_token(EVENT_FIELDS)).withColumn("event_hash", event_hash("event"))


def event_order(keys: Sequence[str] = KEYS):
    """O2: order inside a run - time, then source, namespace, reason, message (nulls last), then token and id."""
    order = [F.col("e_from_time").asc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in EVENT_SORT_FIELDS]
    order += [F.col("event").asc_nulls_last(), F.col("e_event_id").asc_nulls_last()]
    return Window.partitionBy(*keys).orderBy(*order)


def ordered_events(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """O2 + W2: number events in run order (``pos``) and drop an event equal to the one just before it."""
    w = event_order(keys)
    prev = F.lag("event").over(w)
    return (df.withColumn("pos", F.row_number().over(w))
            .withColumn("_prev", prev)
            .where(F.col("_prev").isNull() | (F.col("_prev") != F.col("event")))
            .drop("_prev"))


def ordered_events_by_bucket(df: DataFrame, bucket: dt.timedelta, keys: Sequence[str] = KEYS) -> DataFrame:
    """:func:`ordered_events` for runs that are too large for a task: the same rows and ``pos``.

    Events are ordered and compared inside (run, time bucket), so a run is spread over its buckets.
    Of every bucket its count and its last event go on, one narrow row per bucket: the counts before
    it shift the positions, and its first event is compared with the last one of the bucket before.
    """
    width = max(1, int(bucket / dt.timedelta(microseconds=1)))
    rows = df.withColumn("_b", F.coalesce(time_bucket(F.col("e_from_time"), width), F.lit(1 << 62)))  # no time: last, as in the order
    w = event_order([*keys, "_b"])
    rows = rows.withColumn("_at", F.row_number().over(w)).withColumn("_prev", F.lag("event").over(w))
    ends = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.max_by("event", "_at").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_b")
    ends = ends.select(*keys, "_b", F.lag("_last").over(before).alias("_border"), F.coalesce(
        F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    prev = F.when(F.col("_at") == 1, F.col("_border")).otherwise(F.col("_prev"))
    return (rows.join(ends, [*keys, "_b"]).withColumn("_prev", prev)
            .where(F.col("_prev").isNull() | (F.col("_prev") != F.col("event")))
            .withColumn("pos", (F.col("_before") + F.col("_at")).cast("int")).select(*df.columns, "pos"))


def build_sequences(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A3: ``(*keys, sequence array<string>, n_events)`` ordered by ``pos``."""
    return (events.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "event"))).alias("_s"))
            .select(*keys, F.transform("_s", lambda s: s["event"]).alias("sequence"))
            .withColumn("n_events", F.size("sequence")))


def token_events(ctx: DataFrame, node_compat: bool = False, token_boundary: bool = False,
                 min_runs: int = 2, mappings: DataFrame | None = None, bucket: dt.timedelta | None = None) -> DataFrame:
    """Normalised, tokenised, ordered and collapsed events of every run (by time ``bucket`` where given)."""
    df = add_tokens(drop_all_null(normalize_context(ctx, node_compat, token_boundary, min_runs, mappings)))
    return ordered_events(df) if bucket is None else ordered_events_by_bucket(df, bucket)
