"""Pattern drill-down: supporting runs, example rows and the search-window evidence.

Candidate (pattern, run) pairs come from an equi join on the pattern's rarest
item, not from pairing every pattern with every run.  The optimizer broadcasts the
patterns where their size allows it.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precursor.functions.payload import parse_payload, payload_text
from precursor.functions.text import is_subsequence
from precursor.operators.context import window_join
from precursor.operators.payloads import between, time_bounds

KEYS = ("target_id", "job_id")


def rarest_items(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns with ``item``: of their items the one that the fewest runs of the target have."""
    runs = items.groupBy("target_id", "item").agg(F.count("*").alias("_runs"))
    of = patterns.select("target_id", "rank", F.explode(F.array_distinct("pattern")).alias("item")).join(runs, ["target_id", "item"])
    rare = of.groupBy("target_id", "rank").agg(F.min(F.struct("_runs", "item"))["item"].alias("item"))
    return patterns.select("target_id", "pattern", "freq", "rank").join(rare, ["target_id", "rank"])


def pattern_support(sequences: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(target_id, pattern, freq, rank, job_id)`` for every run whose sequence contains the pattern."""
    items = sequences.select(*KEYS, F.explode(F.array_distinct("sequence")).alias("item"))
    cand = items.join(rarest_items(items, patterns), ["target_id", "item"]).drop("item")
    return (cand.join(sequences.select(*KEYS, "sequence"), list(KEYS))
            .where(is_subsequence("sequence", "pattern"))
            .select("target_id", "pattern", "freq", "rank", "job_id"))


def first_row_per_run(events: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: per run, the anchor columns (constant per run), taken from its first event."""
    return (events.groupBy(*KEYS)
            .agg(F.min_by(F.struct(*cols), F.struct("pos")).alias("_f"))
            .select(*KEYS, *[F.col("_f")[c].alias(c) for c in cols]))


def first_token_occurrence(events: DataFrame) -> DataFrame:
    """A5: earliest occurrence of each token in each run: ``(target_id, job_id, event, e_from_time, e_event_id)``."""
    w = Window.partitionBy(*KEYS, "event").orderBy(F.col("e_from_time").asc(), F.col("e_event_id").asc())
    return (events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(*KEYS, "event", "e_from_time", "e_event_id"))


def pattern_examples(support: DataFrame, first_occ: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """One example row per pattern item per supporting run (the item's first occurrence in the run).

    ``payloads`` (``target_id, job_id, event_id, payload_json``, e.g. :func:`window_rows`)
    attaches the example's payload text as ``example_payload``.
    """
    items = support.select("target_id", "job_id", "rank", "pattern",
                           F.posexplode("pattern").alias("item_pos", "event"))
    out = (items.join(first_occ, [*KEYS, "event"])
           .select("target_id", "rank", "job_id", "item_pos", "event",
                   F.col("e_from_time").alias("example_time"), F.col("e_event_id").alias("example_event_id")))
    if payloads is None:
        return out
    pay = payloads.select("target_id", "job_id", F.col("event_id").alias("example_event_id"),
                          F.col("payload_json").alias("example_payload"))
    return out.join(pay, [*KEYS, "example_event_id"], "left").select(*out.columns, "example_payload")


def pattern_item_rows(events: DataFrame, patterns: DataFrame) -> DataFrame:
    """F16: the events of a run whose token is an item of one of its target's patterns."""
    items = patterns.select("target_id", F.explode("pattern").alias("event")).distinct()
    return events.join(items, ["target_id", "event"], "left_semi")


def token_dictionary(events: DataFrame) -> DataFrame:
    """Distinct ``(target_id, event_hash, event, e_reason)``."""
    return events.select("target_id", "event_hash", "event", "e_reason").distinct()


def window_rows(flat: DataFrame, anchors: DataFrame, lookback: dt.timedelta, lookahead: dt.timedelta) -> DataFrame:
    """J3 core: every interval of the anchors' runs within ``[d - lookback, d + lookahead]``, with payload text.

    Literal bounds of all windows (two scalars from the small anchor table)
    reach the parquet scan; the anchors are the broadcast side of the join.
    This is the only stage that reads the wide payload column.
    """
    a = anchors.select("target_id", "job_id", "d_from_time")
    lo, hi = time_bounds(a, "d_from_time")
    e = between(flat, lo and lo - lookback, hi and hi + lookahead)
    out = window_join(e, a, lookback, lookahead)
    return out.select("target_id", "job_id", "d_from_time", "event_id", "from_time", "to_time",
                      "origin", "source", "reason", "message",
                      payload_text(parse_payload("payload")).alias("payload_json"))


def window_evidence(rows: DataFrame, excluded_origin: str | None = None) -> DataFrame:
    """The search-window rows shown as evidence - all but the excluded origin.

    Rows are ordered by time within each run at the sink (see the report writer).
    """
    return rows if excluded_origin is None else rows.where(F.col("origin") != excluded_origin)


def runs_with_context(events: DataFrame) -> DataFrame:
    """Number of runs that have at least one context event, per target."""
    return events.groupBy("target_id").agg(F.countDistinct("job_id").alias("n_runs"))
