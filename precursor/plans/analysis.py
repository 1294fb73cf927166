"""M5: the whole analysis for many targets in one pass.

Stages and where they are cut (materialised under the shared scratch folder,
keyed by a fingerprint of the inputs' snapshot and the stage's parameters):

1. ``flat``        - payload parsed once (S1, P1-P4), by day; the analysis asks for the days of its range alone.
2. ``anchors``     - first admitted interval per (target, run) (F6-F9, J1, W1, P5).
3. ``context``     - window join + exclusions (F10-F14, J2, P6-P8); read by the name
   mapping, the message statistic and the tokens.
4. ``name_map``    - pod and namespace generalisation, once for both columns (A2, J5, N6).
5. ``events``      - normalised, tokenised, ordered, collapsed events (N1-N10, O2, W2).
6. ``sequences``   - one sequence per (target, run) (A3).
7. ``patterns``    - top-k closed patterns per target (M1-M3, O4, O5).
8. ``support``     - supporting runs of each pattern (J6).
9. ``window_rows`` - intervals in the windows of supporting runs, with payload text (J3).

Examples, evidence and the report tables are lazy views over these.  ``anchors_full`` and
``context_full`` attach payloads to the rows of 2 and 3, which never read them.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precursor.functions.payload import flatten_intervals
from precursor.operators import anchors as anc
from precursor.operators import context as ctx
from precursor.operators import evidence as ev
from precursor.operators import mining as mn
from precursor.operators import payloads as pay
from precursor.operators import sequences as sq
from precursor.plans.config import AnalysisConfig
from precursor.sources.cache import fingerprint, materialize, snapshot
from precursor.sources.flat import FlatStore, date_of, day_range, raw_rows, DAY
from precursor.sources.ordered import read_ordered, write_ordered


def flat_store(intervals: DataFrame, known: str | None = None) -> FlatStore:
    """The flat interval table of an input snapshot, partitioned by day."""
    return FlatStore(intervals, fingerprint("flat", known or snapshot(intervals)))


def prepare_intervals(intervals: DataFrame, known: str | None = None) -> DataFrame:
    """The whole flat interval table, every day parsed once per input snapshot."""
    return flat_store(intervals, known).all()


class Analysis:
    """Lazy, stage-cached analysis of ``intervals`` and ``jobs`` under ``cfg``."""

    def __init__(self, spark: SparkSession, intervals: DataFrame | None, jobs: DataFrame, cfg: AnalysisConfig,
                 flat: DataFrame | None = None, cache: bool = True):
        """``flat``: an already prepared flat interval table (then ``intervals`` may be None)."""
        if intervals is None and flat is None:
            raise ValueError("give the native intervals or a prepared flat table")
        self.spark = spark
        self.intervals = intervals
        self.jobs_raw = jobs
        self.cfg = cfg
        self.cache = cache
        self._flat = flat
        # the flat table depends on the intervals alone: a new job file doesn't parse them again
        self.intervals_snapshot = snapshot(intervals if intervals is not None else flat)
        self.snapshot = fingerprint(self.intervals_snapshot, snapshot(jobs))

    def _fp(self, stage: str) -> str:
        return fingerprint(stage, self.snapshot, self.cfg.stage_description(stage))

    def _cut(self, df: DataFrame, stage: str) -> DataFrame:
        return materialize(df, stage, self._fp(stage)) if self.cache else df

    # -- stages -----------------------------------------------------------------
    @cached_property
    def flat(self) -> DataFrame:
        if self._flat is not None:
            return self._flat
        if not self.cache:
            return flatten_intervals(self.intervals)
        return prepare_intervals(self.intervals, self.intervals_snapshot)

    @cached_property
    def flat_in_range(self) -> DataFrame:
        """The flat rows that the analysis can reach: the date range and the search windows at its ends."""
        c = self.cfg
        lo, hi = (dt.datetime.fromisoformat(str(t)) for t in (c.start, c.end))
        lo, hi = lo - c.lookback, hi + c.lookahead
        if self._flat is not None:
            return self._flat.where(day_range(date_of(lo), date_of(hi))) if DAY in self._flat.columns else self._flat
        if not self.cache:
            return flatten_intervals(raw_rows(self.intervals, [(date_of(lo), date_of(hi))]))
        return flat_store(self.intervals, self.intervals_snapshot).days(lo, hi)

    @cached_property
    def jobs(self) -> DataFrame:
        return self.jobs_raw

    @cached_property
    def anchors(self) -> DataFrame:
        c = self.cfg
        found = anc.find_anchors(self.flat_in_range, self.jobs, c.targets, c.start, c.end, c.job_includes,
                                 c.job_excludes, c.excluded_origin, c.display_value)
        return self._cut(found, "anchors")

    def context_plan(self) -> DataFrame:
        c = self.cfg
        return ctx.context_events(self.flat_in_range, self.anchors, c.targets, c.start, c.end, c.lookback, c.lookahead,
                                  c.closing_reason, c.began_reason, c.began_keep_backend, c.noise_rules,
                                  c.keep_null_reason)

    @cached_property
    def context(self) -> DataFrame:
        return self._cut(self.context_plan(), "context")

    @cached_property
    def name_map(self) -> DataFrame:
        """Pod and namespace mapping, computed once for both columns."""
        c = self.cfg
        return self._cut(sq.name_mappings(self.context, c.token_boundary, c.min_runs), "name_map")

    @cached_property
    def events(self) -> DataFrame:
        c = self.cfg
        ev_ = sq.token_events(self.context, c.node_compat, c.token_boundary, c.min_runs, self.name_map, c.event_bucket)
        return self._cut(ev_, "events")

    @cached_property
    def sequences(self) -> DataFrame:
        return self._cut(sq.build_sequences(self.events), "sequences")

    @cached_property
    def patterns(self) -> DataFrame:
        c = self.cfg
        top = mn.topk_closed(self.sequences, c.k, c.min_runs)
        return self._cut(top, "patterns")

    # -- rows with payloads -------------------------------------------------------
    @cached_property
    def anchors_full(self) -> DataFrame:
        """P5: anchors with ``d_payload``."""
        return self._cut(pay.anchor_payloads(self.anchors, self.flat_in_range), "anchors_full")

    @cached_property
    def context_full(self) -> DataFrame:
        """Context rows with ``d_payload`` and ``e_payload``."""
        return pay.context_payloads(self.context, self.anchors_full, self.flat_in_range)

    def write_context(self, path: str, mode: str = "overwrite") -> DataFrame:
        """O1: the context with payloads in the order of (target, run, time), read back with its ordinal."""
        order = ["target_id", "job_id", "e_from_time", "e_event_id"]
        return read_ordered(self.spark, write_ordered(self.context_full, path, *order, mode=mode))

    # -- drill-down ---------------------------------------------------------------
    @cached_property
    def support(self) -> DataFrame:
        return self._cut(ev.pattern_support(self.sequences, self.patterns), "support")

    @cached_property
    def window_rows(self) -> DataFrame:
        """All intervals in the search windows of the supporting runs, with payload text."""
        runs = self.support.select("target_id", "job_id").distinct()
        supporting = self.anchors.join(runs, ["target_id", "job_id"], "left_semi")
        c = self.cfg
        return self._cut(ev.window_rows(self.flat_in_range, supporting, c.lookback, c.lookahead), "window_rows")

    @cached_property
    def support_detail(self) -> DataFrame:
        """M4: supporting runs with their anchor and its payload text."""
        anchors = self.anchors.select("target_id", "job_id", "job_name", "job_url", "d_from_time",
                                      "d_backend_disruption_name", "d_event_id")
        pay = self.window_rows.select("target_id", "job_id", F.col("event_id").alias("d_event_id"),
                                      F.col("payload_json").alias("d_payload"))
        return (self.support.join(anchors, ["target_id", "job_id"])
                .join(pay, ["target_id", "job_id", "d_event_id"], "left")
                .select("target_id", "rank", "freq", "job_id", "job_name", "job_url", "d_from_time",
                        "d_backend_disruption_name", "d_event_id", "d_payload"))

    @cached_property
    def examples(self) -> DataFrame:
        return ev.pattern_examples(self.support, ev.first_token_occurrence(self.events), self.window_rows)

    @cached_property
    def evidence(self) -> DataFrame:
        return ev.window_evidence(self.window_rows, self.cfg.excluded_origin)

    @cached_property
    def n_runs(self) -> DataFrame:
        return ev.runs_with_context(self.events)

    def targets_frame(self) -> DataFrame:
        """The target list as a small DataFrame (one row per target; bounded by the parameter list)."""
        rows = [(i, t.name or f"target-{i}", t.label, t.ignore_label) for i, t in enumerate(self.cfg.targets)]
        return self.spark.createDataFrame(rows, "target_id int, target_name string, target_label string, ignore_label string")


def run(spark: SparkSession, intervals: DataFrame, jobs: DataFrame, cfg: AnalysisConfig, **kw) -> Analysis:
    """Build an :class:`Analysis`; stages run when their DataFrames are used."""
    return Analysis(spark, intervals, jobs, cfg, **kw)


__all__ = ["Analysis", "run", "prepare_intervals"]
