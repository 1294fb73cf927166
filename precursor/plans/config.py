"""Analysis parameters and presets."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import functions as F

from precursor.fixed import (REFERENCE_BACKEND_FAMILIES, REFERENCE_BEGAN_KEEP_BACKEND,
                             REFERENCE_BEGAN_REASON, REFERENCE_CLOSING_REASON, REFERENCE_JOB_EXCLUDES,
                             REFERENCE_JOB_INCLUDES, REFERENCE_NODE_IGNORE_REASON, REFERENCE_NODE_SOURCE,
                             REFERENCE_NOISE_ALERT, REFERENCE_NOISE_ALERT_MESSAGE, REFERENCE_NOISE_BACKEND,
                             REFERENCE_NOISE_ETCD, REFERENCE_NOISE_FAILED_SCHEDULING, REFERENCE_NOISE_KUBE_EVENT,
                             REFERENCE_NOISE_NAMESPACES, REFERENCE_OBSERVER_ORIGIN, REFERENCE_SPAN_DAYS,
                             REFERENCE_TOP_K, REFERENCE_WINDOW_AFTER_SECONDS, REFERENCE_WINDOW_BEFORE_SECONDS,
                             DISPLAY_TRUE, MIN_RUNS)
from precursor.functions.criteria import Field, FieldLike, NoiseRule, Target


@dataclass
class AnalysisConfig:
    """Everything that defines one analysis.

    ``start``/``end``: inclusive time range applied to anchors, context rows and
    job start.  ``lookback``/``lookahead``: the search window round the anchor.
    """

    targets: Sequence[Target]
    start: str
    end: str
    lookback: dt.timedelta = dt.timedelta(seconds=40)
    lookahead: dt.timedelta = dt.timedelta(seconds=1)
    job_includes: Sequence[str] = ()
    job_excludes: Sequence[str] = ()
    excluded_origin: str | None = None
    display_value: str | None = DISPLAY_TRUE
    closing_reason: str | None = None
    began_reason: str | None = None
    began_keep_backend: str | None = None
    keep_null_reason: bool = False
    noise_rules: Sequence[NoiseRule] = field(default_factory=list)
    k: int = 25
    min_runs: int = 2
    node_compat: bool = False
    token_boundary: bool = False
    event_bucket: dt.timedelta | None = None  # order events by (run, time bucket): for windows too large for a task

    def describe(self) -> dict:
        """Canonical description (for fingerprints and report headings)."""
        return {
            "targets": [repr(t) for t in self.targets],  # every field, not the display label
            "range": [self.start, self.end],
            "window": [self.lookback.total_seconds(), self.lookahead.total_seconds()],
            "jobs": [list(self.job_includes), list(self.job_excludes)],
            "admission": [self.excluded_origin, self.display_value],
            "exclusions": [self.closing_reason, self.began_reason, self.began_keep_backend, self.keep_null_reason],
            "noise": [[str(r.anchor_pred), str(r.event_pred)] for r in self.noise_rules],
            "mining": [self.k, self.min_runs],
            "normalise": [self.node_compat, self.token_boundary],
        }

    def stage_description(self, stage: str) -> dict:
        """The part of :meth:`describe` a stage depends on."""
        d = self.describe()
        if stage in ("anchors", "context"):
            return {k: d[k] for k in ("targets", "range", "window", "jobs", "admission", "exclusions", "noise")}
        if stage in ("events", "name_map"):
            return {k: d[k] for k in ("targets", "range", "window", "jobs", "admission", "exclusions",
                                      "noise", "normalise")} | {"min_runs": self.min_runs}
        return d




def reference_targets() -> list[Target]:
    """The reference's 8 targets: node-not-ready (with ignore list) + 7 backend families."""
    node = Target([FieldLike(Field.SOURCE, REFERENCE_NODE_SOURCE)],
                  ignore=[FieldLike(Field.REASON, REFERENCE_NODE_IGNORE_REASON)], name="node-not-ready")
    fams = [Target([FieldLike(Field.KEYS_BACKEND_DISRUPTION_NAME, b)], name=b) for b in REFERENCE_BACKEND_FAMILIES]
    return [node, *fams]


def reference_noise_rule() -> NoiseRule:
    """Kube-apiserver, image-registry and CSI noise while a load balancer is disrupted."""
    src, ns, reason, msg = F.col("source"), F.col("namespace"), F.col("reason"), F.col("message")
    kube = (src == REFERENCE_NOISE_KUBE_EVENT) & (
        (ns == REFERENCE_NOISE_NAMESPACES[0]) | (ns == REFERENCE_NOISE_NAMESPACES[1])
        | (ns == REFERENCE_NOISE_NAMESPACES[2]) | (reason == REFERENCE_NOISE_FAILED_SCHEDULING))
    event = kube | (src == REFERENCE_NOISE_ETCD) | ((src == REFERENCE_NOISE_ALERT) & msg.like(REFERENCE_NOISE_ALERT_MESSAGE))
    return NoiseRule(F.col("d_backend_disruption_name") == REFERENCE_NOISE_BACKEND, event)


def reference_config(start_date: str, span_days: int = REFERENCE_SPAN_DAYS) -> AnalysisConfig:
    """The reference's workload for ``[start_date, start_date + span_days]``."""
    start = dt.datetime.fromisoformat(start_date)
    return AnalysisConfig(
        targets=reference_targets(),
        start=str(start), end=str(start + dt.timedelta(days=span_days)),
        lookback=dt.timedelta(seconds=REFERENCE_WINDOW_AFTER_SECONDS),
        lookahead=dt.timedelta(seconds=REFERENCE_WINDOW_BEFORE_SECONDS),
        job_includes=REFERENCE_JOB_INCLUDES, job_excludes=REFERENCE_JOB_EXCLUDES,
        excluded_origin=REFERENCE_OBSERVER_ORIGIN,
        closing_reason=REFERENCE_CLOSING_REASON,
        began_reason=REFERENCE_BEGAN_REASON, began_keep_backend=REFERENCE_BEGAN_KEEP_BACKEND,
        noise_rules=[reference_noise_rule()],
        k=REFERENCE_TOP_K, min_runs=MIN_RUNS,
    )


# Workload on the events/customer adapter (see FIXTURES.md §2).
def adapter_targets() -> list[Target]:
    """T1 (main), T2 (no backend, with an ignore list), T3 (overlaps T1)."""
    return [
        Target([FieldLike(Field.KEYS_BACKEND_DISRUPTION_NAME, "backend-9%")], name="T1"),
        Target([FieldLike(Field.SOURCE, "purchase")], ignore=[FieldLike(Field.REASON, "view")], name="T2"),
        Target([FieldLike(Field.KEYS_BACKEND_DISRUPTION_NAME, "backend-%")], name="T3"),
    ]


def adapter_noise_rule() -> NoiseRule:
    src, ns, reason, msg = F.col("source"), F.col("namespace"), F.col("reason"), F.col("message")
    event = ((src == "click") & (ns.like("ns-1%") | (reason == "Ended"))) | ((src == "view") & msg.like("%code-%"))
    return NoiseRule(F.col("d_backend_disruption_name") == "backend-9", event)


def adapter_config(targets: Sequence[Target] | None = None, noise: bool = True, **overrides) -> AnalysisConfig:
    cfg = AnalysisConfig(
        targets=list(targets) if targets is not None else adapter_targets(),
        start="2024-01-03 00:00:00", end="2024-01-29 00:00:00",
        lookback=dt.timedelta(days=3), lookahead=dt.timedelta(hours=1),
        job_includes=("Customer",), job_excludes=("FURNITURE",),
        excluded_origin="observer",
        closing_reason="Ended", began_reason="Began", began_keep_backend="%-3",
        noise_rules=[adapter_noise_rule()] if noise else [],
    )
    for k, v in overrides.items():
        setattr(cfg, k, v)
    return cfg
