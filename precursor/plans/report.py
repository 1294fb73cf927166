"""Report tables and sinks.

The HTML page of the reference is re-aimed as plain tables:

* ``target_summary``  - one row per target, also the ones without matches (S6).
* ``patterns``        - rank, support, share of runs and readable items (A7, N12).
* ``pattern_support`` - supporting runs with their anchor (M4).
* ``pattern_examples``- one example row per item per run (J7).
* ``window_evidence`` - all intervals round the anchor of each supporting run (J3).

``report_nested`` nests the bounded parts (the examples of one run, at most one
per pattern item) into one JSON record per (target, pattern, run); it never
collects the unbounded list of runs into one record.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precursor.functions.text import display_text
from precursor.operators.mining import PATTERN_SEPARATOR, pattern_text, support_fraction
from precursor.plans.analysis import Analysis
from precursor.sources.ordered import read_ordered, write_ordered


#: Status of a target whose anchors have no context rows.
NO_CONTEXT = "no context"


def target_summary(a: Analysis) -> DataFrame:
    """S6 + F4: per target its label, anchor count, context rows, runs with context and pattern count."""
    n_anchors = a.anchors.groupBy("target_id").agg(F.count("*").alias("n_anchors"))
    n_rows = a.context.groupBy("target_id").agg(F.count("*").alias("n_context_rows"))
    n_pat = a.patterns.groupBy("target_id").agg(F.count("*").alias("n_patterns"))
    t = F.broadcast(a.targets_frame())
    out = (t.join(n_anchors, "target_id", "left").join(n_rows, "target_id", "left")
           .join(a.n_runs, "target_id", "left").join(n_pat, "target_id", "left"))
    counts = ["n_anchors", "n_context_rows", "n_runs", "n_patterns"]
    out = out.select("target_id", "target_name", "target_label", "ignore_label",
                     *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])
    return out.withColumn("status", F.when(F.col("n_context_rows") == 0, F.lit(NO_CONTEXT)).otherwise(F.lit("ok")))


def patterns_table(a: Analysis) -> DataFrame:
    """Patterns with support share and readable items."""
    p = a.patterns.join(a.n_runs, "target_id")
    return p.select(
        "target_id", "rank", "freq", "n_runs",
        support_fraction("freq", "n_runs").alias("share_pct"),
        F.size("pattern").alias("length"),
        pattern_text().alias("pattern_text"),
        F.array_join(F.transform("pattern", display_text), PATTERN_SEPARATOR).alias("display"),
    )


def support_table(a: Analysis) -> DataFrame:
    """M4: supporting runs of each pattern with the run's anchor."""
    return a.support_detail.select("target_id", "rank", "freq", "job_id", "job_name", "job_url", "d_from_time",
                                   "d_backend_disruption_name", "d_payload")


def report_nested(a: Analysis) -> DataFrame:
    """One record per (target, pattern, run); examples nested as parsed JSON (Variant)."""
    ex = (a.examples.groupBy("target_id", "rank", "job_id")
          .agg(F.array_sort(F.collect_list(F.struct("item_pos", "event", "example_time", "example_event_id",
                                                    "example_payload"))).alias("_ex"))
          .select("target_id", "rank", "job_id", F.transform("_ex", lambda e: F.struct(
              e["item_pos"].alias("item_pos"), e["event"].alias("event"), e["example_time"].alias("example_time"),
              e["example_event_id"].alias("example_event_id"),
              F.try_parse_json(e["example_payload"]).alias("payload"))).alias("examples")))
    s = support_table(a).join(ex, ["target_id", "rank", "job_id"], "left")
    t = F.broadcast(a.targets_frame().select("target_id", "target_label"))
    return s.join(t, "target_id").select(
        "target_id", "target_label", "rank", "freq", "job_id", "job_name", "job_url", "d_from_time",
        "d_backend_disruption_name", F.try_parse_json("d_payload").alias("target_payload"), "examples")


#: O3: evidence is ordered by time within each run; the range partitions split a hot run by time.
EVIDENCE_ORDER = ("target_id", "job_id", "from_time", "event_id")


def ordered_evidence(a: Analysis, path: str) -> DataFrame:
    """O3: the evidence rows written in their order, read back with their ordinal."""
    return read_ordered(a.spark, write_ordered(a.evidence, path, *EVIDENCE_ORDER))


def write_report(a: Analysis, path: str, mode: str = "overwrite", parallelism: int = 4) -> dict[str, str]:
    """Write all report tables under ``path`` (parquet partitioned by target; nested report as JSON lines;
    the evidence as an ordered table).

    The tables are independent, so they are written by concurrent Spark jobs.
    """
    nested = report_nested(a)
    tables = {
        "target_summary": (target_summary(a), False),
        "patterns": (patterns_table(a), True),
        "pattern_support": (support_table(a), True),
        "pattern_examples": (a.examples, True),
        "window_evidence": (a.evidence, False),
        "report_nested": (nested.select("target_id", F.to_json(F.struct(*nested.columns)).alias("value")), True),
    }

    def write(item: tuple[str, tuple[DataFrame, bool]]) -> tuple[str, str]:
        name, (df, by_target) = item
        p = f"{path}/{name}"
        if name == "window_evidence":
            return name, write_ordered(df, p, *EVIDENCE_ORDER, mode=mode)
        w = df.write.mode(mode)
        if by_target:
            w = w.partitionBy("target_id")
        (w.text(p) if name == "report_nested" else w.parquet(p))
        return name, p

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return dict(pool.map(write, tables.items()))
