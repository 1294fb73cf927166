"""

All queries run the adapter workload of FIXTURES.md §2 (targets T1-T3, window
3 days before / 1 hour after, range 2024-01-03..2024-01-29) over the whole
``events`` and ``customer`` tables of ``sf_dir``.  Mining is exact (no pattern
length limit).  For comparison with DuckDB, timestamps are returned as text
``yyyy-MM-dd HH:mm:ss.SSSSSS`` and arrays as text joined with `` > ``.
"""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_sql as O  # noqa: E402
from precursor.functions import criteria as C  # noqa: E402
from precursor.functions import payload as P  # noqa: E402
from precursor.functions import text as X  # noqa: E402
from precursor.operators import anchors as AN  # noqa: E402
from precursor.operators import context as CX  # noqa: E402
from precursor.operators import evidence as EV  # noqa: E402
from precursor.operators import mining as MN  # noqa: E402
from precursor.operators import names as NM  # noqa: E402
from precursor.operators import sequences as SQ  # noqa: E402
from precursor.plans import report as RP  # noqa: E402
from precursor.plans.config import adapter_config  # noqa: E402
from precursor.plans.analysis import Analysis  # noqa: E402
from precursor.session import apply_recommended_conf  # noqa: E402
from precursor.sources import cache as CA  # noqa: E402
from precursor.sources.adapter import read_adapted  # noqa: E402
from precursor.sources.intervals import read_intervals, read_jobs  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"


def _ts(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _arr(c: str):
    return F.array_join(F.col(c), " > ")


_ANALYSES: dict = {}


def _analysis(spark: SparkSession, sf_dir: str, noise: bool = True) -> Analysis:
    """One lazily built analysis per (session, folder); its stages are materialised once."""
    apply_recommended_conf(spark)
    key = (sf_dir, noise)
    hit = _ANALYSES.get(key)
    if hit is None or hit.spark is not spark:
        iv, jobs = read_adapted(spark, sf_dir)
        _ANALYSES[key] = hit = Analysis(spark, iv, jobs, adapter_config(noise=noise))
    return hit


def _ctx_variant(spark, sf_dir, closing=True, began=True, noise=True, targets=None, keep_null=False):
    a = _analysis(spark, sf_dir)
    c = a.cfg
    t = targets if targets is not None else c.targets
    return CX.context_events(a.flat, a.anchors, t, c.start, c.end, c.lookback, c.lookahead,
                             c.closing_reason if closing else None,
                             c.began_reason if began else None, c.began_keep_backend,
                             c.noise_rules if noise else [], keep_null)


# ---------------------------------------------------------------------------- sources
def q_scan_intervals(spark, sf):
    iv, _ = read_adapted(spark, sf)
    df = read_intervals(spark, iv)
    return df.select("job_id", "event_id", _ts("from_time").alias("from_time"), _ts("to_time").alias("to_time"),
                     "origin", F.when(F.col("interval").isNotNull(), "interval")
                     .otherwise("interval_json").alias("payload_in"))


def q_scan_jobs(spark, sf):
    _, jobs = read_adapted(spark, sf)
    return read_jobs(spark, jobs).select("job_id", "job_name", "job_url", _ts("job_start").alias("job_start"))


def q_context_rowcount(spark, sf):
    a = _analysis(spark, sf)
    n = a.context.groupBy("target_id").agg(F.count("*").alias("n_rows"))
    return (F.broadcast(a.targets_frame()).join(n, "target_id", "left")
            .select("target_id", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")))


def q_context_cache(spark, sf):
    a = _analysis(spark, sf)
    fp = CA.fingerprint("context_cache", a.snapshot, a.cfg.stage_description("context"))
    df = CA.materialize(a.context_plan(), "context_cache", fp)
    return df.select("target_id", "job_id", "e_event_id", _ts("e_from_time").alias("e_from_time"), "e_diff",
                     "e_source", "e_reason")


def _fields(payload, prefix, names=("source", "reason", "message", "pod")):
    """Fields read from a payload text, as ``<prefix>_<name>``."""
    from precursor.schema import PAYLOAD_FIELDS
    return [P.json_scalar_text(payload, PAYLOAD_FIELDS[n]).alias(f"{prefix}_{n}") for n in names]


def q_report_nested(spark, sf):
    a = _analysis(spark, sf)
    r = RP.report_nested(a)
    return r.select("target_id", "target_label", "rank", "freq", "job_id", "job_name", "job_url",
                    _ts("d_from_time").alias("d_from_time"), "d_backend_disruption_name",
                    F.size("examples").alias("n_examples"),
                    F.array_join(F.transform("examples", lambda e: e["example_event_id"].cast("string")), ",")
                    .alias("example_ids"),
                    F.array_join(F.transform("examples", lambda e: F.coalesce(P.json_scalar(e["payload"], "$.message.humanMessage"), F.lit("_"))), ",")
                    .alias("example_messages"),
                    P.json_scalar(F.col("target_payload"), "$.source").alias("target_source"))


def q_target_summary(spark, sf):
    a = _analysis(spark, sf)
    return RP.target_summary(a).select("target_id", "target_label", "ignore_label", "n_anchors", "n_context_rows",
                                       "n_runs", "n_patterns", "status")


# ---------------------------------------------------------------------------- payload
def q_payload_coalesce(spark, sf):
    iv, _ = read_adapted(spark, sf)
    pl = P.payload_coalesce("interval", "interval_json")
    return iv.select("event_id", F.when(F.col("interval").isNotNull(), "interval").otherwise("interval_json")
                     .alias("payload_in"), P.json_scalar_text(pl, "$.source").alias("source"))


def q_json_scalar(spark, sf):
    a = _analysis(spark, sf)
    from precursor.schema import PAYLOAD_FIELDS
    return a.flat.select("event_id", *PAYLOAD_FIELDS.keys())


def q_namespace_fallback(spark, sf):
    a = _analysis(spark, sf)
    return a.flat.select("event_id", "keys_namespace", "keys_ns", "namespace")


def q_payload_text(spark, sf):
    a = _analysis(spark, sf)
    pj = P.payload_text(P.parse_payload("payload"))
    paths = {"source": "$.source", "display": "$.display", "backend": "$.locator.keys.backend-disruption-name",
             "reason": "$.message.reason", "message": "$.message.humanMessage", "pod": "$.locator.keys.pod",
             "node": "$.locator.keys.node", "keys_ns": "$.locator.keys.ns"}
    return P.with_scalars(a.flat.select("event_id", pj.alias("pj")), paths, "pj").select("event_id", *paths)


def _anchor_cols(df):
    return df.select("target_id", "job_id", "job_name", "job_url", "row_num", _ts("d_from_time").alias("d_from_time"),
                     _ts("d_to_time").alias("d_to_time"), "d_reason", "d_cause", "d_ns", "d_disruption", "d_route",
                     "d_connection", "d_backend_disruption_name", "d_message", "d_event_id", *_fields("d_payload", "d_payload"))


def q_anchor_projection(spark, sf):
    return _anchor_cols(_analysis(spark, sf).anchors_full)


_CTX_COLS = ["target_id", "job_id", "e_event_id", "e_diff", "e_source", "e_ns", "e_node", "e_pod", "e_container",
             "e_uid", "e_row", "e_reason", "e_cause", "e_constructed", "e_count", "e_roles", "e_message",
             "e_locator"]


def q_context_projection(spark, sf):
    c = _analysis(spark, sf).context_full
    return c.select(*_CTX_COLS, "row_num", _ts("d_from_time").alias("d_from_time"), _ts("e_from_time").alias("e_from_time"),
                    _ts("e_to_time").alias("e_to_time"), *_fields("e_payload", "e_payload"), *_fields("d_payload", "d_payload", ("source",)))


def q_relative_position(spark, sf):
    c = _ctx_variant(spark, sf, noise=False)
    return c.select("target_id", "job_id", "e_event_id", "e_diff",
                    F.timestamp_diff("SECOND", "e_from_time", "d_from_time").alias("diff_seconds"))


def q_time_bounds(spark, sf):
    a = _analysis(spark, sf)
    d = F.col("d_from_time")
    return a.anchors.select("target_id", "job_id",
                            F.date_format(d - F.lit(a.cfg.lookback), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("win_start"),
                            F.date_format(d + F.lit(a.cfg.lookahead), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("win_end"))


# ---------------------------------------------------------------------------- criteria
def _flags(spark, sf, **cols):
    f = _analysis(spark, sf).flat
    return f.select("event_id", *[c.cast("string").alias(n) for n, c in cols.items()])


def q_crit_field_like(spark, sf):
    return _flags(spark, sf, m=C.FieldLike(C.Field.KEYS_BACKEND_DISRUPTION_NAME, "backend-9%").column())


def q_crit_field_op(spark, sf):
    return _flags(spark, sf, m=C.FieldLike(C.Field.REASON, "Began", op="!=").column(),
                  l=C.FieldLike(C.Field.POD, "view-%", op="LIKE").column())


def q_crit_field_bool(spark, sf):
    return _flags(spark, sf, m=C.FieldLike(C.Field.DISPLAY, True).column(),
                  f=C.FieldLike(C.Field.DISPLAY, False).column())


def q_crit_namespace(spark, sf):
    return _flags(spark, sf, m=C.NamespaceIs("ns-3").column(), n=C.NamespaceIs("ns-1%", "LIKE").column())


def q_crit_target_and_ignore(spark, sf):
    t = C.Target([C.FieldLike(C.Field.SOURCE, "click"), C.FieldLike(C.Field.NAMESPACE, "ns-1%")],
                 ignore=[C.FieldLike(C.Field.REASON, "click"), C.FieldLike(C.Field.MESSAGE_HUMAN_MESSAGE, "%code-%")])
    t0 = C.Target([C.FieldLike(C.Field.SOURCE, "view")])
    return _flags(spark, sf, t=t.condition(), i=t.ignore_condition(), t0=t0.condition(), i0=t0.ignore_condition())


def q_crit_disruption_preset(spark, sf):
    t = C.disruption_target("backend-%", began_reason="Began")
    return _flags(spark, sf, m=t.condition())


def q_multi_target_match(spark, sf):
    a = _analysis(spark, sf)
    ids = C.matching_targets(a.cfg.targets)
    return a.flat.select("event_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("targets"))


def q_job_name_filter(spark, sf):
    _, jobs = read_adapted(spark, sf)
    return jobs.where(C.job_name_filter(F.col("job_name"), ["Customer"], ["FURNITURE"])).select("job_id", "job_name")


def q_time_range_filter(spark, sf):
    a = _analysis(spark, sf)
    c = a.cfg
    return a.flat.where(AN.time_range("from_time", c.start, c.end)).select("event_id", _ts("from_time").alias("from_time"))


def q_anchor_admission(spark, sf):
    a = _analysis(spark, sf)
    return a.flat.where(AN.anchor_admission("observer")).select("event_id", "origin", "display")


def q_exclude_ended_3vl(spark, sf):
    f = _analysis(spark, sf).flat
    return f.where(CX.exclude_closing("Ended")).select("event_id", "reason")


def q_exclude_self(spark, sf):
    # self and ignore exclusions only
    c = _ctx_variant(spark, sf, closing=False, began=False, noise=False)
    return c.select("target_id", "job_id", "e_event_id", "e_source", "e_reason")


def q_exclude_ignored(spark, sf):
    # what is left per target and reason (T2 ignores the reason 'view')
    c = _ctx_variant(spark, sf, closing=False, began=False, noise=False)
    return c.groupBy("target_id", "e_reason").agg(F.count("*").alias("n_rows"))


def q_began_unless_liveness(spark, sf):
    f = _analysis(spark, sf).flat
    return f.where(CX.began_unless("Began", "%-3")).select("event_id", "reason", "backend")


def q_noise_rule_3vl(spark, sf):
    # rows the noise rule removes (T2 has a NULL anchor backend: NULL AND TRUE drops too)
    with_rule = _ctx_variant(spark, sf, noise=True).select("target_id", "job_id", "e_event_id")
    without = _ctx_variant(spark, sf, noise=False).select("target_id", "job_id", "e_event_id", "e_source")
    return without.join(with_rule, ["target_id", "job_id", "e_event_id"], "left_anti")


def q_drop_all_null(spark, sf):
    a = _analysis(spark, sf)
    # rows without a reason are kept, so that rows without any field reach this step
    df = SQ.drop_all_null(SQ.normalize_context(_ctx_variant(spark, sf, began=False, keep_null=True)))
    return df.select("target_id", "job_id", "e_event_id")


def q_pattern_item_rows(spark, sf):
    a = _analysis(spark, sf)
    return EV.pattern_item_rows(a.events, a.patterns).select("target_id", "job_id", "e_event_id", "event")


# ---------------------------------------------------------------------------- joins
def q_join_intervals_jobs(spark, sf):
    a = _analysis(spark, sf)
    c = a.cfg
    cand = AN.match_targets(a.flat.where(AN.time_range("from_time", c.start, c.end) & AN.anchor_admission("observer")),
                            c.targets)
    jobs = AN.filter_jobs(a.jobs, c.start, c.end, c.job_includes, c.job_excludes)
    return cand.join(jobs, "job_id").select("target_id", "job_id", "event_id", "job_name")


def q_window_join(spark, sf):
    a = _analysis(spark, sf)
    c = a.cfg
    e = a.flat.where(AN.time_range("from_time", c.start, c.end))
    j = CX.window_join(e, a.anchors, c.lookback, c.lookahead)
    return j.select("target_id", "job_id", F.col("event_id").alias("e_event_id"))


def q_window_evidence(spark, sf):
    ev_ = _analysis(spark, sf).evidence
    return ev_.select("target_id", "job_id", "event_id", _ts("from_time").alias("from_time"), "origin", "source")


def q_generalize_prefix(spark, sf):
    a = _analysis(spark, sf)
    n1 = a.context.withColumn("e_pod", X.mask_pod_suffix("e_pod"))
    pod = NM.prefix_mapping(n1, "e_pod").withColumn("kind", F.lit("pod"))
    ns = NM.prefix_mapping(n1, "e_ns").withColumn("kind", F.lit("ns"))
    return pod.unionByName(ns).select("kind", "target_id", "name", "mapped")


def q_pattern_support(spark, sf):
    a = _analysis(spark, sf)
    return a.support.select("target_id", "rank", "freq", "job_id", _arr("pattern").alias("pattern_text"))


def q_pattern_examples(spark, sf):
    a = _analysis(spark, sf)
    return a.examples.select("target_id", "rank", "job_id", "item_pos", "event", "example_event_id",
                             _ts("example_time").alias("example_time"), *_fields("example_payload", "example"))


def q_token_dictionary(spark, sf):
    a = _analysis(spark, sf)
    return (EV.token_dictionary(a.events).select("target_id", "event", F.md5("event").alias("event_md5"), "e_reason")
            .distinct())


# ---------------------------------------------------------------------------- aggregations
def _n1(spark, sf):
    a = _analysis(spark, sf)
    return a.context.withColumn("e_pod", X.mask_pod_suffix("e_pod")).withColumn("e_message", X.mask_message("e_message"))


def q_runs_per_message(spark, sf):
    return NM.runs_per_value(_n1(spark, sf), "e_message").select("target_id", "e_message", "n_runs")


def q_shared_prefixes(spark, sf):
    n1 = _n1(spark, sf)
    pod = NM.shared_prefixes(n1, "e_pod").withColumn("kind", F.lit("pod"))
    ns = NM.shared_prefixes(n1, "e_ns").withColumn("kind", F.lit("ns"))
    return pod.unionByName(ns).select("kind", "target_id", "prefix", "n_runs")


def q_build_sequences(spark, sf):
    s = _analysis(spark, sf).sequences
    return s.select("target_id", "job_id", _arr("sequence").alias("sequence_text"), F.col("n_events").cast("long"))


def q_first_row_per_run(spark, sf):
    a = _analysis(spark, sf)
    f = EV.first_row_per_run(a.events, ["job_name", "job_url", "d_from_time", "d_event_id"])
    return f.select("target_id", "job_id", "job_name", "job_url", _ts("d_from_time").alias("d_from_time"), "d_event_id")


def q_first_token_occurrence(spark, sf):
    a = _analysis(spark, sf)
    f = EV.first_token_occurrence(a.events)
    return f.select("target_id", "job_id", "event", "e_event_id", _ts("e_from_time").alias("e_from_time"))


def q_distinct_pairs(spark, sf):
    return NM.distinct_pairs(_n1(spark, sf), ["target_id", "job_id", "e_pod"])


def q_pattern_share(spark, sf):
    a = _analysis(spark, sf)
    return RP.patterns_table(a).select("target_id", "rank", "freq", "n_runs", "share_pct")


# ---------------------------------------------------------------------------- windows, order
def _positions(rows, id):
    """Place of every row in its run, and the number of rows before the run, from the ordinal of an ordered table."""
    first = rows.groupBy("target_id", "job_id").agg(F.min("ordinal").alias("run_start"))
    return rows.join(first, ["target_id", "job_id"]).select(
        "target_id", "job_id", id, (F.col("ordinal") - F.col("run_start") + 1).alias("pos"), "run_start")


def q_context_order(spark, sf):
    a = _analysis(spark, sf)
    return _positions(a.write_context(CA.cache_path(spark, "context_order", a.snapshot)), "e_event_id")


def q_evidence_order(spark, sf):
    a = _analysis(spark, sf)
    return _positions(RP.ordered_evidence(a, CA.cache_path(spark, "evidence_order", a.snapshot)), "event_id")


def q_first_anchor(spark, sf):
    a = _analysis(spark, sf)
    return a.anchors.select("target_id", "job_id", "d_event_id", _ts("d_from_time").alias("d_from_time"))


def q_collapse_repeats(spark, sf):
    e = _analysis(spark, sf).events
    return e.select("target_id", "job_id", "pos", "e_event_id", "event")


def q_ordered_events(spark, sf):
    a = _analysis(spark, sf)
    df = SQ.add_tokens(SQ.drop_all_null(SQ.normalize_context(a.context)))
    w = SQ.event_order()
    return df.select("target_id", "job_id", "e_event_id", F.row_number().over(w).alias("pos"))


def q_topk_patterns(spark, sf):
    # top-k of all frequent patterns (not only closed ones), exact
    a = _analysis(spark, sf)
    freq = MN.frequent_sequences_by_key(a.sequences, 2)
    top = MN.topk_patterns(freq, 25)
    return top.select("target_id", "rank", "freq", _arr("pattern").alias("pattern_text"))


# ---------------------------------------------------------------------------- normalisation
def q_mask_pod_suffix(spark, sf):
    return _analysis(spark, sf).flat.select("event_id", X.mask_pod_suffix("pod").alias("pod_masked"))


def q_node_flag(spark, sf):
    return _analysis(spark, sf).flat.select("event_id", X.node_flag("node").alias("node_flag"),
                                            X.node_flag("node", compat=True).alias("node_flag_compat"))


def q_mask_hex(spark, sf):
    return _analysis(spark, sf).flat.select("event_id", X.mask_hex("message").alias("message_hex"))


def q_mask_numbers(spark, sf):
    return _analysis(spark, sf).flat.select("event_id", X.mask_message("message").alias("message_masked"))


def q_blank_rare(spark, sf):
    a = _analysis(spark, sf)
    n = SQ.normalize_context(a.context)
    return n.select("target_id", "job_id", "e_event_id", "e_message", "e_pod", "e_ns", "e_node")


def q_event_token(spark, sf):
    e = _analysis(spark, sf).events
    return e.select("target_id", "job_id", "e_event_id", "event")


def q_event_hash(spark, sf):
    e = _analysis(spark, sf).events
    n = e.groupBy("target_id").agg(F.countDistinct("event_hash").alias("n_hashes"), F.countDistinct("event").alias("n_tokens"))
    return e.join(n, "target_id").select("target_id", "e_event_id", F.md5("event").alias("event_md5"), "n_hashes", "n_tokens")


def q_is_subsequence(spark, sf):
    a = _analysis(spark, sf)
    # every run against every pattern of its target (at most k)
    j = a.sequences.join(a.patterns.select("target_id", "rank", "pattern"), "target_id")
    return j.select("target_id", "rank", "job_id", X.is_subsequence("sequence", "pattern").cast("string").alias("contains"))


# ---------------------------------------------------------------------------- mining
def q_frequent_sequences(spark, sf):
    a = _analysis(spark, sf)
    f = MN.frequent_sequences_by_key(a.sequences, 2)
    return f.select("target_id", _arr("pattern").alias("pattern_text"), F.size("pattern").alias("length"), "freq")


def q_closed_sequences(spark, sf):
    a = _analysis(spark, sf)
    f = MN.closed_sequences(MN.frequent_sequences_by_key(a.sequences, 2))
    return f.select("target_id", _arr("pattern").alias("pattern_text"), "freq")


def q_topk_closed(spark, sf):
    p = _analysis(spark, sf).patterns
    return p.select("target_id", "rank", "freq", _arr("pattern").alias("pattern_text"))


def q_pattern_support_detail(spark, sf):
    a = _analysis(spark, sf)
    s = RP.support_table(a)
    return s.select("target_id", "rank", "freq", "job_id", "job_name", "job_url",
                    _ts("d_from_time").alias("d_from_time"), "d_backend_disruption_name", *_fields("d_payload", "d_payload"))


def q_all_targets_patterns(spark, sf):
    a = _analysis(spark, sf)
    return RP.patterns_table(a).select("target_id", "rank", "freq", "n_runs", "share_pct", "length",
                                       "pattern_text", "display")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: top-k closed patterns of every target with share and readable items (sf0.001)."""
    return queries()["all_targets_patterns"](spark, SF_SMOKE)


def _long_ints(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Integral columns as bigint, so the column types equal the oracle's."""
    from pyspark.sql import types as T

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        small = (T.IntegerType, T.ShortType, T.ByteType)
        return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
                           for f in df.schema.fields])
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _optional(module: str):
    """A module of the corpus part, or None where that part (or one of its own modules) is not installed."""
    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as e:
        if e.name in ("precursor.llm", "precursor.llm.queries", "corpus_pipeline"):
            return None
        raise


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _long_ints(v) for k, v in _QUERIES.items()}
    if corpus := _optional("precursor.llm.queries"):
        out |= corpus.QUERIES
    if pipeline := _optional("corpus_pipeline"):
        out["pipeline"] = pipeline.run
    return out


# ---------------------------------------------------------------------------- oracle
def _t(c: str, alias: str | None = None) -> str:
    return f"{O.ts(c)} AS {alias or c.split('.')[-1]}"


_PAYLOAD = "(SELECT event_id AS p_id, source AS p_source, reason AS p_reason, message AS p_message, pod AS p_pod FROM ivf)"


def _payload_sql(prefix: str) -> str:
    return ", ".join(f"p_{n} AS {prefix}_{n}" for n in ("source", "reason", "message", "pod"))


_EVIDENCE = """SELECT a.target_id, a.job_id, e.event_id, e.from_time, e.origin, e.source
        FROM ivf e JOIN anchors a ON e.job_id = a.job_id
        WHERE (a.target_id, a.job_id) IN (SELECT target_id, job_id FROM support)
          AND e.origin <> 'observer'
          AND e.from_time BETWEEN a.d_from_time - INTERVAL 3 DAY AND a.d_from_time + INTERVAL 1 HOUR"""
_FLAGS = "SELECT event_id, {} FROM ivf"
_CTX_SQL = ", ".join(_CTX_COLS)
_ORACLE = {
    "scan_intervals": f"SELECT job_id, event_id, {_t('from_time')}, {_t('to_time')}, origin, payload_in FROM iv",
    "scan_jobs": f"SELECT job_id, job_name, job_url, {_t('job_start')} FROM jb",
    "context_rowcount": "SELECT t.target_id, coalesce(n.n_rows, 0) AS n_rows FROM (SELECT unnest([0, 1, 2]::BIGINT[]) AS target_id) t "
                        "LEFT JOIN (SELECT target_id, count(*) AS n_rows FROM ctx GROUP BY target_id) n USING (target_id)",
    "context_cache": f"SELECT target_id, job_id, e_event_id, {_t('e_from_time')}, e_diff, e_source, e_reason FROM ctx",
    "report_nested": f"""SELECT s.target_id, lb.target_label, s.rank, s.freq, s.job_id, a.job_name, a.job_url,
        {_t('a.d_from_time', 'd_from_time')}, a.d_backend_disruption_name,
        (SELECT count(*) FROM examples x WHERE x.target_id = s.target_id AND x.rank = s.rank AND x.job_id = s.job_id) AS n_examples,
        (SELECT string_agg(CAST(x.example_event_id AS VARCHAR), ',' ORDER BY x.item_pos, x.event, x.example_time)
           FROM examples x WHERE x.target_id = s.target_id AND x.rank = s.rank AND x.job_id = s.job_id) AS example_ids,
        (SELECT string_agg(coalesce(xi.message, '_'), ',' ORDER BY x.item_pos, x.event, x.example_time)
           FROM examples x JOIN ivf xi ON xi.event_id = x.example_event_id
          WHERE x.target_id = s.target_id AND x.rank = s.rank AND x.job_id = s.job_id) AS example_messages,
        iv.source AS target_source
      FROM support s JOIN anchors a ON a.target_id = s.target_id AND a.job_id = s.job_id
      JOIN iv ON iv.event_id = a.d_event_id
      JOIN (SELECT CAST(0 AS BIGINT) AS target_id, '[KEYS_BACKEND_DISRUPTION_NAME LIKE "backend-9%"]' AS target_label
            UNION ALL SELECT 1, '[SOURCE LIKE "purchase"]' UNION ALL SELECT 2, '[KEYS_BACKEND_DISRUPTION_NAME LIKE "backend-%"]') lb
        ON lb.target_id = s.target_id""",
    "target_summary": """SELECT t.target_id, t.target_label, t.ignore_label,
        coalesce(na.n, 0) AS n_anchors, coalesce(nc.n, 0) AS n_context_rows, coalesce(r.n_runs, 0) AS n_runs,
        coalesce(np.n, 0) AS n_patterns,
        CASE WHEN coalesce(nc.n, 0) = 0 THEN 'no context' ELSE 'ok' END AS status
      FROM (SELECT CAST(0 AS BIGINT) AS target_id, '[KEYS_BACKEND_DISRUPTION_NAME LIKE "backend-9%"]' AS target_label, '' AS ignore_label
            UNION ALL SELECT 1, '[SOURCE LIKE "purchase"]', '[REASON LIKE "view"]'
            UNION ALL SELECT 2, '[KEYS_BACKEND_DISRUPTION_NAME LIKE "backend-%"]', '') t
      LEFT JOIN (SELECT target_id, count(*) AS n FROM anchors GROUP BY 1) na USING (target_id)
      LEFT JOIN (SELECT target_id, count(*) AS n FROM ctx GROUP BY 1) nc USING (target_id)
      LEFT JOIN runs r USING (target_id)
      LEFT JOIN (SELECT target_id, count(*) AS n FROM topk GROUP BY 1) np USING (target_id)""",
    "payload_coalesce": "SELECT event_id, payload_in, source FROM iv",
    "json_scalar": "SELECT event_id, source, level, display, locator_type, locator, keys_namespace, keys_ns, disruption, "
                   "route, connection, backend, node, pod, container, uid, \"row\", reason, cause, message, \"count\", "
                   "roles, constructed FROM ivf",
    "namespace_fallback": "SELECT event_id, keys_namespace, keys_ns, namespace FROM ivf",
    "payload_text": "SELECT event_id, source, display, backend, reason, message, pod, node, keys_ns FROM ivf",
    "anchor_projection": f"SELECT a.target_id, a.job_id, job_name, job_url, row_num, {_t('d_from_time')}, {_t('d_to_time')}, d_reason, "
                         "d_cause, d_ns, d_disruption, d_route, d_connection, d_backend_disruption_name, d_message, "
                         f"d_event_id, {_payload_sql('d_payload')} FROM anchors a JOIN {_PAYLOAD} ON p_id = a.d_event_id",
    "context_projection": f"SELECT {_CTX_SQL}, row_num, {_t('d_from_time')}, {_t('e_from_time')}, {_t('e_to_time')}, "
                          f"{_payload_sql('e_payload')}, d_payload_source FROM ctx c "
                          f"JOIN {_PAYLOAD} ON p_id = c.e_event_id JOIN (SELECT event_id AS o_id, source AS d_payload_source FROM ivf) ON o_id = c.d_event_id",
    "context_order": """SELECT target_id, job_id, e_event_id, pos, CAST(coalesce(sum(n) OVER (ORDER BY target_id, job_id
                          RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS BIGINT) AS run_start FROM (
        SELECT target_id, job_id, e_event_id, row_number() OVER w AS pos,
               CASE WHEN row_number() OVER w = 1 THEN count(*) OVER (PARTITION BY target_id, job_id) ELSE 0 END AS n
        FROM ctx WINDOW w AS (PARTITION BY target_id, job_id ORDER BY e_from_time, e_event_id))""",
    "evidence_order": f"""SELECT target_id, job_id, event_id, pos, CAST(coalesce(sum(n) OVER (ORDER BY target_id, job_id
                          RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS BIGINT) AS run_start FROM (
        SELECT target_id, job_id, event_id, row_number() OVER w AS pos,
               CASE WHEN row_number() OVER w = 1 THEN count(*) OVER (PARTITION BY target_id, job_id) ELSE 0 END AS n
        FROM ({_EVIDENCE}) WINDOW w AS (PARTITION BY target_id, job_id ORDER BY from_time, event_id))""",
    "relative_position": ("SELECT target_id, job_id, e_event_id, e_diff, "
                          "date_sub('second', e_from_time, d_from_time) AS diff_seconds FROM ctx", {"noise": False}),
    "time_bounds": f"SELECT target_id, job_id, {_t('d_from_time - INTERVAL 3 DAY', 'win_start')}, "
                   f"{_t('d_from_time + INTERVAL 1 HOUR', 'win_end')} FROM anchors",
    "crit_field_like": _FLAGS.format("CAST(coalesce(backend, '') LIKE 'backend-9%' AS VARCHAR) AS m"),
    "crit_field_op": _FLAGS.format("CAST(reason <> 'Began' AS VARCHAR) AS m, CAST(pod LIKE 'view-%' AS VARCHAR) AS l"),
    "crit_field_bool": _FLAGS.format("CAST(display = 'true' AS VARCHAR) AS m, CAST(display = 'false' AS VARCHAR) AS f"),
    "crit_namespace": _FLAGS.format("CAST(namespace = 'ns-3' AS VARCHAR) AS m, CAST(namespace LIKE 'ns-1%' AS VARCHAR) AS n"),
    "crit_target_and_ignore": _FLAGS.format(
        "CAST(coalesce(source, '') LIKE 'click' AND coalesce(namespace, '') LIKE 'ns-1%' AS VARCHAR) AS t, "
        "CAST(coalesce(reason, '') LIKE 'click' AND coalesce(message, '') LIKE '%code-%' AS VARCHAR) AS i, "
        "CAST(coalesce(source, '') LIKE 'view' AS VARCHAR) AS t0, 'false' AS i0"),
    "crit_disruption_preset": _FLAGS.format(
        "CAST(backend LIKE 'backend-%' AND coalesce(reason, '') LIKE 'Began' AND display = 'true' AS VARCHAR) AS m"),
    "multi_target_match": "SELECT event_id, concat_ws(',', "
                          "CASE WHEN coalesce(backend, '') LIKE 'backend-9%' THEN '0' END, "
                          "CASE WHEN coalesce(source, '') LIKE 'purchase' THEN '1' END, "
                          "CASE WHEN coalesce(backend, '') LIKE 'backend-%' THEN '2' END) AS targets FROM ivf",
    "job_name_filter": "SELECT job_id, job_name FROM jb WHERE job_name LIKE '%Customer%' AND job_name NOT LIKE '%FURNITURE%'",
    "time_range_filter": f"SELECT event_id, {_t('from_time')} FROM ivf WHERE from_time BETWEEN {O.RANGE}",
    "anchor_admission": "SELECT event_id, origin, display FROM ivf WHERE origin <> 'observer' AND display = 'true'",
    "exclude_ended_3vl": "SELECT event_id, reason FROM ivf WHERE reason NOT LIKE 'Ended'",
    "exclude_self": ("SELECT target_id, job_id, e_event_id, e_source, e_reason FROM ctx",
                     {"closing": False, "began": False, "noise": False}),
    "exclude_ignored": ("SELECT target_id, e_reason, count(*) AS n_rows FROM ctx GROUP BY target_id, e_reason",
                        {"closing": False, "began": False, "noise": False}),
    "began_unless_liveness": "SELECT event_id, reason, backend FROM ivf WHERE reason NOT LIKE 'Began' OR backend LIKE '%-3'",
    "noise_rule_3vl": ("SELECT target_id, job_id, e_event_id, e_source FROM ctx WHERE "
                       + "(" + O.NOISE.replace("a.d_backend_disruption_name", "d_backend_disruption_name")
                       .replace("e.namespace", "e_ns").replace("e.source", "e_source").replace("e.reason", "e_reason")
                       .replace("e.message", "e_message") + ") IS NOT FALSE", {"noise": False}),
    "drop_all_null": ("SELECT target_id, job_id, e_event_id FROM norm WHERE coalesce(e_source, e_ns, e_pod, e_container, "
                      "e_reason, e_cause, e_roles, e_row, e_message) IS NOT NULL", {"began": False, "keep_null": True}),
    "pattern_item_rows": "SELECT e.target_id, e.job_id, e.e_event_id, e.event FROM evs e WHERE EXISTS "
                         "(SELECT 1 FROM topk_items t WHERE t.target_id = e.target_id AND t.event = e.event)",
    "join_intervals_jobs": "SELECT target_id, job_id, event_id, job_name FROM adm",
    "window_join": f"""SELECT a.target_id, a.job_id, e.event_id AS e_event_id FROM ivf e JOIN anchors a ON e.job_id = a.job_id
        WHERE e.from_time BETWEEN {O.RANGE}
          AND e.from_time BETWEEN a.d_from_time - INTERVAL 3 DAY AND a.d_from_time + INTERVAL 1 HOUR""",
    "window_evidence": f"SELECT target_id, job_id, event_id, {_t('from_time')}, origin, source FROM ({_EVIDENCE})",
    "generalize_prefix": "SELECT kind, target_id, name, mapped FROM name_map",
    "pattern_support": "SELECT target_id, rank, freq, job_id, pattern_text FROM support",
    "pattern_examples": f"SELECT target_id, rank, x.job_id, item_pos, event, example_event_id, {_t('example_time')}, "
                        f"{_payload_sql('example')} FROM examples x JOIN {_PAYLOAD} ON p_id = x.example_event_id",
    "token_dictionary": "SELECT DISTINCT target_id, event, md5(event) AS event_md5, e_reason FROM evs",
    "runs_per_message": "SELECT target_id, e_message, n_runs FROM msg_runs",
    "shared_prefixes": "SELECT kind, target_id, prefix, n_runs FROM shared",
    "build_sequences": "SELECT target_id, job_id, sequence_text, n_events FROM seqs",
    "first_row_per_run": f"SELECT DISTINCT target_id, job_id, job_name, job_url, {_t('d_from_time')}, d_event_id FROM evs",
    "first_token_occurrence": f"SELECT target_id, job_id, event, e_event_id, {_t('e_from_time')} FROM first_occ",
    "distinct_pairs": "SELECT DISTINCT target_id, job_id, e_pod FROM n1",
    "pattern_share": "SELECT t.target_id, t.rank, t.freq, r.n_runs, (t.freq * 100) // r.n_runs AS share_pct "
                     "FROM topk t JOIN runs r USING (target_id)",
    "first_anchor": f"SELECT target_id, job_id, d_event_id, {_t('d_from_time')} FROM anchors",
    "collapse_repeats": "SELECT target_id, job_id, pos, e_event_id, event FROM evs",
    "ordered_events": "SELECT target_id, job_id, e_event_id, pos FROM ord",
    "topk_patterns": """SELECT target_id, rank, freq, pattern_text FROM (
        SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY freq DESC, length DESC, pattern_text) AS rank
        FROM freqpat) WHERE rank <= 25""",
    "mask_pod_suffix": "SELECT event_id, regexp_replace(pod, '-[0-9a-fA-F]{8,10}(-.*|$)', '-xxxxxxxxxx', 'g') AS pod_masked FROM ivf",
    "node_flag": "SELECT event_id, CASE WHEN node IS NULL THEN 'no' ELSE 'yes' END AS node_flag, "
                 "regexp_replace(coalesce(node, 'no'), '[a-zA-Z0-9.-]+', 'yes', 'g') AS node_flag_compat FROM ivf",
    "mask_hex": "SELECT event_id, regexp_replace(message, '[0-9a-fA-F]{8,30}', 'xxxxxxxxxx', 'g') AS message_hex FROM ivf",
    "mask_numbers": "SELECT event_id, regexp_replace(regexp_replace(message, '[0-9a-fA-F]{8,30}', 'xxxxxxxxxx', 'g'), "
                    "'[0-9]{1,30}', '###', 'g') AS message_masked FROM ivf",
    "blank_rare": "SELECT target_id, job_id, e_event_id, e_message, e_pod, e_ns, e_node FROM norm",
    "event_token": "SELECT target_id, job_id, e_event_id, event FROM evs",
    "event_hash": "SELECT target_id, e_event_id, md5(event) AS event_md5, n_tokens AS n_hashes, n_tokens FROM evs "
                  "JOIN (SELECT target_id, count(DISTINCT event) AS n_tokens FROM evs GROUP BY target_id) USING (target_id)",
    "is_subsequence": """SELECT s.target_id, t.rank, s.job_id,
        CASE WHEN EXISTS (SELECT 1 FROM support p WHERE p.target_id = s.target_id AND p.rank = t.rank AND p.job_id = s.job_id)
             THEN 'true' ELSE 'false' END AS contains
      FROM seqs s JOIN topk t ON t.target_id = s.target_id""",
    "frequent_sequences": "SELECT target_id, pattern_text, length, freq FROM freqpat",
    "closed_sequences": "SELECT target_id, pattern_text, freq FROM closedpat",
    "topk_closed": "SELECT target_id, rank, freq, pattern_text FROM topk",
    "pattern_support_detail": f"""SELECT s.target_id, s.rank, s.freq, s.job_id, a.job_name, a.job_url,
        {_t('a.d_from_time', 'd_from_time')}, a.d_backend_disruption_name, {_payload_sql('d_payload')}
      FROM support s JOIN anchors a ON a.target_id = s.target_id AND a.job_id = s.job_id
      JOIN {_PAYLOAD} ON p_id = a.d_event_id""",
    "all_targets_patterns": """SELECT t.target_id, t.rank, t.freq, r.n_runs, (t.freq * 100) // r.n_runs AS share_pct,
        t.length, t.pattern_text, replace(t.pattern_text, ':', ' ') AS display
      FROM topk t JOIN runs r USING (target_id)""",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, v in _ORACLE.items():
        sel, flags = v if isinstance(v, tuple) else (v, {})
        out[k] = O.q("\nSELECT * FROM (" + sel + ") AS oracle_result", **flags)
    if corpus := _optional("precursor.llm.queries"):
        out |= corpus.ORACLE_SQL
    if (pipeline := _optional("corpus_pipeline")) and pipeline.ORACLE_SQL:
        out["pipeline"] = pipeline.ORACLE_SQL
    return out
