"""Randomised end-to-end check: the whole analysis on generated native intervals vs the brute-force run."""

from __future__ import annotations

import datetime as dt
import json

import golden
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from precursor.plans.analysis import Analysis
from precursor.plans.config import reference_config
from precursor.schema import INTERVALS_SCHEMA, JOBS_SCHEMA

# Row templates (source, reason, backend, pod, namespace, message, display): a small set, so that
# equal events occur in several runs and patterns exist; they include the edge cases of the
# exclusions (NULL reason, closing and began reasons, liveness backend, noise rows).
TEMPLATES = [
    ("KubeEvent", "Pulled", None, "web-0123abcd-1", "app-a", "pulled 12 images", True),
    ("KubeEvent", "Pulled", None, "web-0123abcd-2", "app-a", "pulled 3 images", True),
    ("KubeEvent", "Killing", None, "db-1", "foo-1", None, False),
    ("Alert", "Firing", None, None, None, "msg 1", True),
    ("Alert", "Firing", None, None, None, "KubeDaemon down", True),
    ("EtcdLog", "Slow", None, None, "openshift-kube-apiserver", None, True),
    ("Node", None, None, "-lead", "app-b", "no reason", True),
    ("Disruption", "DisruptionEnded", "ingress-to-a", None, None, None, True),
    ("Disruption", "DisruptionBegan", "x-liveness-y", None, None, "live", True),
    ("Disruption", "DisruptionBegan", golden.LB, None, None, None, True),
    ("NodeUnexpectedNotReady", "NotReady", None, None, None, None, True),
]

interval = st.tuples(
    st.sampled_from(["J1", "J2", "J3", "J4"]),
    st.integers(-45_000, 3_000),                 # offset in ms round the anchors at +2 s
    st.integers(0, len(TEMPLATES) - 1), st.booleans(), st.booleans(),
)


def build(items):
    rows = []
    for i, (job, off, tpl, use_ns, observer) in enumerate(items):
        src, reason, backend, pod, ns, msg, display = TEMPLATES[tpl]
        keys = {k: v for k, v in {"pod": pod, ("ns" if use_ns else "namespace"): ns,
                                   "backend-disruption-name": backend}.items() if v is not None}
        payload = {"source": src, "display": display, "locator": {"keys": keys},
                   "message": {k: v for k, v in {"reason": reason, "humanMessage": msg}.items() if v is not None}}
        t = golden.T0 + dt.timedelta(milliseconds=off)
        text = json.dumps(payload)
        rows.append({"job_id": job, "event_id": 10 + i, "from_time": t, "to_time": t + dt.timedelta(seconds=1),
                     "origin": golden.OBS if observer else "collector.json",
                     "interval": text if i % 2 else None, "interval_json": None if i % 2 else text})
    jobs = [{"job_id": j, "job_name": f"periodic-4.18-azure-{j}", "job_url": f"u/{j}", "job_start": golden.T0}
            for j in ("J1", "J2", "J3", "J4")]
    # every run also gets an anchor of a family the random rows never use, late enough that
    # most random rows fall inside its window
    for n, j in enumerate(("J1", "J2", "J3", "J4")):
        t = golden.T0 + dt.timedelta(milliseconds=2_000)
        text = json.dumps({"source": "Disruption", "display": True,
                           "locator": {"keys": {"backend-disruption-name": "oauth-api-anchor"}},
                           "message": {"reason": "DisruptionBegan"}})
        rows.append({"job_id": j, "event_id": 1 + n, "from_time": t, "to_time": t + dt.timedelta(seconds=1),
                     "origin": "collector.json", "interval": text, "interval_json": None})
    return rows, jobs


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(interval, min_size=8, max_size=40))
def test_random_intervals_match_brute_force(spark, items):
    rows, jobs = build(items)
    iv = spark.createDataFrame([tuple(r[f.name] for f in INTERVALS_SCHEMA) for r in rows], INTERVALS_SCHEMA)
    jb = spark.createDataFrame([tuple(j[f.name] for f in JOBS_SCHEMA) for j in jobs], JOBS_SCHEMA)
    a = Analysis(spark, iv, jb, reference_config("2024-11-11", 15))
    want = golden.run(rows, jobs, dt.datetime(2024, 11, 11), dt.datetime(2024, 11, 26))
    assert {(r["target_id"], r["job_id"]): r["d_event_id"] for r in a.anchors.collect()} == want["anchors"]
    assert {(r["target_id"], r["job_id"], r["e_event_id"], r["e_diff"]) for r in a.context.collect()} == want["context"]
    assert {(r["target_id"], r["job_id"]): list(r["sequence"]) for r in a.sequences.collect()} == want["sequences"]
    assert {(r["target_id"], r["rank"], tuple(r["pattern"]), r["freq"]) for r in a.patterns.collect()} == want["patterns"]
    assert {(r["target_id"], r["rank"], r["job_id"]) for r in a.support.collect()} == want["support"]
