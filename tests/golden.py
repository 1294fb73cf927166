"""Hand-made native intervals and jobs (FIXTURES §1) and a brute-force run of the whole analysis."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections import defaultdict

import brute as B

T0 = dt.datetime(2024, 11, 12, 10, 0, 0)
OBS = "e2e-events-observer.json"
LB = "service-load-balancer-with-pdb-reused-connections"


def _payload(source=None, reason=None, backend=None, display=True, ns=None, namespace=None, pod=None, node=None,
             message=None, extra_keys=None, extra_msg=None):
    keys = {k: v for k, v in {"ns": ns, "namespace": namespace, "pod": pod, "node": node,
                               "backend-disruption-name": backend}.items() if v is not None}
    keys.update(extra_keys or {})
    msg = {k: v for k, v in {"reason": reason, "humanMessage": message}.items() if v is not None}
    msg.update(extra_msg or {})
    p = {"source": source, "display": display, "locator": {"type": "x", "keys": keys}, "message": msg}
    return {k: v for k, v in p.items() if v is not None}


def build():
    """(intervals rows, jobs rows) in the native schema."""
    rows = []
    eid = [1000]

    def add(job, secs, payload, origin="collector.json", where="interval"):
        eid[0] += 1
        text = payload if isinstance(payload, str) or payload is None else json.dumps(payload)
        t = T0 + dt.timedelta(seconds=secs)
        rows.append({"job_id": job, "event_id": eid[0], "from_time": t, "to_time": t + dt.timedelta(seconds=1),
                     "origin": origin,
                     "interval": text if where in ("interval", "both") else None,
                     "interval_json": (text if where in ("interval_json", "both") else None)
                     if where != "both" else '{"source":"ignored"}'})
        return eid[0]

    # --- run J1: load-balancer anchor (noise rule active) --------------------------------------
    add("J1", -5, _payload("Disruption", "DisruptionBegan", LB), origin=OBS)           # observer: not an anchor
    add("J1", -10, _payload("Disruption", "DisruptionBegan", LB, display=False))       # display false: not an anchor
    add("J1", 0, _payload("Disruption", "DisruptionBegan", LB))                        # the anchor
    add("J1", -40, _payload("KubeEvent", "Pulled", ns="app-a", pod="web-0123abcd-x1", message="pulled 12 images"))
    add("J1", -40.001, _payload("KubeEvent", "Pulled", ns="app-a", message="too early"))
    add("J1", -0.5, _payload("KubeEvent", "Killing", namespace="app-b", pod="db-0123456789", node="ip-1",
                             message="killing deadbeef00"), where="interval_json")
    add("J1", 0.5, _payload("KubeEvent", "Killing", namespace="app-b", pod="db-0123456789", message="again"))
    add("J1", 1, _payload("Alert", "Firing", message="CPU high 99"), where="both")
    add("J1", 1.001, _payload("Alert", "Firing", message="too late"))
    add("J1", -30, _payload("KubeEvent", None, message="null reason"))                 # dropped (Q6)
    add("J1", -29, _payload("Disruption", "DisruptionEnded", "other-x"))               # closing interval: dropped
    add("J1", -28, _payload("Disruption", "DisruptionBegan", "ingress-to-x"))          # began, not liveness: dropped
    add("J1", -27, _payload("Disruption", "DisruptionBegan", "x-liveness-y", message="live"))  # kept
    add("J1", -26, _payload("KubeEvent", "Pulled", namespace="openshift-kube-apiserver"))      # noise: dropped
    add("J1", -25, _payload("EtcdLog", "Slow"))                                                # noise: dropped
    add("J1", -24, _payload("Alert", "Firing", message="KubeDaemonSet down"))                  # noise: dropped
    add("J1", -23, _payload("KubeEvent", "FailedScheduling", ns="other"))                      # noise: dropped
    add("J1", -20, _payload("Node", "Ready", pod="agent-0123abc", node="ip-2", message="user 7 code"))
    add("J1", -19, _payload("Node", "Ready", pod="agent-0123abc", node="ip-2", message="user 7 code"))  # repeat
    add("J1", -18, _payload("Node", "Ready", pod="mon-0123456789a-z", message="x"))   # 11 hex digits: not masked
    add("J1", -17, None, where="interval")                                            # no payload at all
    add("J1", -16, "{not json", where="interval_json")                                # malformed
    add("J1", -15, _payload("Odd", "Scalar", message="n", extra_keys={"container": None, "row": 3},
                            extra_msg={"count": 3, "roles": ["a"], "cause": {"x": 1}}))  # Q2 at scalar paths
    add("J1", -14, _payload("KubeEvent", "Pulled", ns="foo-1", pod="-lead"))

    # --- run J2: ingress anchor, shares names with J1 ---------------------------------------------
    add("J2", 100, _payload("Disruption", "DisruptionBegan", "ingress-to-console"))
    add("J2", 100, _payload("Disruption", "DisruptionBegan", "cache-kube-api-new"))   # same time: cache targets
    add("J2", 60, _payload("KubeEvent", "Pulled", ns="app-a", pod="web-0123abcd-q9", message="pulled 3 images"))
    add("J2", 61, _payload("KubeEvent", "Killing", namespace="app-b", pod="db-abcdef0123", message="again"))
    add("J2", 70, _payload("Node", "Ready", pod="agent-0123abc", node="ip-9", message="user 8 code"))
    add("J2", 71, _payload("KubeEvent", "Pulled", ns="foo-2", pod="-dash"))
    add("J2", 72, _payload("KubeEvent", "Pulled", ns="foobar-2"))
    add("J2", 99, _payload("Alert", "Firing", message="CPU high 12"))

    # --- run J7: node-not-ready anchor (NULL backend: noise rule still drops on TRUE, Q7) --------
    add("J7", 200, _payload("NodeUnexpectedNotReady", "Unexpected"))                  # anchor of target 0
    add("J7", 190, _payload("NodeUnexpectedNotReady", "NotReady"))                    # matches the target: excluded
    add("J7", 191, _payload("Other", "NotReady"))                                     # ignore list: excluded
    add("J7", 192, _payload("EtcdLog", "Slow"))                                       # noise with NULL backend: dropped
    add("J7", 193, _payload(None, "NoSource"))                                        # NULL source: NULL -> dropped
    add("J7", 194, _payload("KubeEvent", "Pulled", ns="app-a", pod="web-0123abcd-zz", message="pulled 5 images"))
    add("J7", 195, _payload("Alert", "Firing", message="CPU high 1"))
    add("J7", 196, _payload("KubeEvent", "Pulled", ns="app-a", pod="web-0123abcd-zz", message="pulled 5 images"))
    add("J7", 197, _payload("Alert", "Firing", message="CPU high 1"))
    add("J7", 150, _payload("Disruption", "DisruptionBegan", "service-load-balancer-new"))  # LB anchor, J7
    add("J7", 140, _payload("KubeEvent", "Pulled", ns="app-a", pod="web-0123abcd-zz", message="pulled 5 images"))
    add("J7", 141, _payload("Alert", "Firing", message="CPU high 1"))
    add("J7", 142, _payload("KubeEvent", "Killing", namespace="app-b", pod="db-0123456789", message="again"))

    # --- anchors without context, outside the job filter, not in jobs -----------------------------
    add("J6", 300, _payload("Disruption", "DisruptionBegan", "oauth-api-x"))          # no context
    add("J3", 0, _payload("Disruption", "DisruptionBegan", LB))                       # job name excluded
    add("J5", 0, _payload("Disruption", "DisruptionBegan", LB))                       # job start outside range
    add("J9", 0, _payload("Disruption", "DisruptionBegan", LB))                       # not in the job table
    add("J9", -3, _payload("Alert", "Firing", message="CPU high 1"))

    jobs = [
        {"job_id": "J1", "job_name": "periodic-4.18-azure-e2e", "job_url": "u/J1", "job_start": T0 - dt.timedelta(hours=1)},
        {"job_id": "J2", "job_name": "periodic-4.18-azure-upgrade", "job_url": "u/J2", "job_start": T0},
        {"job_id": "J3", "job_name": "periodic-4.18-azure-single-node", "job_url": "u/J3", "job_start": T0},
        {"job_id": "J5", "job_name": "periodic-4.18-azure-late", "job_url": "u/J5",
         "job_start": dt.datetime(2024, 12, 30)},
        {"job_id": "J6", "job_name": "periodic-4.18-azure-quiet", "job_url": "u/J6", "job_start": T0},
        {"job_id": "J7", "job_name": "periodic-4.18-azure-nodes", "job_url": "u/J7", "job_start": T0},
        {"job_id": "J8", "job_name": "periodic-4.17-aws", "job_url": "u/J8", "job_start": T0},
    ]
    return rows, jobs


# ------------------------------------------------------------------------------------------------
# brute-force analysis with the reference preset (written from the definitions)
FIELDS = {"source": "$.source", "display": "$.display", "keys_namespace": "$.locator.keys.namespace",
          "keys_ns": "$.locator.keys.ns", "backend": "$.locator.keys.backend-disruption-name",
          "node": "$.locator.keys.node", "pod": "$.locator.keys.pod", "container": "$.locator.keys.container",
          "row": "$.locator.keys.row", "reason": "$.message.reason", "cause": "$.message.cause",
          "message": "$.message.humanMessage", "roles": "$.message.roles"}
FAMILIES = ["service-load-balancer-%", "ingress-to-%", "cache-kube-api-%", "cache-%", "kube-api-%",
            "openshift-api-%", "oauth-api-%"]


def _like0(v, pat):  # '=' criterion on a string: IFNULL(v, '') LIKE pat
    return B.like(v if v is not None else "", pat)


def targets():
    node = (lambda r: _like0(r["source"], "NodeUnexpectedNotReady"), lambda r: _like0(r["reason"], "NotReady"))
    fams = [((lambda f: lambda r: _like0(r["backend"], f))(f), lambda r: False) for f in FAMILIES]
    return [node, *fams]


def noise(d, e):
    ns = e["namespace"]
    kube = B.and3(B.eq(e["source"], "KubeEvent"),
                  B.or3(B.eq(ns, "openshift-kube-apiserver"), B.eq(ns, "openshift-image-registry"),
                        B.eq(ns, "openshift-cluster-csi-drivers"), B.eq(e["reason"], "FailedScheduling")))
    ev = B.or3(kube, B.eq(e["source"], "EtcdLog"),
               B.and3(B.eq(e["source"], "Alert"), B.like(e["message"], "%KubeDaemon%")))
    return B.and3(B.eq(d["backend"], LB), ev)


def run(rows, jobs, start, end, lookback=40, lookahead=1, k=25):
    flat = []
    for r in rows:
        text = r["interval"] if r["interval"] is not None else r["interval_json"]
        f = {n: B.scalar(text, p) for n, p in FIELDS.items()}
        f["namespace"] = f["keys_namespace"] if f["keys_namespace"] is not None else f["keys_ns"]
        flat.append({**r, **f})
    ok_jobs = {j["job_id"] for j in jobs if start <= j["job_start"] <= end
               and all(x in j["job_name"] for x in ("4.18", "azure")) and "single-node" not in j["job_name"]}
    tg = targets()
    out = {"anchors": {}, "context": defaultdict(list)}
    for t, (cond, ign) in enumerate(tg):
        for job in sorted(ok_jobs):
            cands = [r for r in flat if r["job_id"] == job and start <= r["from_time"] <= end
                     and r["origin"] is not None and r["origin"] != OBS and r["display"] == "true" and cond(r) is True]
            if not cands:
                continue
            d = min(cands, key=lambda r: (r["from_time"], r["event_id"]))
            out["anchors"][(t, job)] = d
            for e in flat:
                if e["job_id"] != job or not (start <= e["from_time"] <= end):
                    continue
                if not (d["from_time"] - dt.timedelta(seconds=lookback) <= e["from_time"]
                        <= d["from_time"] + dt.timedelta(seconds=lookahead)):
                    continue
                keep = B.and3(B.not3(B.like(e["reason"], "DisruptionEnded")),
                              B.or3(B.not3(B.like(e["reason"], "DisruptionBegan")), B.like(e["backend"], "%-liveness-%")),
                              B.not3(cond(e)), B.not3(ign(e)), B.not3(noise(d, e)))
                if keep is True:
                    secs = (d["from_time"] - e["from_time"]).total_seconds()
                    diff = int(secs)  # truncates toward zero
                    pos = "at_d" if diff == 0 else ("after_d" if diff <= 0 else "before_d")
                    out["context"][t].append({**e, "e_diff": pos})
    # normalise, tokenise, order, collapse per target
    seqs, events = {}, {}
    for t, ctx in out["context"].items():
        for e in ctx:
            e["pod_m"] = re.sub(r"-[0-9a-fA-F]{8,10}(-.*|$)", "-xxxxxxxxxx", e["pod"]) if e["pod"] is not None else None
            m = e["message"]
            if m is not None:
                m = re.sub(r"[0-9]{1,30}", "###", re.sub(r"[0-9a-fA-F]{8,30}", "xxxxxxxxxx", m))
            e["msg_m"] = m
        pmap = B.prefix_map(sorted({(e["job_id"], e["pod_m"]) for e in ctx}, key=str))
        nmap = B.prefix_map(sorted({(e["job_id"], e["namespace"]) for e in ctx}, key=str))
        runs_per_msg = defaultdict(set)
        for e in ctx:
            if e["msg_m"] is not None:
                runs_per_msg[e["msg_m"]].add(e["job_id"])
        for e in ctx:
            vals = {"e_diff": e["e_diff"], "e_source": e["source"], "e_node": "no" if e["node"] is None else "yes",
                    "e_ns": nmap.get(e["namespace"]), "e_pod": pmap.get(e["pod_m"]), "e_container": e["container"],
                    "e_reason": e["reason"], "e_cause": e["cause"], "e_roles": e["roles"], "e_row": e["row"],
                    "e_message": None if e["msg_m"] is None else ("" if len(runs_per_msg[e["msg_m"]]) < 2 else e["msg_m"])}
            e.update(vals)
            e["event"] = ":".join(f"{k}={'_' if v is None else v}" for k, v in vals.items())
        by_run = defaultdict(list)
        for e in ctx:
            by_run[e["job_id"]].append(e)
        for job, es in by_run.items():
            def key(e):
                return (e["from_time"], *[(v is None, v or "") for v in (e["e_source"], e["e_ns"], e["e_reason"],
                                                                         e["e_message"])], e["event"], e["event_id"])
            es.sort(key=key)
            kept = [e for i, e in enumerate(es) if i == 0 or es[i - 1]["event"] != e["event"]]
            seqs.setdefault(t, {})[job] = [e["event"] for e in kept]
            events[(t, job)] = kept
    patterns = {t: B.topk(B.closed(B.supports(s)), k) for t, s in seqs.items()}
    support = {(t, rank + 1, job) for t, pats in patterns.items() for rank, (p, _) in enumerate(pats)
               for job, s in seqs[t].items() if B.is_subsequence(p, s)}
    examples = set()
    for (t, rank, job) in support:
        p = patterns[t][rank - 1][0]
        for i, item in enumerate(p):
            first = min((e for e in events[(t, job)] if e["event"] == item),
                        key=lambda e: (e["from_time"], e["event_id"]))
            examples.add((t, rank, job, i, first["event_id"]))
    return {"anchors": {k: v["event_id"] for k, v in out["anchors"].items()},
            "context": {(t, e["job_id"], e["event_id"], e["e_diff"]) for t, c in out["context"].items() for e in c},
            "sequences": {(t, j): s for t, d in seqs.items() for j, s in d.items()},
            "patterns": {(t, i + 1, tuple(p), f) for t, ps in patterns.items() for i, (p, f) in enumerate(ps)},
            "support": support, "examples": examples}
