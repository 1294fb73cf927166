"""DuckDB SQL oracle for the queries in ``__spark_entry__``.

Independent re-statement of every stage in plain SQL over the driver's
``events`` and ``customer`` views (adapter of FIXTURES.md §2).  Payload fields
are computed straight from their definitions (no JSON), so the Spark side's
JSON build + parse is checked too.  Mining is exact: every ordered subsequence
of every run is enumerated with a recursive CTE (small at sf0.01).

Conventions shared with ``__spark_entry__``: timestamps are compared as text
``YYYY-MM-DD HH:MM:SS.ffffff``, arrays as text joined with `` > ``.
"""

from __future__ import annotations

RANGE = "TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-29 00:00:00'"

# Target conditions of the adapter workload: (condition, ignore condition), `{p}` = row alias prefix.
TARGETS = [
    ("coalesce({p}backend, '') LIKE 'backend-9%'", "FALSE"),
    ("coalesce({p}source, '') LIKE 'purchase'", "coalesce({p}reason, '') LIKE 'view'"),
    ("coalesce({p}backend, '') LIKE 'backend-%'", "FALSE"),
]
NOISE = ("(a.d_backend_disruption_name = 'backend-9' AND ((e.source = 'click' AND (e.namespace LIKE 'ns-1%' "
         "OR e.reason = 'Ended')) OR (e.source = 'view' AND e.message LIKE '%code-%')))")

# Adapter rows with few different tokens, and the others.
COARSE, FINE = "(k % 5 < 3)", "(k % 5 >= 3)"
PLAIN_FIELDS = ["source", "level", "display", "reason", "cause", '"count"', "roles", "constructed", "message"]
LOCATOR_FIELDS = ["locator_type", "keys_namespace", "keys_ns", "disruption", "route", "connection", "backend", "node", "pod",
                  "container", "uid", '"row"']

EVENT_FIELDS = ["e_diff", "e_source", "e_node", "e_ns", "e_pod", "e_container", "e_reason", "e_cause",
                "e_roles", "e_row", "e_message"]


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


def _case(kind: int, p: str) -> str:
    whens = " ".join(f"WHEN {i} THEN ({t[kind].format(p=p)})" for i, t in enumerate(TARGETS))
    return f"(CASE a.target_id {whens} END)"


def ctes(closing: bool = True, began: bool = True, self_excl: bool = True, ignore_excl: bool = True,
         noise: bool = True, keep_null: bool = False) -> str:
    """The WITH clause (without the word WITH) of all stages."""
    cand = "\n      UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS target_id, * FROM ivf WHERE {c.format(p='')}" for i, (c, _) in enumerate(TARGETS))
    ctx_where = [f"e.from_time BETWEEN {RANGE}",
                 "e.from_time BETWEEN a.d_from_time - INTERVAL 3 DAY AND a.d_from_time + INTERVAL 1 HOUR"]
    if closing:
        ctx_where.append("(e.reason NOT LIKE 'Ended'" + (" OR e.reason IS NULL)" if keep_null else ")"))
    if began:
        ctx_where.append("(e.reason NOT LIKE 'Began' OR e.backend LIKE '%-3')")
    if self_excl:
        ctx_where.append(f"NOT {_case(0, 'e.')}")
    if ignore_excl:
        ctx_where.append(f"NOT {_case(1, 'e.')}")
    if noise:
        ctx_where.append(f"NOT {NOISE}")
    token = " || ':' || ".join(f"'{f}=' || coalesce({f}, '_')" for f in EVENT_FIELDS)
    return f"""
ev AS (
  SELECT event_id, ts, user_id, event_type,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         md5(CAST(event_id AS VARCHAR)) AS h
  FROM events
),
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, {COARSE} AS coarse, event_id % 31 = 7 AS nothing,
    NOT ({COARSE}) AND k % 23 = 4 AS gone,
    CASE WHEN {COARSE} THEN date_trunc('hour', ts) ELSE ts END AS from_time,
    CASE WHEN k % 25 = 24 THEN 'observer' ELSE 'collector' END AS origin,
    CASE WHEN event_id % 31 <> 7 AND (event_id % 29 = 3 OR event_id % 2 = 0) THEN 'interval' ELSE 'interval_json' END AS payload_in,
    event_type AS source, CASE WHEN k % 2 = 0 THEN 'Info' END AS level,
    CASE WHEN k % 3 <> 0 OR event_type <> 'error' THEN 'true' ELSE 'false' END AS display,
    CASE WHEN event_type = 'view' AND k % 10 = 0 THEN NULL
         WHEN event_type = 'signup' AND k < 30 THEN 'Ended'
         WHEN event_type = 'error' THEN 'Began'
         ELSE event_type END AS reason,
    CASE WHEN {FINE} AND k % 13 = 3 THEN 'cause-' || CAST(k % 3 AS VARCHAR) END AS cause,
    CASE WHEN k % 9 = 4 THEN CAST(k AS VARCHAR) END AS "count",
    CASE WHEN {FINE} AND k % 17 = 3 THEN 'worker' END AS roles,
    CASE WHEN {FINE} AND k % 19 = 4 THEN 'yes' END AS constructed,
    CASE WHEN {COARSE} THEN 'state changed' WHEN k % 7 = 0 THEN NULL
         WHEN k % 7 < 3 THEN 'took ' || CAST(k AS VARCHAR) || 'ms ref ' || substr(h, 1, 12)
         WHEN k % 7 < 5 THEN 'user ' || CAST(user_id AS VARCHAR) || ' code-' || event_type
         ELSE event_type || ' by u' || chr(CAST(97 + user_id % 26 AS INTEGER)) || chr(CAST(97 + event_id % 26 AS INTEGER))
              || chr(CAST(97 + k % 26 AS INTEGER)) END AS message,
    CASE WHEN {FINE} AND k % 4 = 0 THEN 'Node' END AS locator_type,
    CASE WHEN {COARSE} THEN 'platform'
         WHEN k % 3 <> 0 THEN 'ns-' || CAST(user_id % 20 AS VARCHAR) || '-' || CAST(k % 10 AS VARCHAR) END AS keys_namespace,
    CASE WHEN {FINE} AND k % 3 = 0 THEN 'ns-' || CAST(k % 10 AS VARCHAR) END AS keys_ns,
    CASE WHEN event_type = 'error' THEN 'dis-' || CAST(k % 4 AS VARCHAR) END AS disruption,
    CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'route-' || CAST(k % 3 AS VARCHAR) END AS route,
    CASE WHEN event_type = 'error' AND k % 2 = 1 THEN 'new' END AS connection,
    CASE WHEN event_type = 'error' THEN 'backend-' || CAST(k % 10 AS VARCHAR) END AS backend,
    CASE WHEN {FINE} AND k % 4 <> 0 THEN 'ip-10-0-' || CAST(k AS VARCHAR) END AS node,
    CASE WHEN {FINE} AND event_type <> 'signup' THEN event_type || '-' || CAST(k % 10 AS VARCHAR) || '-u'
         || CAST(user_id % 75 AS VARCHAR) || '-' || substr(h, 1, 10) || '-' || substr(h, 11, 5) END AS pod,
    CASE WHEN {FINE} AND k % 11 = 0 THEN 'c' || CAST(k % 3 AS VARCHAR) END AS container,
    CASE WHEN {FINE} AND k % 11 = 3 THEN substr(h, 1, 8) END AS uid,
    CASE WHEN {FINE} AND k % 11 = 4 THEN CAST(k AS VARCHAR) END AS "row"
  FROM ev
),
iv AS (
  SELECT job_id, event_id, from_time, from_time + INTERVAL 1 SECOND AS to_time, origin, payload_in,
    {", ".join(f"CASE WHEN NOT nothing THEN {c} END AS {c}" for c in PLAIN_FIELDS)},
    CASE WHEN gone AND NOT nothing THEN 'gone' END AS locator,
    {", ".join(f"CASE WHEN NOT nothing AND NOT gone THEN {c} END AS {c}" for c in LOCATOR_FIELDS)}
  FROM raw
),
ivf AS (
  SELECT *, coalesce(keys_namespace, keys_ns) AS namespace FROM iv
),
jb AS (
  SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_mktsegment || '-' || c_name AS job_name,
         'job/' || CAST(c_custkey AS VARCHAR) AS job_url,
         TIMESTAMP '2024-01-01 00:00:00' + CAST(c_custkey % 5 AS INTEGER) * INTERVAL 1 DAY AS job_start
  FROM customer
),
jbf AS (
  SELECT * FROM jb WHERE job_start BETWEEN {RANGE}
    AND job_name LIKE '%Customer%' AND job_name NOT LIKE '%FURNITURE%'
),
cand AS (
  {cand}
),
adm AS (
  SELECT c.*, j.job_name, j.job_url FROM cand c JOIN jbf j ON c.job_id = j.job_id
  WHERE c.origin <> 'observer' AND c.display = 'true' AND c.from_time BETWEEN {RANGE}
),
anchors AS (
  SELECT target_id, job_id, job_name, job_url, from_time AS d_from_time, to_time AS d_to_time,
    reason AS d_reason, cause AS d_cause, namespace AS d_ns, disruption AS d_disruption, route AS d_route,
    connection AS d_connection, backend AS d_backend_disruption_name, message AS d_message, event_id AS d_event_id, rn AS row_num
  FROM (SELECT *, row_number() OVER (PARTITION BY target_id, job_id ORDER BY from_time, event_id) AS rn FROM adm)
  WHERE rn = 1
),
ctx AS (
  SELECT a.*, e.event_id AS e_event_id, e.from_time AS e_from_time, e.to_time AS e_to_time,
    CASE WHEN date_sub('second', e.from_time, a.d_from_time) = 0 THEN 'at_d'
         WHEN date_sub('second', e.from_time, a.d_from_time) <= 0 THEN 'after_d' ELSE 'before_d' END AS e_diff,
    e.source AS e_source, e.namespace AS e_ns, e.node AS e_node, e.pod AS e_pod, e.container AS e_container,
    e.uid AS e_uid, e."row" AS e_row, e.reason AS e_reason, e.cause AS e_cause, e.constructed AS e_constructed,
    e."count" AS e_count, e.roles AS e_roles, e.message AS e_message, e.locator AS e_locator
  FROM ivf e JOIN anchors a ON e.job_id = a.job_id
  WHERE {' AND '.join(ctx_where)}
),
n1 AS (
  SELECT * REPLACE (
    regexp_replace(e_pod, '-[0-9a-fA-F]{{8,10}}(-.*|$)', '-xxxxxxxxxx', 'g') AS e_pod,
    CASE WHEN e_node IS NULL THEN 'no' ELSE 'yes' END AS e_node,
    regexp_replace(regexp_replace(e_message, '[0-9a-fA-F]{{8,30}}', 'xxxxxxxxxx', 'g'), '[0-9]{{1,30}}', '###', 'g') AS e_message)
  FROM ctx
),
pod_pairs AS (SELECT DISTINCT target_id, job_id, e_pod AS name FROM n1 WHERE e_pod IS NOT NULL AND e_pod <> ''),
ns_pairs AS (SELECT DISTINCT target_id, job_id, e_ns AS name FROM n1 WHERE e_ns IS NOT NULL AND e_ns <> ''),
name_pairs AS (SELECT 'pod' AS kind, * FROM pod_pairs UNION ALL SELECT 'ns' AS kind, * FROM ns_pairs),
name_pref AS (
  SELECT kind, target_id, job_id, array_to_string(list_slice(string_split(name, '-'), 1, i), '-') AS prefix
  FROM (SELECT *, unnest(generate_series(1, len(string_split(name, '-')))) AS i FROM name_pairs)
),
shared AS (
  SELECT kind, target_id, prefix, count(DISTINCT job_id) AS n_runs FROM name_pref
  GROUP BY kind, target_id, prefix HAVING count(DISTINCT job_id) >= 2
),
names AS (SELECT DISTINCT kind, target_id, name FROM name_pairs),
name_map AS (
  SELECT n.kind, n.target_id, n.name,
    CASE WHEN max_by(s.prefix, length(s.prefix)) IS NULL OR max_by(s.prefix, length(s.prefix)) = n.name THEN n.name
         ELSE max_by(s.prefix, length(s.prefix)) || '-...' END AS mapped
  FROM names n LEFT JOIN shared s ON s.kind = n.kind AND s.target_id = n.target_id AND starts_with(n.name, s.prefix)
  GROUP BY n.kind, n.target_id, n.name
),
msg_runs AS (
  SELECT target_id, e_message, count(DISTINCT job_id) AS n_runs FROM n1 WHERE e_message IS NOT NULL
  GROUP BY target_id, e_message
),
norm AS (
  SELECT n1.* REPLACE (
    pm.mapped AS e_pod, nm.mapped AS e_ns,
    CASE WHEN mr.n_runs < 2 THEN '' ELSE n1.e_message END AS e_message)
  FROM n1
  LEFT JOIN name_map pm ON pm.kind = 'pod' AND pm.target_id = n1.target_id AND pm.name = n1.e_pod
  LEFT JOIN name_map nm ON nm.kind = 'ns' AND nm.target_id = n1.target_id AND nm.name = n1.e_ns
  LEFT JOIN msg_runs mr ON mr.target_id = n1.target_id AND mr.e_message = n1.e_message
),
tok AS (SELECT *, {token} AS event FROM norm),
ord AS (
  SELECT *,
    row_number() OVER w AS pos,
    lag(event) OVER w AS prev
  FROM tok
  WINDOW w AS (PARTITION BY target_id, job_id ORDER BY e_from_time NULLS LAST, e_source NULLS LAST,
               e_ns NULLS LAST, e_reason NULLS LAST, e_message NULLS LAST, event NULLS LAST, e_event_id NULLS LAST)
),
evs AS (SELECT * EXCLUDE (prev) FROM ord WHERE prev IS NULL OR prev <> event),
seqs AS (
  SELECT target_id, job_id, string_agg(event, ' > ' ORDER BY pos) AS sequence_text, count(*) AS n_events
  FROM evs GROUP BY target_id, job_id
),
runs AS (SELECT target_id, count(DISTINCT job_id) AS n_runs FROM evs GROUP BY target_id),
sub(target_id, job_id, last_pos, pattern_text, length) AS (
  SELECT target_id, job_id, pos, event, CAST(1 AS BIGINT) FROM evs
  UNION ALL
  SELECT s.target_id, s.job_id, i.pos, s.pattern_text || ' > ' || i.event, s.length + 1
  FROM sub s JOIN evs i ON i.target_id = s.target_id AND i.job_id = s.job_id AND i.pos > s.last_pos
),
allpat AS (
  SELECT target_id, pattern_text, length, count(DISTINCT job_id) AS freq FROM sub
  GROUP BY target_id, pattern_text, length
),
freqpat AS (SELECT * FROM allpat WHERE freq >= 2),
dels AS (
  SELECT DISTINCT target_id, freq,
    array_to_string(list_concat(list_slice(l, 1, i - 1), list_slice(l, i + 1, len(l))), ' > ') AS pattern_text
  FROM (SELECT target_id, freq, string_split(pattern_text, ' > ') AS l,
               unnest(generate_series(1, length)) AS i
        FROM freqpat WHERE length > 1)
),
closedpat AS (
  SELECT p.* FROM freqpat p
  WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE d.target_id = p.target_id AND d.freq = p.freq
                    AND d.pattern_text = p.pattern_text)
),
topk AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY freq DESC, length DESC, pattern_text) AS rank
    FROM closedpat)
  WHERE rank <= 25
),
topk_items AS (
  SELECT target_id, rank, freq, pattern_text, length, unnest(string_split(pattern_text, ' > ')) AS event,
         unnest(generate_series(0, length - 1)) AS item_pos
  FROM topk
),
support AS (
  SELECT DISTINCT k.target_id, k.rank, k.freq, k.pattern_text, s.job_id
  FROM topk k JOIN sub s ON s.target_id = k.target_id AND s.pattern_text = k.pattern_text
),
first_occ AS (
  SELECT * FROM (
    SELECT target_id, job_id, event, e_from_time, e_event_id,
      row_number() OVER (PARTITION BY target_id, job_id, event ORDER BY e_from_time, e_event_id) AS r
    FROM evs)
  WHERE r = 1
),
examples AS (
  SELECT s.target_id, s.rank, s.job_id, t.item_pos, t.event, f.e_from_time AS example_time,
         f.e_event_id AS example_event_id
  FROM support s
  JOIN topk_items t ON t.target_id = s.target_id AND t.rank = s.rank
  JOIN first_occ f ON f.target_id = s.target_id AND f.job_id = s.job_id AND f.event = t.event
)
"""


def q(select: str, **flags) -> str:
    return "WITH RECURSIVE " + ctes(**flags) + select
