"""Table schemas and payload paths.

Native input tables:

* ``intervals``: one row per time-stamped interval of a job run, with its JSON
  payload in ``interval`` or ``interval_json``.
* ``jobs``: one row per job run.

The payload is schema-on-read JSON.  It is parsed once by
:func:`precursor.functions.payload.flatten_intervals` into the flat interval
table whose columns are listed in :data:`PAYLOAD_FIELDS`.
"""

from __future__ import annotations

from pyspark.sql import types as T

from precursor import fixed as fx

INTERVALS_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("from_time", T.TimestampNTZType()),
    T.StructField("to_time", T.TimestampNTZType()),
    T.StructField("origin", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("interval_json", T.StringType()),
])

JOBS_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("job_url", T.StringType()),
    T.StructField("job_start", T.TimestampNTZType()),
])

# flat column name -> JSON path inside the payload
PAYLOAD_FIELDS: dict[str, str] = {
    "source": fx.PATH_SOURCE,
    "level": fx.PATH_LEVEL,
    "display": fx.PATH_DISPLAY,
    "locator_type": fx.PATH_LOCATOR_TYPE,
    "locator": fx.PATH_LOCATOR,
    "keys_namespace": fx.PATH_KEYS_NAMESPACE,
    "keys_ns": fx.PATH_KEYS_NS,
    "disruption": fx.PATH_KEYS_DISRUPTION,
    "route": fx.PATH_KEYS_ROUTE,
    "connection": fx.PATH_KEYS_CONNECTION,
    "backend": fx.PATH_KEYS_BACKEND_DISRUPTION_NAME,
    "node": fx.PATH_KEYS_NODE,
    "pod": fx.PATH_KEYS_POD,
    "container": fx.PATH_KEYS_CONTAINER,
    "uid": fx.PATH_KEYS_UID,
    "row": fx.PATH_KEYS_ROW,
    "reason": fx.PATH_REASON,
    "cause": fx.PATH_CAUSE,
    "message": fx.PATH_MESSAGE_HUMAN_MESSAGE,
    "count": fx.PATH_MESSAGE_COUNT,
    "roles": fx.PATH_MESSAGE_ROLES,
    "constructed": fx.PATH_MESSAGE_ANNOTATIONS_CONSTRUCTED,
}

# Columns of the flat interval table, in order.
FLAT_COLUMNS: list[str] = (
    ["job_id", "event_id", "from_time", "to_time", "origin", "payload"]
    + list(PAYLOAD_FIELDS)
    + ["namespace"]
)

# Anchor (``d_*``) projection: output column -> flat column.
ANCHOR_FIELDS: dict[str, str] = {
    "d_from_time": "from_time",
    "d_to_time": "to_time",
    "d_reason": "reason",
    "d_cause": "cause",
    "d_ns": "namespace",
    "d_disruption": "disruption",
    "d_route": "route",
    "d_connection": "connection",
    "d_backend_disruption_name": "backend",
    "d_message": "message",
    "d_event_id": "event_id",
}

# Context (``e_*``) projection: output column -> flat column.
CONTEXT_FIELDS: dict[str, str] = {
    "e_event_id": "event_id",
    "e_from_time": "from_time",
    "e_to_time": "to_time",
    "e_source": "source",
    "e_ns": "namespace",
    "e_node": "node",
    "e_pod": "pod",
    "e_container": "container",
    "e_uid": "uid",
    "e_row": "row",
    "e_reason": "reason",
    "e_cause": "cause",
    "e_constructed": "constructed",
    "e_count": "count",
    "e_roles": "roles",
    "e_message": "message",
    "e_locator": "locator",
}

# The event fields that make up a token, in order.
EVENT_FIELDS: list[str] = list(fx.EVENT_FIELDS)

# Order of events inside one run (after ``e_from_time``); see ordered_events.
EVENT_SORT_FIELDS: list[str] = list(fx.EVENT_SORT_FIELDS)
