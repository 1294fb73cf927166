"""JSON payload functions (P1-P4) and the parse-once flattening of intervals.

Scalars are read from payload text by ``from_json`` with a string leaf per path: once per row for all
fields in :func:`with_scalars`, for a single path in :func:`json_scalar_text`, by the same rule.
Flattening is meant to be written (see :mod:`precursor.sources.flat`) so that all later predicates
are plain column filters that reach the parquet scan.  Shown payloads are parsed into Variants.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precursor.schema import PAYLOAD_FIELDS

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def variant_path(path: str) -> str:
    """``$.a.b-c`` -> ``$.a['b-c']`` (bracket form for keys that are not identifiers)."""
    if not path.startswith("$"):
        raise ValueError(f"JSON path must start with '$': {path!r}")
    parts = [p for p in path[1:].split(".") if p]
    out = "$"
    for p in parts:
        out += f".{p}" if _IDENT.match(p) else "['" + p.replace("'", "\\'") + "']"
    return out


def payload_coalesce(primary: Column | str = "interval", fallback: Column | str = "interval_json") -> Column:
    """The first non-null payload column."""
    return F.coalesce(_c(primary), _c(fallback))


def parse_payload(payload: Column | str) -> Column:
    """Payload text -> Variant; malformed text gives NULL."""
    return F.try_parse_json(_c(payload))


def json_scalar(value: Column, path: str) -> Column:
    """Scalar at ``path`` of a parsed payload as a string, for payloads that are nested in a report.

    ``value`` is a Variant column (see :func:`parse_payload`), which is NULL for text with repeated keys
    and holds numbers by value; P2 on payload text is :func:`json_scalar_text`.  Strings come back
    unquoted, numbers and booleans as their text.  NULL when the path is absent,
    holds JSON null, an object or an array - the semantics of a scalar extractor.
    """
    p = variant_path(path)
    text = F.try_variant_get(value, p, "string")
    # Objects and arrays come back as JSON text starting with '{' or '['; only such
    # values pay for the type check (CASE evaluates its branches lazily).
    maybe_container = text.startswith("{") | text.startswith("[")
    kind = F.schema_of_variant(F.try_variant_get(value, p, "variant"))
    is_container = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(maybe_container & is_container, F.lit(None).cast("string")).otherwise(text)


#: Leaf types that only an object, and only an array, can be read as.
_CONTAINERS = (T.MapType(T.StringType(), T.StringType()), T.ArrayType(T.StringType()))


def _like_container(text: Column) -> Column:
    return text.startswith("{") | text.startswith("[")


def _scalar(text: Column, read_as: list[Column], path: str) -> Column:
    """P2's rule on the string leaf ``text`` that ``from_json`` gives at ``path``.

    A leaf over an object or an array holds its JSON text.  Only text that starts like one is looked at
    again: ``read_as`` are the payload parsed with each of the leaf types of containers.
    """
    held = reduce(Column.__or__, [_leaf(s, path).isNotNull() for s in read_as])
    return F.when(_like_container(text) & held, F.lit(None).cast("string")).otherwise(text)


def json_scalar_text(payload: Column | str, path: str) -> Column:
    """Scalar at ``path`` of payload text as a string, NULL for a missing path, JSON null, an object or an array.

    Strings come back unquoted, numbers and booleans as the parser writes them (``1.0E20``), of
    repeated keys the last counts; malformed text gives NULL.
    """
    p, one = _c(payload), {"": path}
    text = _leaf(F.from_json(p, _payload_struct(one)), path)
    return _scalar(text, [F.from_json(p, _payload_struct(one, kind)) for kind in _CONTAINERS], path)


def namespace_fallback(namespace: Column | str = "keys_namespace", ns: Column | str = "keys_ns") -> Column:
    """``namespace`` with ``ns`` as the fallback spelling."""
    return F.coalesce(_c(namespace), _c(ns))


def payload_text(value: Column) -> Column:
    """Canonical JSON text of a parsed payload (keys sorted, NULL when malformed)."""
    return F.to_json(value)


def _payload_struct(paths: dict[str, str], leaf: T.DataType | None = None) -> T.StructType:
    """Nested struct schema with a leaf (a string) for every path that is not a prefix of another path."""
    tree: dict = {}
    for path in paths.values():
        node = tree
        for part in path[2:].split("."):
            node = node.setdefault(part, {})

    def build(node: dict) -> T.StructType:
        return T.StructType([T.StructField(k, build(v) if v else leaf or T.StringType()) for k, v in node.items()])
    return build(tree)


def _leaf(struct: Column, path: str) -> Column:
    c = struct
    for part in path[2:].split("."):
        c = c.getField(part)
    return c


def flatten_intervals(intervals: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Native interval rows -> flat interval table (one column per payload field).

    Input columns: job_id, event_id, from_time, to_time, origin, interval,
    interval_json.  The payload is parsed once per row by ``from_json`` into a
    nested struct with string leaves, and every field follows the rule of
    :func:`json_scalar_text`.
    """
    base = intervals.select(
        "job_id", "event_id", "from_time", "to_time", "origin",
        payload_coalesce("interval", "interval_json").alias("payload"),
    )
    return with_scalars(base, fields or PAYLOAD_FIELDS).withColumn("namespace", namespace_fallback())


def with_scalars(rows: DataFrame, fields: dict[str, str], payload: str = "payload") -> DataFrame:
    """``rows`` with one column per field: the scalar at its path of payload text, parsed once for all fields."""
    s = F.col("__s")
    leaf_paths = set(fields.values())
    inner = {p for p in leaf_paths if any(q.startswith(p + ".") for q in leaf_paths)}
    # rows with a leaf that looks like a container are parsed again, once per kind of container for all fields;
    # one text of all leaves, each behind a line end, is searched instead of every leaf
    lines = F.concat_ws("\n", F.lit(""), *[_leaf(s, p) for p in sorted(leaf_paths - inner)])
    read_as = [F.when(F.col("__again"), F.from_json(payload, _payload_struct(fields, kind))).alias(f"__c{i}")
               for i, kind in enumerate(_CONTAINERS)]
    base = (rows.withColumn("__s", F.from_json(payload, _payload_struct(fields)))
            .withColumn("__again", lines.contains("\n{") | lines.contains("\n["))
            .select("*", *read_as))
    cols = []
    for name, path in fields.items():
        if path in inner:
            # An object here parses into a non-null struct: scalar extraction is NULL.
            node = _leaf(s, path)
            col = F.when(node.isNull() & F.get_json_object(payload, path).isNotNull(), json_scalar_text(payload, path))
        else:
            text = _leaf(s, path)
            col = F.when(F.col("__again"), _scalar(text, [F.col(f"__c{i}") for i in range(len(_CONTAINERS))], path)).otherwise(text)
        cols.append(col.alias(name))
    return base.select(*rows.columns, *cols)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
