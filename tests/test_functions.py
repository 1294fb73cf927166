"""Scalar functions and criteria on hand-made rows (quirks Q1, Q2, Q5-Q7, Q15, Q17)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from precursor.functions import criteria as C
from precursor.functions import payload as P
from precursor.functions import text as X
from precursor.operators.context import relative_position


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")


def collect(df, col="r"):
    return [r[col] for r in df.orderBy("i").collect()]


def test_json_scalar_only_scalars(spark):
    rows = ['{"a":{"b":"x"},"n":12,"t":true,"z":null,"o":{"q":1},"arr":[1],"h-y":"d","s":"{lit"}', "not json", None]
    df = one_col(spark, rows)
    v = P.parse_payload("v")
    out = df.select("i", *[P.json_scalar(v, p).alias(n) for n, p in
                           [("ab", "$.a.b"), ("n", "$.n"), ("t", "$.t"), ("z", "$.z"), ("o", "$.o"),
                            ("arr", "$.arr"), ("hy", "$.h-y"), ("s", "$.s"), ("miss", "$.nope.x")]])
    r = out.orderBy("i").collect()
    assert r[0].asDict() == {"i": 0, "ab": "x", "n": "12", "t": "true", "z": None, "o": None, "arr": None,
                             "hy": "d", "s": "{lit", "miss": None}
    assert all(v is None for k, v in r[1].asDict().items() if k != "i")
    assert all(v is None for k, v in r[2].asDict().items() if k != "i")


def test_flatten_equals_scalar_extraction(spark):
    from precursor.schema import PAYLOAD_FIELDS
    payloads = [
        '{"source":"a","locator":"str","message":{"reason":"r"}}',
        '{"source":{"x":1},"locator":{"keys":{"pod":["p"]}}}',
        '{"source":12.50,"display":true,"message":{"count":3}}',
        '{"source":null,"locator":null}', "not json",
        '{"source":"{abc","message":{"humanMessage":"[x] y"}}',
        '{"locator":{"type":"t","keys":{"ns":"x","backend-disruption-name":"b"}},"message":{"reason":{"a":1}}}',
        '{"locator":[1],"source":"s"}', "[1,2]", None,
    ]
    rows = [(str(i), i, None, None, "o", p if i % 2 else None, None if i % 2 else p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "job_id string, event_id long, from_time timestamp_ntz, to_time timestamp_ntz, "
                                     "origin string, interval string, interval_json string")
    flat = {r["event_id"]: r.asDict() for r in P.flatten_intervals(df).collect()}
    exact = {r["event_id"]: r.asDict() for r in df.select(
        "event_id", *[P.json_scalar_text(F.coalesce("interval", "interval_json"), p).alias(n)
                      for n, p in PAYLOAD_FIELDS.items()]).collect()}
    for i in exact:
        for n in PAYLOAD_FIELDS:
            assert flat[i][n] == exact[i][n], (i, n)
    assert flat[6]["keys_ns"] == "x" and flat[6]["namespace"] == "x" and flat[6]["backend"] == "b"
    assert flat[0]["locator"] == "str" and flat[6]["locator"] is None


def test_field_like_never_null_and_ops_propagate_null(spark):
    df = one_col(spark, ["Began", "DisruptionBegan", None])
    like = C.FieldLike("v", "Began")             # '=' on a string -> LIKE with if_null ''
    ne = C.FieldLike("v", "Began", op="!=")       # other operators keep NULL
    lk = C.FieldLike("v", "%Began", op="LIKE")    # explicit LIKE keeps NULL too
    out = df.select("i", like.column().alias("a"), (~like.column()).alias("na"), ne.column().alias("b"),
                    lk.column().alias("c")).orderBy("i").collect()
    assert [r["a"] for r in out] == [True, False, False]
    assert [r["na"] for r in out] == [False, True, True]
    assert [r["b"] for r in out] == [False, True, None]
    assert [r["c"] for r in out] == [True, True, None]


def test_exclude_closing_null_reason(spark):
    from precursor.operators.context import exclude_closing
    df = spark.createDataFrame([(0, "Ended"), (1, "Began"), (2, None)], "i int, reason string")
    assert sorted(r["i"] for r in df.where(exclude_closing("Ended")).collect()) == [1]           # Q6
    assert sorted(r["i"] for r in df.where(exclude_closing("Ended", True)).collect()) == [1, 2]


def test_criterion_on_json_path_outside_the_flat_schema(spark):
    df = spark.createDataFrame([(0, '{"message":{"foo":"bar-1"}}'), (1, '{"message":{"foo":{"x":1}}}'), (2, None)],
                               "i int, payload string")
    out = df.select("i", C.FieldLike("$.message.foo", "bar-%").column().alias("r"))
    assert collect(out) == [True, False, False]


def test_bool_criterion_compares_text(spark):
    df = one_col(spark, ["true", "false", None])
    out = df.select("i", C.FieldLike("v", True).column().alias("r"))
    assert collect(out) == [True, False, None]


def test_target_ignore_defaults_to_false_and_labels():
    t = C.Target([C.FieldLike(C.Field.SOURCE, "x"), C.FieldLike(C.Field.REASON, "y")])
    assert t.label == '[SOURCE LIKE "x" AND REASON LIKE "y"]'
    assert t.ignore_label == ""
    assert "false" in str(t.ignore_condition()).lower()


def test_disruption_preset(spark):
    t = C.disruption_target("backend-%", began_reason="Began")
    df = spark.createDataFrame([(0, "backend-1", "Began", "true"), (1, None, "Began", "true"),
                                (2, "backend-1", "Ended", "true"), (3, "backend-2", "Began", "false")],
                               "i int, backend string, reason string, display string")
    assert collect(df.select("i", t.condition().alias("r"))) == [True, None, False, False]


def test_noise_rule_kleene(spark):
    # Q7: NULL anchor backend AND TRUE event predicate -> NULL -> row dropped by the filter
    rule = C.NoiseRule(F.col("d_backend_disruption_name") == "lb", F.col("source") == "Etcd")
    df = spark.createDataFrame([(0, "lb", "Etcd"), (1, "lb", "x"), (2, None, "Etcd"), (3, None, "x"), (4, "o", "Etcd")],
                               "i int, d_backend_disruption_name string, source string")
    assert sorted(r["i"] for r in df.where(rule.keep()).collect()) == [1, 3, 4]


def test_node_flag_intent_and_compat(spark):
    df = one_col(spark, [None, "ip-10-0-1", "", "a_b"])
    out = df.select("i", X.node_flag("v").alias("r"), X.node_flag("v", compat=True).alias("c")).orderBy("i").collect()
    assert [r["r"] for r in out] == ["no", "yes", "yes", "yes"]
    assert [r["c"] for r in out] == ["yes", "yes", "", "yes_yes"]   # Q1


def test_masks(spark):
    pods = ["p-0123abcd", "p-0123abcd-xyz", "p-0123456789", "p-0123abc", "p-0123456789a-z", "a-12345678-1-2"]
    df = one_col(spark, pods)
    assert collect(df.select("i", X.mask_pod_suffix("v").alias("r"))) == [
        "p-xxxxxxxxxx", "p-xxxxxxxxxx", "p-xxxxxxxxxx", "p-0123abc", "p-0123456789a-z", "a-xxxxxxxxxx"]
    msgs = ["took 12ms ref deadbeef00", "id " + "a" * 35 + " " + "b" * 70, "v1.2 x 123456789", None]
    out = collect(one_col(spark, msgs).select("i", X.mask_message("v").alias("r")))
    assert out[0] == "took ###ms ref xxxxxxxxxx"
    # Q15: greedy {8,30}: 35 hex -> one mask + 5 left; 70 hex -> three masks in a row
    assert out[1] == "id xxxxxxxxxxaaaaa " + "xxxxxxxxxx" * 3
    assert out[2] == "v###.### x xxxxxxxxxx"
    assert out[3] is None


def test_relative_position_boundaries(spark):
    d = dt.datetime(2024, 1, 2, 0, 0, 10)
    offs = [-40.0, -1.0, -0.999, -0.5, 0.0, 0.5, 0.999, 1.0, 1.001]
    rows = [(i, d, d + dt.timedelta(seconds=o)) for i, o in enumerate(offs)]
    df = spark.createDataFrame(rows, "i int, d timestamp_ntz, e timestamp_ntz")
    out = collect(df.select("i", relative_position("d", "e").alias("r")))
    # e before d by >= 1 s -> before_d; within 1 s -> at_d; after by >= 1 s -> after_d (Q17)
    assert out == ["before_d", "before_d", "at_d", "at_d", "at_d", "at_d", "at_d", "after_d", "after_d"]


def test_event_token_and_hash(spark):
    df = spark.createDataFrame([("before_d", None)], "e_diff string, e_source string")
    r = df.select(X.event_token(["e_diff", "e_source"]).alias("t")).first()["t"]
    assert r == "e_diff=before_d:e_source=_"
    h = df.select(X.event_hash(X.event_token(["e_diff", "e_source"])).alias("h")).first()["h"]
    h2 = df.select(X.event_hash(F.lit("e_diff=before_d:e_source=_")).alias("h")).first()["h"]
    assert h == h2 and isinstance(h, int)


def test_display_text(spark):
    df = one_col(spark, ["e_diff=at_d:e_message=a:b"])
    assert collect(df.select("i", X.display_text("v").alias("r"))) == ["e_diff=at_d e_message=a b"]  # Q20


def test_dash_prefixes(spark):
    df = one_col(spark, ["a-b-c", "-x", "a--b", "solo"])
    out = collect(df.select("i", X.dash_prefixes("v").alias("r")))
    assert out == [["a", "a-b", "a-b-c"], ["", "-x"], ["a", "a-", "a--b"], ["solo"]]


def test_scalars_of_many_paths_parse_once(spark):
    paths = {"source": "$.source", "pod": "$.locator.keys.pod", "message": "$.message.humanMessage"}
    rows = ['{"source":"a","locator":{"keys":{"pod":"{p"}},"message":{"humanMessage":"x\\n{y"}}',
            '{"source":{"x":1},"locator":{"keys":{"pod":["p"]}},"message":{"humanMessage":"[z"}}',
            '{"source":12.50,"locator":"gone"}', '{"source":""}', "not json", "[1]", None]
    df = one_col(spark, rows)
    out = P.with_scalars(df, paths, "v")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 3
    want = df.select("i", *[P.json_scalar_text("v", p).alias(n) for n, p in paths.items()]).orderBy("i").collect()
    assert out.select("i", *paths).orderBy("i").collect() == want
    assert want[0].message == "x\n{y" and want[1].source is None and want[1].message == "[z"
