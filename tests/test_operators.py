"""Operators against brute force on small inputs (names, sequences, mining, support)."""

from __future__ import annotations

import brute
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from precursor.functions.text import is_subsequence
from precursor.operators import evidence as EV
from precursor.operators import mining as MN
from precursor.operators import names as NM

FAST = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def pairs_df(spark, pairs):
    return spark.createDataFrame([(0, r, n) for r, n in pairs], "target_id int, job_id string, name string")


def spark_map(spark, pairs, **kw):
    m = NM.prefix_mapping(pairs_df(spark, pairs), "name", **kw).collect()
    return {r["name"]: r["mapped"] for r in m}


def test_prefix_generalisation_cases(spark):
    pairs = [("1", "foo-1"), ("2", "foo-2"), ("2", "foobar-2"), ("1", "solo-abc"), ("3", "only-in-3"),
             ("1", "same"), ("2", "same"), ("1", "-lead"), ("2", "-dash"), ("1", ""), ("1", None)]
    got = spark_map(spark, pairs)
    assert got == brute.prefix_map(pairs)
    assert got["foobar-2"] == "foo-..."       # Q18: character-level prefix
    assert got["same"] == "same"              # seen in two runs: kept
    assert got["-lead"] == "-..."             # leading dash: the empty prefix is shared
    assert "" not in got                      # empty names are skipped


def test_prefix_token_boundary_option(spark):
    pairs = [("1", "foo-1"), ("2", "foo-2"), ("2", "foobar-2")]
    got = spark_map(spark, pairs, token_boundary=True)
    assert got["foobar-2"] == "foobar-2" and got["foo-1"] == "foo-..."


@FAST
@given(st.lists(st.tuples(st.sampled_from("12345"),
                          st.lists(st.sampled_from(["a", "ab", "b", "", "c1"]), min_size=1, max_size=4)
                          .map("-".join)), min_size=1, max_size=12))
def test_prefix_generalisation_property(spark, pairs):
    assert spark_map(spark, pairs) == brute.prefix_map(pairs)


def test_generalize_prefix_single_column(spark):
    df = spark.createDataFrame([(0, "1", "pod-a-1"), (0, "2", "pod-a-2"), (0, "2", ""), (0, "3", None)],
                               "target_id int, job_id string, e_pod string")
    out = sorted(((r["job_id"], r["e_pod"]) for r in NM.generalize_prefix(df, "e_pod").collect()),
                 key=lambda x: (x[0], x[1] or ""))
    assert out == [("1", "pod-a-..."), ("2", None), ("2", "pod-a-..."), ("3", None)]


def test_generalize_prefixes_two_columns(spark):
    df = spark.createDataFrame([(0, "1", "pod-a-1", "ns-x"), (0, "2", "pod-a-2", "ns-x"), (0, "2", None, "ns-y-2")],
                               "target_id int, job_id string, e_pod string, e_ns string")
    out = NM.generalize_prefixes(df, ["e_pod", "e_ns"]).orderBy("job_id", "e_pod").collect()
    assert [(r["e_pod"], r["e_ns"]) for r in out] == [("pod-a-...", "ns-x"), (None, "ns-..."), ("pod-a-...", "ns-x")]


def test_blank_rare(spark):
    df = spark.createDataFrame([(0, "1", "m1"), (0, "2", "m1"), (0, "1", "m2"), (0, "1", "m2"), (0, "3", None),
                                (1, "1", "m2")], "target_id int, job_id string, e_message string")
    out = sorted((r["target_id"], r["job_id"], r["e_message"]) for r in NM.blank_rare(df, "e_message").collect())
    assert out == [(0, "1", ""), (0, "1", ""), (0, "1", "m1"), (0, "2", "m1"), (0, "3", None), (1, "1", "")]


seq_strategy = st.dictionaries(st.sampled_from([str(i) for i in range(8)]),
                               st.lists(st.sampled_from("abcd"), min_size=1, max_size=6), min_size=1, max_size=7)


def seq_df(spark, seqs, target=0):
    return spark.createDataFrame([(target, j, s) for j, s in seqs.items()],
                                 "target_id int, job_id string, sequence array<string>")


@FAST
@given(seq_strategy)
def test_frequent_and_closed_vs_brute_force(spark, seqs):
    freq = MN.frequent_sequences_by_key(seq_df(spark, seqs), 2)
    got = {tuple(r["pattern"]): r["freq"] for r in freq.collect()}
    want = {p: s for p, s in brute.supports(seqs).items() if s >= 2}
    assert got == want
    got_closed = {tuple(r["pattern"]): r["freq"] for r in MN.closed_sequences(freq).collect()}
    assert got_closed == brute.closed(want)


@FAST
@given(seq_strategy, st.integers(1, 6))
def test_topk_closed_vs_brute_force(spark, seqs, k):
    got = [(tuple(r["pattern"]), r["freq"]) for r in MN.topk_closed(seq_df(spark, seqs), k=k).orderBy("rank").collect()]
    want = brute.topk(brute.closed(brute.supports(seqs)), k)
    assert got == want


def test_topk_independent_of_partitioning(spark):
    seqs = {str(i): list("abcab"[i % 3:]) + list("dc"[: i % 2 + 1]) for i in range(20)}
    a = MN.topk_closed(seq_df(spark, seqs), k=5).orderBy("rank").collect()
    b = MN.topk_closed(seq_df(spark, seqs).repartition(7), k=5).orderBy("rank").collect()
    assert [(tuple(r["pattern"]), r["freq"]) for r in a] == [(tuple(r["pattern"]), r["freq"]) for r in b]


def test_topk_several_targets(spark):
    s0 = {"1": ["a", "b"], "2": ["a", "b"], "3": ["a"]}
    s1 = {"1": ["x"], "2": ["x", "y"], "4": ["y", "x"]}
    df = seq_df(spark, s0, 0).unionByName(seq_df(spark, s1, 1))
    got = {}
    for r in MN.topk_closed(df, k=10).collect():
        got.setdefault(r["target_id"], []).append((tuple(r["pattern"]), r["freq"]))
    assert sorted(got[0]) == sorted(brute.topk(brute.closed(brute.supports(s0)), 10))
    assert sorted(got[1]) == sorted(brute.topk(brute.closed(brute.supports(s1)), 10))


@FAST
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), min_size=1, max_size=3))
def test_is_subsequence_vs_definition(spark, seq, pat):
    df = spark.createDataFrame([(seq, pat)], "s array<string>, p array<string>")
    assert df.select(is_subsequence("s", "p").alias("r")).first()["r"] == brute.is_subsequence(pat, seq)


def test_pattern_support_vs_brute_force(spark):
    seqs = {"1": list("abcab"), "2": list("bca"), "3": list("cab"), "4": list("a")}
    pats = spark.createDataFrame([(0, ["a", "b"], 3, 1), (0, ["c", "a"], 3, 2), (0, ["b", "b"], 1, 3)],
                                 "target_id int, pattern array<string>, freq long, rank int")
    got = sorted((r["rank"], r["job_id"]) for r in EV.pattern_support(seq_df(spark, seqs), pats).collect())
    want = sorted((rank, j) for rank, p in [(1, "ab"), (2, "ca"), (3, "bb")] for j, s in seqs.items()
                  if brute.is_subsequence(list(p), s))
    assert got == want


def test_closed_uses_equal_support_only(spark):
    p = spark.createDataFrame([(0, ["a"], 3), (0, ["a", "b"], 3), (0, ["b"], 4), (0, ["c"], 2), (0, ["c", "a"], 1)],
                              "target_id int, pattern array<string>, freq long")
    got = sorted(tuple(r["pattern"]) for r in MN.closed_sequences(p).collect())
    assert got == [("a", "b"), ("b",), ("c",), ("c", "a")]


def test_one_item_deletions(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "pattern array<string>")
    out = df.select(MN.one_item_deletions().alias("d")).first()["d"]
    assert out == [["b", "c"], ["a", "c"], ["a", "b"]]


def test_support_fraction(spark):
    df = spark.createDataFrame([(7, 3), (2, 31)], "freq long, n_runs long")
    assert [r[0] for r in df.select(MN.support_fraction()).collect()] == [233, 6]


def test_first_anchor_tiebreak(spark):
    from precursor.operators.anchors import first_anchor
    import datetime as dt
    t = dt.datetime(2024, 1, 5)
    df = spark.createDataFrame([(0, "j", 5, t), (0, "j", 3, t), (0, "j", 1, t + dt.timedelta(seconds=1))],
                               "target_id int, job_id string, event_id long, from_time timestamp_ntz")
    assert [r["event_id"] for r in first_anchor(df).collect()] == [3]   # Q14: equal times -> lowest event id


def test_no_rows_on_empty_sequences(spark):
    empty = spark.createDataFrame([], "target_id int, job_id string, sequence array<string>")
    assert MN.topk_closed(empty, k=3).count() == 0


def test_mining_with_colliding_item_ids(spark, monkeypatch):
    """Tokens that share a 64-bit id are numbered apart and give the same patterns."""
    s0 = {"1": list("abcab"), "2": list("bcab"), "3": list("cab"), "4": list("ab")}
    s1 = {"1": list("xyx"), "2": list("yx"), "5": list("xy")}
    seqs = seq_df(spark, s0, 0).unionByName(seq_df(spark, s1, 1))
    rows = lambda: sorted((r["target_id"], r["rank"], tuple(r["pattern"]), r["freq"]) for r in MN.topk_closed(seqs, 5).collect())
    plain = rows()
    monkeypatch.setattr(MN, "_item", lambda token: F.lit(7).cast("long"))
    assert rows() == plain and len(plain) > 4


def test_long_common_sequences_take_few_levels(spark, monkeypatch):
    """20 equal runs of 40 events: the one closed pattern, found by a jump and not item by item."""
    from precursor.operators import closed

    levels = []
    counts = closed._counts
    monkeypatch.setattr(closed, "_counts", lambda *state: levels.append(1) or counts(*state))
    seqs = {str(i): [f"e{j:02}" for j in range(40)] for i in range(20)}
    got = MN.topk_closed(seq_df(spark, seqs), 25).collect()
    assert [(r["pattern"], r["freq"], r["rank"]) for r in got] == [(seqs["0"], 20, 1)]
    assert len(levels) <= 2 * 3  # two in each round of the threshold (20, 5, 2)


def test_repeated_intervals_without_an_id_get_ids_of_their_own(spark):
    from precursor.sources.intervals import read_intervals

    rows = [("j", i // 4, i // 4 + 1, "o", None, '{"k": "v"}') for i in range(12)] + [("j", 0, 1, "o", '{"k": "v"}', None)]
    cols = "job_id string, from_time int, to_time int, origin string, interval string, interval_json string"
    ids = [sorted(r["event_id"] for r in read_intervals(spark, spark.createDataFrame(rows, cols).repartition(n)).collect()) for n in (1, 5)]
    assert len(set(ids[0])) == len(rows)
    assert ids[0] == ids[1]


def test_prefix_candidates_have_shared_lengths(spark):
    """A name gives one candidate per length of a shared prefix, not one per character."""
    from precursor.operators import names as N

    rows = [(0, f"run{r}", f"service-{'x' * 40}-{i}-{r}") for i in range(20) for r in range(2)]
    df = spark.createDataFrame(rows, "target_id int, job_id string, name string")
    shared = N.shared_prefixes(df, "name", with_counts=False)
    names = df.select("target_id", "name").distinct()
    lengths = shared.selectExpr("length(prefix) AS n").distinct().count()
    made = N.prefix_candidates(names, shared, ["target_id"]).count()
    assert made <= names.count() * lengths and lengths <= 4
    mapped = {r["name"]: r["mapped"] for r in N.prefix_mapping(df, "name").collect()}
    assert mapped == {n: f"service-{'x' * 40}-{n.split('-')[2]}-..." for _, _, n in rows}


def test_dictionary_join_spreads_nulls_and_heavy_values(spark):
    """A third NULL, a third one value; no partition holds twice the mean, and the result is the plain join's."""
    from pyspark.sql import functions as F

    from precursor.operators.names import dictionary_join

    df = spark.range(30_000).selectExpr("0 AS target_id", "id", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'hot' ELSE concat('v', id % 5000) END AS m")
    facts = df.where("m IS NOT NULL").selectExpr("target_id", "m", "length(m) AS fact").distinct().where("m <> 'v7'")
    want = sorted(map(tuple, df.join(facts, ["target_id", "m"], "left").select("id", "m", "fact").collect()))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = dictionary_join(df, facts, ["target_id", "m"], "m", ["id"])
        assert sorted(map(tuple, out.select("id", "m", "fact").collect())) == want
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 2 * 30_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_support_candidates_join_on_the_rarest_item(spark):
    """Where every run has the first item, candidate pairs come from an item that few runs have."""
    from precursor.operators import evidence as E

    seqs = spark.createDataFrame([(0, f"r{i}", ["common", f"own{i % 10}"]) for i in range(100)], "target_id int, job_id string, sequence array<string>")
    pats = spark.createDataFrame([(0, ["common", f"own{i}"], 10, i) for i in range(10)], "target_id int, pattern array<string>, freq long, rank int")
    items = seqs.selectExpr("target_id", "job_id", "explode(sequence) AS item")
    assert items.join(E.rarest_items(items, pats), ["target_id", "item"]).count() == 100  # the first item would give 1000
    got = {(r["rank"], r["job_id"]) for r in E.pattern_support(seqs, pats).collect()}
    assert got == {(i % 10, f"r{i}") for i in range(100)}


def test_one_scalar_rule(spark):
    """The parse-once and the ad-hoc path agree on repeated keys, large and exponent numbers, containers and odd text."""
    from precursor.functions import payload as P

    texts = ['{"source": "a", "source": "b"}', '{"source": 100000000000000000000.0}', '{"source": 1e3}', '{"source": 1.50}',
             '{"source": {"a": 1}}', '{"source": [1]}', '{"source": "{not json"}', '{"source": "[1]"}', '{"source": null}', '{"source": true}',
             '{"source": "{\\"a\\": 1}"}', "{", "", "[1]", None, '{"locator": "gone", "source": {}}', '{"message": {"reason": {"x": 1}}, "source": ""}']
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "job_id string, event_id long, interval string").selectExpr(
        "*", "timestamp_ntz'2024-01-01 00:00:00' AS from_time", "timestamp_ntz'2024-01-01 00:00:00' AS to_time", "'o' AS origin",
        "CAST(NULL AS string) AS interval_json")
    flat = P.flatten_intervals(df)
    from precursor.schema import PAYLOAD_FIELDS
    got = flat.select("event_id", *[F_.alias(n) for n, F_ in [(f"a_{n}", P.json_scalar_text("payload", p)) for n, p in PAYLOAD_FIELDS.items()]], *PAYLOAD_FIELDS)
    for r in got.collect():
        for n in PAYLOAD_FIELDS:
            assert r[n] == r[f"a_{n}"], (texts[r["event_id"]], n)
    source = {r["event_id"]: r["source"] for r in got.collect()}
    assert [source[i] for i in range(11)] == ["b", "1.0E20", "1000.0", "1.5", None, None, "{not json", "[1]", None, "true", '{"a": 1}']
    assert [source[i] for i in range(11, 17)] == [None, None, None, None, None, ""]


def test_a_run_over_many_buckets_is_ordered_alike(spark):
    """Events ordered by (run, time bucket) with the border event carried equal the window over the whole run."""
    import datetime as dt

    from pyspark.sql import functions as F

    from precursor.operators import sequences as S

    df = spark.range(4000).selectExpr(
        "0 AS target_id", "CAST(id % 3 AS string) AS job_id", "id AS e_event_id",
        "CASE WHEN id % 97 = 0 THEN NULL ELSE timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(hash(id) % 3000 AS int)) END AS e_from_time",
        *[f"CAST(NULL AS string) AS {c}" for c in S.EVENT_SORT_FIELDS], "concat('t', hash(id, 1) % 2) AS event").repartition(5)
    want = sorted(map(tuple, S.ordered_events(df).select("job_id", "pos", "event", "e_event_id").collect()))
    for minutes in (1, 117, 10**6):
        got = S.ordered_events_by_bucket(df, dt.timedelta(minutes=minutes))
        assert sorted(map(tuple, got.select("job_id", "pos", "event", "e_event_id").collect())) == want
    buckets = df.where("e_from_time IS NOT NULL").select(F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', e_from_time) div 117")).distinct()
    assert buckets.count() > 50 and len(want) < 4000
