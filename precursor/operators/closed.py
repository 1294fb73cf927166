"""M2, M3: closed sequential patterns by pruned, level-wise pattern growth with pseudo-projection.

The sequences are stored once, bucketed by run.  A prefix is a number with one row of its own (its
pattern and support); a **state** row is (prefix, run, place of the prefix's last item in the run's
leftmost embedding), with the prefix's target and support.  A level joins its states to the stored sequences by run, so that only
states are moved, and counts (prefix, gap, item) rows of numbers:

* gap -1 holds the items behind the place: the extensions, of which those under the target's threshold
  are dropped;
* gap i holds the items that could stand before the i-th item of the pattern (its maximum period), marked
  where they even do so before the last possible place of that item in the leftmost embedding (its
  semi-maximum period).  A prefix is **pruned** when a marked item occurs in every supporting run:
  whatever grows from it can take that item too without losing a run, so nothing closed grows from it;
* a prefix is **closed** when no item of any gap occurs in every supporting run.

Before that, where the level before showed items that all runs of a prefix still have, and the remaining items of all supporting runs begin with the same items, the prefix
**jumps** along all of them at once (the common beginning of all rows is that of the smallest and the
largest), so long common sequences take one level instead of one per item.

The threshold of a target rises to the support of its k-th closed pattern as patterns are found.
The driver sees counts per target.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precursor.session import scratch_dir
from precursor.sources.cache import scratch_table

_IDS = "array<bigint>"
_PLACES = "array<int>"
EXTENSION = -1
STATE = ("prefix", "target_id", "support", "run", "place")


def stored_sequences(sequences: DataFrame) -> tuple[DataFrame, str]:
    """(target_id, run, seq) as a table bucketed by run, and its name: joins by run leave it where it is."""
    spark = sequences.sparkSession
    name = f"precursor_sequences_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (sequences.repartition(buckets, "run").write.format("parquet").option("path", f"{scratch_dir(spark)}/precursor/{name}")
     .bucketBy(buckets, "run").sortBy("run").saveAsTable(name))
    return spark.table(name), name


def _after(seq: Column, place: Column) -> Column:
    """Items behind a place (1-based; 0: all)."""
    return F.slice(seq, place + 1, F.greatest(F.size(seq) - place, F.lit(0)))


def _inside(seq: Column, begin: Column, end: Column) -> Column:
    """Items behind place ``begin`` and before place ``end``."""
    return F.slice(seq, begin + 1, F.greatest(end - 1 - begin, F.lit(0)))


def _leftmost(seq: Column, items: Column) -> Column:
    """First places of ``items`` in order."""

    def step(acc: Column, item: Column) -> Column:
        place = acc["place"] + F.array_position(_after(seq, acc["place"]), item).cast("int")
        return F.struct(place.alias("place"), F.concat(acc["out"], F.array(place)).alias("out"))

    start = F.struct(F.lit(0).alias("place"), F.array().cast(_PLACES).alias("out"))
    return F.aggregate(items, start, step, lambda acc: acc["out"])


def _latest(seq: Column, items: Column, limit: Column) -> Column:
    """Latest places of ``items`` in order, all before ``limit``."""

    def step(acc: Column, item: Column) -> Column:
        place = acc["limit"] - F.array_position(F.reverse(F.slice(seq, 1, acc["limit"] - 1)), item).cast("int")
        return F.struct(place.alias("limit"), F.concat(F.array(place), acc["out"]).alias("out"))

    start = F.struct(limit.cast("int").alias("limit"), F.array().cast(_PLACES).alias("out"))
    return F.aggregate(F.reverse(items), start, step, lambda acc: acc["out"])


def _jump(states: DataFrame, prefixes: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, prefixes) moved along the items that all runs of a prefix continue with."""
    rest = states.join(seqs.select("run", "seq"), "run").select("prefix", _after(F.col("seq"), F.col("place")).alias("rest"))
    ends = rest.groupBy("prefix").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    same = F.transform(F.arrays_zip("lo", "hi"), lambda z: z["lo"].eqNullSafe(z["hi"]))
    n = F.when(F.forall(same, lambda x: x), F.least(F.size("lo"), F.size("hi"))).otherwise(
        F.array_position(same, F.lit(False)) - 1).cast("int")
    steps = ends.select("prefix", n.alias("n"), "lo").select("prefix", "n", F.slice("lo", F.lit(1), F.col("n")).alias("more"))
    prefixes = scratch_table(prefixes.join(steps, "prefix").select(
        "prefix", "target_id", F.concat("pattern", "more").alias("pattern"), "support", "n"), "mining-prefixes")
    moved = states.join(prefixes.select("prefix", "n"), "prefix").withColumn("place", F.col("place") + F.col("n"))
    return moved.select(*STATE), prefixes.drop("n")


def _items() -> Column:
    """The (gap, item, marked) structs of a state with its sequence and pattern."""
    seq, pattern, place = F.col("seq"), F.col("pattern"), F.col("place")
    bound = F.concat(_latest(seq, F.slice(pattern, F.lit(1), F.greatest(F.size(pattern) - 1, F.lit(0))), place), F.array(place))
    places = F.struct(_leftmost(seq, pattern).alias("first"), _latest(seq, pattern, F.size(seq) + 1).alias("latest"), bound.alias("bound"))

    def gap(e: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(e["first"], i - 1))
        near = _inside(seq, begin, F.get(e["bound"], i))
        return F.transform(F.array_distinct(_inside(seq, begin, F.get(e["latest"], i))), lambda x: F.struct(
            i.alias("gap"), x.alias("item"), F.array_contains(near, x).cast("int").alias("marked")))

    # the places are computed once per state: a plain column would be put in for each use in the lambda
    gaps = F.when(F.size("pattern") > 0, F.get(F.transform(F.array(places), lambda e: F.flatten(
        F.transform(F.sequence(F.lit(0), F.size("pattern") - 1), lambda i: gap(e, i)))), 0))
    ahead = F.transform(F.array_distinct(_after(seq, place)), lambda x: F.struct(
        F.lit(EXTENSION).alias("gap"), x.alias("item"), F.lit(0).alias("marked")))
    none = F.array().cast("array<struct<gap:int,item:bigint,marked:int>>")
    return F.inline(F.concat(ahead, F.coalesce(gaps, none)))


def _counts(states: DataFrame, prefixes: DataFrame, seqs: DataFrame, items: Column | None = None) -> DataFrame:
    """(prefix, target_id, support, gap, item, n, marked): runs of a prefix with an item in a gap, and those where it is marked."""
    rows = states.join(seqs.select("run", "seq"), "run").join(prefixes.select("prefix", "pattern"), "prefix")
    found = rows.select("prefix", "target_id", "support", _items() if items is None else items)
    return found.groupBy("prefix", "target_id", "support", "gap", "item").agg(
        F.count("*").alias("n"), F.sum("marked").alias("marked"))


def _children(states: DataFrame, seqs: DataFrame, grown: DataFrame) -> DataFrame:
    """States of the grown prefixes: ``grown`` is (prefix, item, child, support)."""
    rows = states.drop("support").join(seqs.select("run", "seq"), "run")
    rest = _after(F.col("seq"), F.col("place"))
    items = F.transform(F.array_distinct(rest), lambda x: F.struct(
        x.alias("item"), (F.col("place") + F.array_position(rest, x).cast("int")).alias("next")))
    return rows.select("prefix", "target_id", "run", F.inline(items)).join(grown, ["prefix", "item"]).select(
        F.col("child").alias("prefix"), "target_id", "support", "run", F.col("next").alias("place"))


def _of_target(values: dict[int, int]) -> Column:
    """A value per target (a literal: one entry per target of the parameter list)."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("target_id"))


def closed_patterns(sequences: DataFrame, thresholds: dict[int, int], k: int) -> tuple[DataFrame, dict[int, int]]:
    """All closed patterns that can rank among the k best: (target_id, pattern, freq), and their number per target.

    ``sequences`` is (target_id, run, seq array<long>), one row per run, best a table of :func:`stored_sequences`;
    ``thresholds`` has the least support per target.  Patterns with support at the threshold are
    complete.  The driver keeps, per target, the k best supports found so far.
    """
    spark = sequences.sparkSession
    least = dict(thresholds)
    best: dict[int, list[int]] = {t: [] for t in least}
    n_found = dict.fromkeys(least, 0)
    sequences = sequences.where(F.col("target_id").isin(list(least)))
    prefix = F.col("target_id").cast("long").alias("prefix")  # the empty prefix of a target
    prefixes = scratch_table(sequences.groupBy("target_id").agg(F.count("*").alias("support")).select(
        prefix, "target_id", F.array().cast(_IDS).alias("pattern"), "support"), "mining-prefixes")
    states = sequences.select(prefix, "run", F.lit(0).alias("place")).join(prefixes, "prefix").select(*STATE)
    items, levels, jump = _items(), [], True
    while True:
        if jump:
            states, prefixes = _jump(states, prefixes, sequences)
        counts = scratch_table(
            _counts(states, prefixes, sequences, items).where((F.col("n") == F.col("support")) | (F.col("n") >= _of_target(least)))
            .select("prefix", "target_id", "gap", "item", "n", (F.col("n") == F.col("support")).alias("all"),
                    (F.col("marked") == F.col("support")).alias("prune")), "mining-counts")
        new = (prefixes.where((F.size("pattern") > 0) & (F.col("support") >= _of_target(least)))
               .join(counts.where("all").select("prefix"), "prefix", "left_anti")
               .select("target_id", "pattern", F.col("support").alias("freq")))
        supports = new.groupBy("target_id", "freq").agg(F.count("*").alias("n")).collect()
        if supports:
            levels.append(new)
        for r in supports:
            n_found[r["target_id"]] += r["n"]
            best[r["target_id"]] += [r["freq"]] * min(r["n"], k)
        for t, found in best.items():  # the k-th best support so far is the new threshold
            best[t] = sorted(found, reverse=True)[:k]
            if len(best[t]) == k:
                least[t] = max(least[t], best[t][-1])
        grown = scratch_table(
            counts.where((F.col("gap") == EXTENSION) & (F.col("n") >= _of_target(least)))
            .join(counts.where("prune").select("prefix"), "prefix", "left_anti").join(prefixes.select("prefix", "pattern"), "prefix")
            .select("prefix", "item", "all", F.xxhash64("prefix", "item").alias("child"), "target_id",
                    F.concat("pattern", F.array("item")).alias("pattern"), F.col("n").alias("support")), "mining-grown")
        n, jump = grown.agg(F.count("*"), F.max("all")).first()
        if not n:
            break
        states = scratch_table(_children(states, sequences, grown.select("prefix", "item", "child", "support")), "mining-states")
        prefixes = grown.select(F.col("child").alias("prefix"), "target_id", "pattern", "support")
    found = spark.createDataFrame([], "target_id int, pattern array<bigint>, freq long")
    for new in levels:  # each reads its level's written tables
        found = found.unionByName(new)
    return found, n_found
