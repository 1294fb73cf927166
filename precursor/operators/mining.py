"""Sequential pattern mining.

* M1 :func:`frequent_sequences` - ``pyspark.ml.fpm.PrefixSpan`` on single-item
  itemsets; support is the number of runs whose sequence contains the pattern
  as an ordered subsequence (gaps allowed).
* M2 :func:`closed_sequences` - a pattern is closed when no pattern one item
  longer has the same support.  Every one-item deletion of each pattern is
  generated and anti-joined on ``(target_id, freq, pattern)``: an equi join, so
  no pair of patterns is ever compared.
* M3 :func:`topk_closed` - the k best closed patterns by support, by the pruned
  pattern growth of :mod:`precursor.operators.closed`.  The least support is searched:
  start at the support of the k-th most frequent token and go down to a quarter until at least k
  closed patterns are found or the floor (2 runs) is reached.  The result is exact:
  the closed set mined at support ``s`` holds every closed pattern with support >= s,
  and all others rank below them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precursor.operators.closed import closed_patterns, stored_sequences
from precursor.sources.cache import scratch_table

# Separator of pattern items in the text form of a pattern (our own convention).
PATTERN_SEPARATOR = " > "


def frequent_sequences(sequences: DataFrame, min_count: int, max_length: int,
                       seq_col: str = "sequence", n_sequences: int | None = None,
                       max_local_proj_db_size: int = 32_000_000) -> DataFrame:
    """M1: ``(pattern array<item>, freq long)`` for patterns in >= ``min_count`` sequences."""
    n = n_sequences if n_sequences is not None else sequences.count()
    if n < min_count:  # no pattern can reach the threshold (and minSupport may not exceed 1)
        item = sequences.schema[seq_col].dataType.elementType.simpleString()
        return sequences.sparkSession.createDataFrame([], f"pattern array<{item}>, freq long")
    ps = PrefixSpan(
        # (c - 0.5) / n: PrefixSpan rounds minSupport * n up, which gives exactly c.
        minSupport=(min_count - 0.5) / n,
        maxPatternLength=max(1, int(max_length)),
        maxLocalProjDBSize=max_local_proj_db_size,
        sequenceCol="_items",
    )
    items = sequences.select(F.transform(seq_col, lambda x: F.array(x)).alias("_items"))
    out = ps.findFrequentSequentialPatterns(items)
    return (out.select(F.transform("sequence", lambda s: s[0]).alias("pattern"), F.col("freq").cast("long"))
            .where(F.col("freq") >= min_count))


def frequent_sequences_by_key(sequences: DataFrame, min_count: int, max_length: int | None = None,
                              key: str = "target_id", n_sequences: int | None = None,
                              longest: int | None = None) -> DataFrame:
    """M1 for all keys in one PrefixSpan pass: ``(key, pattern, freq)``.

    Items are namespaced with the key, so no pattern mixes keys and every
    support is counted within its own key; ``min_count`` is an absolute count.
    ``max_length=None`` bounds patterns by the longest sequence only (exact).
    """
    if n_sequences is None or longest is None:
        stats = sequences.agg(F.count("*").alias("n"), F.max(F.size("sequence")).alias("mx")).first()
        n_sequences, longest = stats["n"], stats["mx"] or 1
    cap = longest if max_length is None else min(longest, max_length)
    tagged = sequences.select(F.transform("sequence", lambda x: F.concat_ws("\u0001", F.col(key).cast("string"), x))
                              .alias("sequence"))
    out = frequent_sequences(tagged, min_count, cap, n_sequences=n_sequences)
    first = F.get("pattern", 0)
    return out.select(
        F.substring_index(first, "\u0001", 1).cast(sequences.schema[key].dataType).alias(key),
        F.transform("pattern", lambda x: F.substring(x, F.instr(x, "\u0001") + 1, 1 << 30)).alias("pattern"),
        "freq",
    )


def one_item_deletions(pattern_col: str = "pattern"):
    """All patterns obtained by deleting one item of ``pattern``."""
    p = F.col(pattern_col)
    return F.transform(
        F.sequence(F.lit(1), F.size(p)),
        lambda i: F.concat(F.slice(p, F.lit(1), i - 1), F.slice(p, i + 1, F.size(p))),
    )


def closed_sequences(patterns: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """M2: keep patterns without an equal-support super-pattern one item longer."""
    subs = (patterns.where(F.size("pattern") > 1)
            .select(*keys, "freq", F.explode(one_item_deletions()).alias("pattern"))
            .distinct())
    return patterns.join(subs, [*keys, "freq", "pattern"], "left_anti")


def pattern_text(col: str = "pattern"):
    return F.array_join(F.col(col), PATTERN_SEPARATOR)


def topk_patterns(patterns: DataFrame, k: int, keys: Sequence[str] = ("target_id",),
                  min_count: int = 2) -> DataFrame:
    """O4 + O5: the k best patterns per key with ``freq >= min_count``; adds ``rank``.

    Order: support desc, length desc, pattern text asc (a total order).
    """
    w = Window.partitionBy(*keys).orderBy(F.col("freq").desc(), F.size("pattern").desc(), pattern_text().asc())
    return (patterns.where(F.col("freq") >= min_count)
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def start_thresholds(sequences: DataFrame, k: int, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Per key: number of sequences, longest sequence and the support of the k-th most frequent token."""
    item_support = (sequences.select(*keys, "job_id", F.explode(F.array_distinct("sequence")).alias("item"))
                    .groupBy(*keys, "item").agg(F.count("*").alias("runs")))
    w = Window.partitionBy(*keys).orderBy(F.col("runs").desc(), F.col("item"))
    kth = (item_support.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
           .groupBy(*keys).agg(F.min("runs").alias("start")))
    stats = sequences.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("sequence")).alias("max_len"))
    return stats.join(kth, list(keys), "left")


def _item(token):
    """64-bit item id of a token within its target (the target is part of the hash)."""
    return F.xxhash64(F.col("target_id"), token)


def token_items(seqs: DataFrame) -> DataFrame:
    """Dictionary ``(target_id, token, item)`` of the distinct tokens of each target."""
    return (seqs.select("target_id", F.explode(F.array_distinct("sequence")).alias("token")).distinct()
            .withColumn("item", _item(F.col("token"))))


def _items_unique(dictionary: DataFrame) -> bool:
    """True when no two (target, token) pairs share an item id (one small aggregation)."""
    r = dictionary.agg(F.count("*").alias("n"), F.countDistinct("item").alias("d")).first()
    return r["n"] == r["d"]


def _decode(mined: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(pattern array<long>, freq)`` -> ``(target_id, pattern array<string>, freq)``."""
    ex = mined.select("pattern", "freq", F.posexplode("pattern").alias("pos", "item"))
    return (ex.join(dictionary, "item")
            .groupBy("target_id", "pattern", "freq")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
            .select("target_id", F.transform("_t", lambda s: s["token"]).alias("pattern"), "freq"))


def topk_closed(sequences: DataFrame, k: int = 25, min_count: int = 2) -> DataFrame:
    """M3: the top-k closed patterns of each target (``target_id, pattern, freq, rank``).

    ``sequences`` is ``(target_id, job_id, sequence)``.  Tokens are mined as 64-bit item ids, dense
    numbers where two tokens of a target share an id.  In each round the targets that are not done are
    mined for closed patterns at their own thresholds (:func:`closed_patterns`); a target is done when
    it has k of them or its threshold reached ``min_count``, otherwise it goes down to a quarter.
    """
    spark = sequences.sparkSession
    seqs = sequences.select(F.col("target_id").cast("int").alias("target_id"), "job_id", "sequence")
    seqs = scratch_table(seqs, "mining-tokens")
    rows = {r["target_id"]: r.asDict() for r in start_thresholds(seqs, k).collect()}   # one row per target
    todo = {t: max(min_count, r["start"] or min_count) for t, r in rows.items() if r["n"] >= min_count}
    if not todo:
        return spark.createDataFrame([], "target_id int, pattern array<string>, freq long, rank int")
    dictionary = scratch_table(token_items(seqs), "mining-items")
    if not _items_unique(dictionary):  # a 64-bit collision: number the ids of one hash apart
        w = Window.partitionBy("item").orderBy("target_id", "token")
        dictionary = scratch_table(dictionary.withColumn("item", F.xxhash64("item", F.row_number().over(w))), "mining-items")
    items = (seqs.select("target_id", F.xxhash64("target_id", "job_id").alias("run"), F.posexplode("sequence").alias("pos", "token"))
             .join(dictionary, ["target_id", "token"]).groupBy("target_id", "run")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("_s"))
             .select("target_id", "run", F.transform("_s", lambda x: x["item"]).alias("seq")))
    items, name = stored_sequences(items)
    done: list[DataFrame] = []
    while todo:
        found, counts = closed_patterns(items, todo, k)
        finished = [t for t, least in todo.items() if least <= min_count or counts.get(t, 0) >= k]
        done.append(found.where(F.col("target_id").isin(finished)))
        todo = {t: max(min_count, least // 4) for t, least in todo.items() if t not in finished}
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    mined = done[0]
    for d in done[1:]:
        mined = mined.unionByName(d)
    top = topk_patterns(_decode(mined.drop("target_id"), dictionary), k, min_count=min_count)
    return top.select(F.col("target_id").cast("int"), "pattern", "freq", "rank")


def support_fraction(freq_col: str = "freq", runs_col: str = "n_runs"):
    """Integer share of runs in percent, ``freq * 100 // runs`` (exact integer division)."""
    a, b = F.col(freq_col) * 100, F.col(runs_col)
    return ((a - a % b) / b).cast("long")


__all__ = ["frequent_sequences", "closed_sequences", "topk_patterns", "topk_closed",
           "one_item_deletions", "pattern_text", "start_thresholds", "support_fraction"]
