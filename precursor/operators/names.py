"""Normalising names and messages across runs.

* :func:`generalize_prefix` maps a pod or namespace name to the longest prefix
  that is shared by several runs (suffixed ``-...``) when the name itself
  occurs in a single run.
* :func:`blank_rare` blanks a message seen in one run only.

Both are an aggregation keyed by value (with map-side partial aggregation, so a
hot value is pre-combined before the shuffle) joined back on the value
(:func:`dictionary_join`, which spreads NULLs and heavy values).  No name-to-name
comparison is ever made: prefix matching is an equi join on the prefixes of each
distinct name that have the length of some shared prefix.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precursor.fixed import GENERALISED_SUFFIX, NAME_DELIMITER

from precursor.functions.text import dash_prefixes
from precursor.sources.cache import scratch_table

#: Rows with a NULL are dealt to this many keys that match nothing.
_NULL_PIECES = 1 << 16
#: Pieces into which the share of one partition is cut, for values that fill more than that.
_PIECES = 8



def _present(col: str):
    return F.col(col).isNotNull() & (F.col(col) != "")


def _broadcastable(df: DataFrame) -> bool:
    """Whether the planner will broadcast ``df`` by its known size."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def dictionary_join(df: DataFrame, facts: DataFrame, on: Sequence[str], value: str, spread_by: Sequence[str]) -> DataFrame:
    """``df`` left join ``facts`` on the columns ``on`` (``value`` among them), at most one fact per key.

    A dictionary under the broadcast threshold is broadcast.  Beyond it the rows are shuffled by key,
    where NULLs and heavy values would meet in one task.  So NULLs get a spread key of their own, which
    matches nothing, and a first count (combined before its shuffle) finds the values with more
    rows than a partition's share, at most one per partition: their rows are dealt to pieces by a
    hash of ``spread_by``, and their fact is repeated per piece.
    """
    if _broadcastable(facts):
        return df.join(facts, list(on), "left")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.where(F.col(value).isNotNull()).groupBy(*on).agg(F.count("*").alias("_rows"))
    total = df.count()
    heavy = scratch_table(sizes.where(F.col("_rows") > total / parts).select(
        *on, F.ceil(F.col("_rows") * _PIECES * parts / max(total, 1)).cast("int").alias("_pieces")), "heavy-values")
    heavy = F.broadcast(heavy)  # at most one row per partition
    dealt = df.join(heavy, list(on), "left")
    spread = F.xxhash64(*spread_by)
    dealt = dealt.withColumn("_piece", F.when(F.col(value).isNull(), F.pmod(spread, F.lit(_NULL_PIECES)))
                             .otherwise(F.pmod(spread, F.coalesce("_pieces", F.lit(1)))).cast("int")).drop("_pieces")
    repeated = facts.join(heavy, list(on), "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(repeated, [*on, "_piece"], "left").drop("_piece")


def distinct_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct projection."""
    return df.select(*cols).distinct()


def _in_enough_runs(df: DataFrame, group: Sequence[str], run_col: str, min_runs: int,
                    with_counts: bool) -> DataFrame:
    """Groups of ``df`` seen in at least ``min_runs`` distinct runs.

    For the usual ``min_runs=2`` without counts the test is ``min(run) < max(run)``:
    one algebraic aggregation, combined map-side, so a hot value is reduced to
    one row per task before the shuffle.  Otherwise a distinct count.
    """
    if min_runs == 2 and not with_counts:
        return (df.groupBy(*group).agg(F.min(run_col).alias("_lo"), F.max(run_col).alias("_hi"))
                .where(F.col("_lo") < F.col("_hi")).select(*group))
    out = df.groupBy(*group).agg(F.countDistinct(run_col).alias("n_runs")).where(F.col("n_runs") >= min_runs)
    return out if with_counts else out.select(*group)


def shared_prefixes(df: DataFrame, name_col: str, keys: Sequence[str] = ("target_id",),
                    run_col: str = "job_id", delimiter: str = NAME_DELIMITER, min_runs: int = 2,
                    with_counts: bool = True) -> DataFrame:
    """A2: delimiter-boundary prefixes of the names that occur in at least ``min_runs`` runs.

    Returns ``(*keys, prefix, n_runs)`` (``n_runs`` only ``with_counts``).  Null and
    empty names are skipped.
    """
    rows = df.where(_present(name_col)).select(*keys, run_col, name_col)
    if with_counts or min_runs != 2:
        rows = rows.distinct()  # min/max below need no de-duplication
    exploded = rows.select(*keys, run_col, F.explode(dash_prefixes(name_col, delimiter)).alias("prefix"))
    return _in_enough_runs(exploded, [*keys, "prefix"], run_col, min_runs, with_counts)


def prefix_mapping(df: DataFrame, name_col: str, keys: Sequence[str] = ("target_id",),
                   run_col: str = "job_id", delimiter: str = NAME_DELIMITER, min_runs: int = 2,
                   token_boundary: bool = False) -> DataFrame:
    """``(*keys, name, mapped)`` for every distinct non-empty name.

    The longest shared prefix is found among the *character* prefixes of the
    name (``foobar-2`` can map to ``foo-...`` when ``foo`` is shared), of which only
    those are tried that have the length of some shared prefix of the same keys; with
    ``token_boundary=True`` only delimiter-boundary prefixes are tried.
    """
    shared = shared_prefixes(df, name_col, keys, run_col, delimiter, min_runs, with_counts=False)
    names = distinct_pairs(df.where(_present(name_col)), [*keys, name_col]).withColumnRenamed(name_col, "name")
    cand = prefix_candidates(names, shared, keys, delimiter, token_boundary)
    # Every candidate is a character prefix of the name, so the longest match is
    # substring(name, 1, max length): a hash aggregation on an int.
    best = (cand.join(shared, [*keys, "prefix"])
            .groupBy(*keys, "name")
            .agg(F.max(F.length("prefix")).alias("_len"))
            .select(*keys, "name", F.substring(F.col("name"), F.lit(1), F.col("_len")).alias("best")))
    mapped = (F.when(F.col("best").isNull() | (F.col("best") == F.col("name")), F.col("name"))
              .otherwise(F.concat(F.col("best"), F.lit(GENERALISED_SUFFIX))))
    return (names.join(best, [*keys, "name"], "left")
            .select(*keys, "name", mapped.alias("mapped")))


def prefix_candidates(names: DataFrame, shared: DataFrame, keys: Sequence[str], delimiter: str = NAME_DELIMITER,
                      token_boundary: bool = False) -> DataFrame:
    """(*keys, name, prefix): the prefixes of each name that may be shared."""
    if token_boundary:
        return names.select(*keys, "name", F.explode(dash_prefixes("name", delimiter)).alias("prefix"))
    lengths = shared.groupBy(*keys).agg(F.collect_set(F.length("prefix")).alias("_lengths"))  # no more than the longest name has
    fit = F.filter("_lengths", lambda n: n <= F.length("name"))
    return names.join(lengths, list(keys)).select(*keys, "name", F.explode(
        F.transform(fit, lambda n: F.substring("name", F.lit(1), n))).alias("prefix"))


def generalize_prefix(df: DataFrame, name_col: str, keys: Sequence[str] = ("target_id",),
                      run_col: str = "job_id", delimiter: str = NAME_DELIMITER, min_runs: int = 2,
                      token_boundary: bool = False) -> DataFrame:
    """N6 + J4: replace ``name_col`` by its mapped name; NULL and empty names become NULL."""
    m = prefix_mapping(df, name_col, keys, run_col, delimiter, min_runs, token_boundary)
    m = m.withColumnRenamed("name", name_col).withColumnRenamed("mapped", "__mapped")
    cols = [F.col("__mapped").alias(c) if c == name_col else F.col(c) for c in df.columns]
    return dictionary_join(df, m, [*keys, name_col], name_col, df.columns).select(*cols)


def prefix_mappings(df: DataFrame, name_cols: Sequence[str], keys: Sequence[str] = ("target_id",),
                    run_col: str = "job_id", delimiter: str = NAME_DELIMITER, min_runs: int = 2,
                    token_boundary: bool = False) -> DataFrame:
    """N6 for several name columns at once: ``(kind, *keys, name, mapped)``.

    The columns are stacked as ``(kind, name)`` rows with one scan, so the prefix
    aggregations run once with ``kind`` as an extra key.  Materialise the result
    when several columns are mapped (see :func:`apply_mappings`): a per-column
    filter on ``kind`` would otherwise be pushed into, and duplicate, the plan.
    """
    stacked = df.select(*keys, run_col, F.inline(F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name")) for c in name_cols])))
    return prefix_mapping(stacked, "name", ["kind", *keys], run_col, delimiter, min_runs, token_boundary)


def apply_mappings(df: DataFrame, mappings: DataFrame, name_cols: Sequence[str],
                   keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Replace each name column by its mapped name (NULL and empty names become NULL)."""
    out = df
    for c in name_cols:
        part = (mappings.where(F.col("kind") == c).select(*keys, F.col("name").alias(c), F.col("mapped").alias("__mapped")))
        cols = [F.col("__mapped").alias(x) if x == c else F.col(x) for x in out.columns]
        out = dictionary_join(out, part, [*keys, c], c, out.columns).select(*cols)
    return out


def generalize_prefixes(df: DataFrame, name_cols: Sequence[str], keys: Sequence[str] = ("target_id",),
                        run_col: str = "job_id", delimiter: str = NAME_DELIMITER, min_runs: int = 2,
                        token_boundary: bool = False) -> DataFrame:
    """N6 + J4 for several name columns (lazy; the mapping is planned once per column)."""
    m = prefix_mappings(df, name_cols, keys, run_col, delimiter, min_runs, token_boundary)
    return apply_mappings(df, m, name_cols, keys)


def runs_per_value(df: DataFrame, col: str, keys: Sequence[str] = ("target_id",),
                   run_col: str = "job_id") -> DataFrame:
    """A1: number of distinct runs per non-null value: ``(*keys, col, n_runs)``."""
    return (df.where(F.col(col).isNotNull())
            .groupBy(*keys, col).agg(F.countDistinct(run_col).alias("n_runs")))


def blank_rare(df: DataFrame, col: str, keys: Sequence[str] = ("target_id",),
               run_col: str = "job_id", min_runs: int = 2) -> DataFrame:
    """A value seen in fewer than ``min_runs`` runs becomes ``''``; NULL stays NULL."""
    common = (_in_enough_runs(df.where(F.col(col).isNotNull()), [*keys, col], run_col, min_runs, False)
              .withColumn("__common", F.lit(True)))
    blanked = F.when(F.col(col).isNotNull() & F.col("__common").isNull(), F.lit("")).otherwise(F.col(col))
    cols = [blanked.alias(c) if c == col else F.col(c) for c in df.columns]
    return dictionary_join(df, scratch_table(common, "common-values"), [*keys, col], col, df.columns).select(*cols)
