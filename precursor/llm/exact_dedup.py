"""Exact deduplication by progressive refinement, DataFrame functions only.

Rows are grouped by the length of the normalised text, rows of a repeated length by a hash of its
prefix, and only rows whose (length, prefix) repeats get a hash of their whole text.  Two texts are
equal when they are identical after replacing each run of white space (space, tab to carriage
return) by one space; null counts as empty.

Defined results: of equal texts the row with the smallest doc_id stays (a null doc_id sorts last;
of rows that agree in text and doc_id one stays); empty and null texts form one group; an empty
table gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precursor.llm.common import bucket_filter, bucket_of, text_or_empty, written

PREFIX_CHARS = 256
# A white-space run other than one plain space; replacing only those gives the same text, faster.
_ODD_SPACE = r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), _ODD_SPACE, " ")


def _keys(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_norm", normalised(text)).withColumns(
        {"_len": F.length("_norm"), "_prefix": F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS))})


def _surviving(docs: DataFrame, text: str) -> DataFrame:
    """(length, prefix hash) that occur more than once: the groups whose rows need a full hash."""
    narrow = written(_keys(docs.select(text), text).select("_len", "_prefix"), "exact-keys")
    lengths = written(narrow.groupBy("_len").count().where("count > 1").select("_len"), "exact-lengths")
    return (narrow.join(lengths, "_len", "left_semi").groupBy("_len", "_prefix").count()
            .where("count > 1").select("_len", "_prefix"))


def _full_hash(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_full``: SHA-256 of the normalised text of rows in surviving groups, else null.

    Survivors are told by a filter of bounded size on the scan, so no text is shuffled; a row that
    passes the filter by chance is hashed in vain and ends up alone in its group.
    """
    hit = bucket_filter(_surviving(docs, text), "_prefix").withColumn("_hit", F.lit(True))
    return (_keys(docs, text).withColumn("_bucket", bucket_of(F.col("_prefix"))).join(hit, "_bucket", "left")
            .withColumn("_full", F.when(F.col("_hit"), F.unhex(F.sha2("_norm", 256))))
            .drop("_bucket", "_hit", "_len", "_prefix"))


def _groups(rows: DataFrame, *order: str) -> DataFrame:
    """One row per repeated full hash: its size and the first row by (null last, *order)."""
    first = F.min(F.struct(F.col(order[0]).isNull().alias("_null"), *order)).alias("_first")
    return (rows.where(F.col("_full").isNotNull()).groupBy("_full").agg(first, F.count("*").alias("_size"))
            .where("_size > 1"))


def dedup_report(docs: DataFrame, id: str = "doc_id", text: str = "text",
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, and the ``extra`` columns.

    ``extra`` maps new names to expressions over the input columns or ``_norm`` (the normalised text).
    """
    extra = extra or {}
    rows = _full_hash(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_text").select(
        "_id", "_full", *[c.alias(n) for n, c in extra.items()])
    rows = written(rows.withColumn("_uid", F.monotonically_increasing_id()), "exact-rows")
    groups = written(_groups(rows, "_id", "_uid"), "exact-groups")
    # rows without a full hash are alone; they take no part in the join
    joined = rows.where(F.col("_full").isNotNull()).join(groups, "_full", "left")
    alone = rows.where(F.col("_full").isNull()).withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in groups.schema.fields if f.name != "_full"})
    return joined.unionByName(alone).select(
        F.col("_id").alias(id),
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_first._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | (F.col("_first._uid") == F.col("_uid"))).alias("kept"),
        *extra)


def dedup_filter(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (whatever their names).

    Texts are normalised for the keys and for the full hashes; what goes is decided on narrow rows (id,
    hash of the text as it is, full hash) and taken out of the documents by one anti-join.
    """
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    hashed = written(_full_hash(rows, "_text").where(F.col("_full").isNotNull())
                     .select("_id", "_full", F.xxhash64("_text").alias("_row")), "exact-hashed")
    groups = _groups(hashed, "_id", "_row").select("_full", F.col("_first._id").alias("_keep"), F.col("_first._row").alias("_keep_row"))
    members = written(hashed.join(groups, "_full"), "exact-members")  # rows with equals only
    stays = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_row") == F.col("_keep_row"))
    gone = written(members.where(~stays).select("_id", "_row").distinct(), "exact-gone")
    out = docs.select(F.struct("*").alias("_doc"), F.col(id).alias("_doc_id"), F.xxhash64(text).alias("_text_hash"))
    out = out.join(gone, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_row")), "left_anti")
    again = members.where(stays).groupBy("_full").count().where("count > 1")
    if not again.isEmpty():  # rows that repeat both id and text
        out = out.dropDuplicates(["_doc_id", "_text_hash"])
    return out.select("_doc.*")
