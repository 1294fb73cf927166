"""Shards cut from a Hilbert curve over several metadata dimensions.

Every dimension is quantised at corpus quantiles (numbers at approximate ones; strings, which are compared
as whole byte strings, at the exact quantiles of their rows), the cells are numbered along a Hilbert curve, all rows are sorted by
(curve index, doc_id) and the order is cut into runs of near equal bytes (law ``bytes``) or row
counts (law ``rows``).  Runs of the curve are compact in every dimension, so a reader that filters
on any of them skips most shards.

Defined results: a null dimension falls into cell 0; a null text has 8 bytes and CRC 0; ties on the
curve are ordered by doc_id (nulls first), then CRC and size, so a cell that holds a third of the
rows is still cut; equal rows are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precursor.llm.common import text_or_empty, written

ROW_BYTES = 8
DIMENSIONS = ("source", "lang", "n_chars")


def hilbert_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points given as one integer array per axis (values under 2**bits)."""
    x = [np.array(c, dtype=np.int64) for c in cells]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level, from the top
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def _ordered(df: DataFrame, name: str) -> Column:
    """The column as a double, or as bytes where it is a string: both keep its order."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return c.cast("binary")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return c.cast("timestamp").cast("double")
    return c.cast("double")


def _before(parts: DataFrame, counts: dict[str, str]) -> DataFrame:
    """(_part, ...) with the totals before each part and of all parts; ``parts`` has one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{n}0") for c, n in counts.items()],
                        *[F.sum(c).over(whole).alias(f"{n}_all") for c, n in counts.items()])


def string_cuts(values: DataFrame, cells: int) -> list[bytes]:
    """Cut points of the column ``_v`` (bytes) into ``cells`` quantiles of its rows, at most one per cell.

    Values are counted, range-partitioned as whole strings, and ranked by the rows before them; a
    value that fills several cells is one cut.
    """
    counted = values.where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count("*").alias("_n"))
    ranged = written(counted.repartitionByRange("_v").select(F.spark_partition_id().alias("_part"), "_v", "_n"), "hilbert-values")
    parts = _before(ranged.groupBy("_part").agg(F.sum("_n").alias("_n")), {"_n": "_n"})
    within = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_n0") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    ranked = ranged.join(F.broadcast(parts), "_part").select("_v", rank.alias("_rank"), "_n_all")
    firsts = ranked.groupBy(F.expr(f"(_rank * {cells}) div _n_all").alias("_cell")).agg(F.min("_v").alias("_v")).collect()
    return sorted(bytes(r["_v"]) for r in firsts)[1:]


def cells_of(column: pa.Array, cuts: np.ndarray | list[bytes]) -> np.ndarray:
    """How many cut points are at or under each value (null and NaN: none)."""
    if pa.types.is_floating(column.type):
        v = column.to_numpy(zero_copy_only=False)
        return np.where(np.isnan(v), 0, np.searchsorted(cuts, v, side="right"))
    coded = column.dictionary_encode()
    at = np.array([*(bisect_right(cuts, v) for v in coded.dictionary.to_pylist()), 0], dtype=np.int64)
    return at[coded.indices.fill_null(len(at) - 1).to_numpy(zero_copy_only=False)]


def _ranked(batches: Iterator[pa.RecordBatch], cuts: list, bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells = [cells_of(b.column(f"_d{i}"), cut) for i, cut in enumerate(cuts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hilbert_index(cells, bits)), *(b.column(n) for n in ("_id", "_size", "_crc"))],
            names=["_h", "_id", "_size", "_crc"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and bytes before each row within its sorted partition."""
    part, rows, size = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        sizes = b.column("_size").to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes) + size
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(sizes), part, np.int32)), *(b.column(n) for n in ("_h", "_id", "_size", "_crc")),
             pa.array(np.arange(rows, rows + len(sizes), dtype=np.int64)), pa.array(ends - sizes)],
            names=["_part", "_h", "_id", "_size", "_crc", "_rows_before", "_bytes_before"])
        rows, size = rows + len(sizes), int(ends[-1]) if len(sizes) else size


def hilbert_shards(docs: DataFrame, n_shards: int = 24, dims: Sequence[str] = DIMENSIONS, law: str = "bytes",
                   bits: int = 6, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, hilbert (its curve index).

    Narrow rows only (ids, sizes, checksums) are shuffled.  To lay out whole documents, join the
    result back and write with ``repartitionByRange("shard", "slot")``.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    if bits * len(dims) > 62:
        raise ValueError("bits * dimensions must be at most 62")
    values = docs.select(*[_ordered(docs, d).alias(f"_d{i}") for i, d in enumerate(dims)])
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts: dict[str, np.ndarray | list[bytes]] = {c: string_cuts(values.select(F.col(c).alias("_v")), 1 << bits)
                                                 for c, kind in values.dtypes if kind == "binary"}
    numbers = [c for c in values.columns if c not in cuts]
    if numbers:
        found = values.agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in numbers]).first()
        cuts |= {c: np.array(found[c] or [], dtype=float) for c in numbers}
    cuts_by_dim = [cuts[c] for c in values.columns]

    narrow = docs.select(
        *[_ordered(docs, d).alias(f"_d{i}") for i, d in enumerate(dims)], F.col(id).cast("long").alias("_id"),
        (F.octet_length(text_or_empty(text)) + F.lit(ROW_BYTES)).cast("long").alias("_size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("_crc"))
    fields = "_id long, _size long, _crc long"
    ranked = written(narrow.mapInArrow(lambda it: _ranked(it, cuts_by_dim, bits), f"_h long, {fields}"), "hilbert-ranked")
    order = ["_h", "_id", "_crc", "_size"]
    rows = written(ranked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _running, f"_part int, _h long, {fields}, _rows_before long, _bytes_before long"), "hilbert-sorted")

    # one row per partition: what comes before it in curve order
    parts = _before(rows.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_b")), {"_n": "_n", "_b": "_b"})
    rows = rows.join(F.broadcast(parts), "_part").withColumn("_row", F.col("_n0") + F.col("_rows_before"))
    if law == "rows":
        shard = F.expr(f"(_row * {n_shards}) div _n_all")
    else:  # the middle of the document decides, so no shard is off by more than one document
        shard = F.expr(f"((2 * (_b0 + _bytes_before) + _size) * {n_shards}) div (2 * _b_all)")
    rows = rows.withColumn("_shard", shard.cast("int"))
    starts = rows.groupBy("_shard").agg(F.min("_row").alias("_start"))  # n_shards rows
    return rows.join(F.broadcast(starts), "_shard").select(
        F.col("_id").alias(id), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit(law).alias("law"), F.col("_shard").alias("shard"), (F.col("_row") - F.col("_start")).alias("slot"),
        F.col("_h").alias("hilbert"))
