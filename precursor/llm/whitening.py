"""Embedding whitening with Spark MLlib's BlockMatrix.

1. Every entry c of a usable vector becomes the integer floor(64 c) + 1000000.  Rows are indexed (rows
   before their written part, plus their place in it), centred with the exact column sums, and cut
   into the blocks of a distributed matrix.
2. Transpose times matrix gives the scatter.  MLlib deals the product by the blocks of its result, of
   which there is one, so the middle dimension is split: each part of the rows makes a partial product.
3. The covariance (dimensions squared) is decomposed on the driver.
4. Matrix times whitening matrix projects the rows; the blocks are joined with the ids of their rows.

The driver sees one number per block (MLlib plans a product there), one row of sums per dimension
and the covariance.  Blocks grow with the table from 512 KB to 128 MB, so their number stays bounded.

Defined results: a vector is used if it is not null, has no null, NaN, infinite entry or entry of
2**46 and more (whose integer would not be exact), and has the commonest length (of ties the longest);
other rows are left out, and so are vectors without entries.  Null and repeated ids are kept, each row for itself.
A component without variance (rank deficiency, a single row) has null as its whitened value and takes no
part in the identity error; a deviation over 63 bits is null; an empty table gives an empty result;
other columns of the input are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precursor.llm.common import stored, written

SCALE, SHIFT = 64, 1_000_000
#: Bytes of a block of rows (the least, the most), and the number of blocks from which on blocks grow.
BLOCK_BYTES, MOST_BLOCK_BYTES, MANY_BLOCKS = 512 << 10, 128 << 20, 1 << 14
#: Columns of a block.
BLOCK_COLUMNS = 1024
#: Bytes of blocks that one task multiplies.
PART_BYTES = 64 << 20
#: A component counts as without variance under this share of the largest eigenvalue.
NO_VARIANCE = 1e-12
COMPONENTS = 32

_AT = T.StructType([T.StructField("blockRowIndex", T.LongType(), False), T.StructField("blockColIndex", T.LongType(), False)])
_PLAIN = MatrixUDT.sqlType()
_BLOCKS = T.StructType([
    T.StructField("at", _AT), T.StructField("matrix", _PLAIN),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("deviations", T.ArrayType(T.LongType()))])
_MATRIX_BLOCKS = T.StructType([T.StructField("at", _AT), T.StructField("matrix", MatrixUDT())])


# ---------------------------------------------------------------------------- rows
def usable(table: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """(_id, _v) of the vectors that can be used, and their number of entries (0: there are none)."""
    c = F.col(vector).cast("array<double>")
    rows = table.select(F.col(id).cast("long").alias("_id"), c.alias("_v")).where(
        F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(2.0 ** 46))))
    common = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.where(F.size("_v") == d), d


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    n, s = 0, np.zeros(d, dtype=np.int64)
    for b in batches:
        n, s = n + b.num_rows, s + integers(b.column("_v"), d).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(s), pa.array(np.full(d, n))],
                                         names=["pos", "s", "n"])


def centred(x: np.ndarray, n: int, s: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """x - s / n (rounded once), and the exact sums of squares of n * x - s per row (null over 63 bits)."""
    far = max(int(x.max()) * n - min(s), max(s) - int(x.min()) * n, 1) if len(x) else 1
    if far * far * x.shape[1] < 1 << 62 and int(np.abs(x).max(initial=0)) * n < 1 << 62:
        a = x * n - np.array(s, dtype=np.int64)
        return a / n, (a * a).sum(axis=1).tolist()
    a = x.astype(object) * n - np.array(s, dtype=object)
    squares = [int(v) for v in (a * a).sum(axis=1)]
    return (a / n).astype(np.float64), [v if v < 1 << 63 else None for v in squares]


def _matrix(m: np.ndarray) -> dict:
    return {"type": 1, "numRows": m.shape[0], "numCols": m.shape[1], "colPtrs": None, "rowIndices": None,
            "values": np.ascontiguousarray(m.T).reshape(-1), "isTransposed": False}


_ARROW_MATRIX = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                           ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])
_ARROW_AT = pa.struct([("blockRowIndex", pa.int64()), ("blockColIndex", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch], d: int, columns: int, n: int, s: list[int]) -> Iterator[pa.RecordBatch]:
    """The matrix blocks of rows sorted by block and place; ids and deviations go with the first block of columns."""

    def made(block: int, ids: list, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, deviations = centred(np.concatenate(parts), n, s)
        for j, lo in enumerate(range(0, d, columns)):
            yield pa.RecordBatch.from_arrays([
                pa.array([{"blockRowIndex": block, "blockColIndex": j}], _ARROW_AT),
                pa.array([_matrix(values[:, lo:lo + columns])], _ARROW_MATRIX),
                pa.array([ids if j == 0 else None], pa.list_(pa.int64())),
                pa.array([deviations if j == 0 else None], pa.list_(pa.int64()))], names=["at", "matrix", "ids", "deviations"])

    now, ids, parts = None, [], []
    for b in batches:
        block = b.column("_block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if now is not None and block[lo] != now:
                yield from made(now, ids, parts)
                ids, parts = [], []
            now = int(block[lo])
            ids += b.column("_id")[lo:hi].to_pylist()
            parts.append(integers(b.column("_v")[lo:hi], d))
    if now is not None:
        yield from made(now, ids, parts)


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with _index, gapless from 0: rows in the parts before, plus the place in the part."""
    rows = written(rows.withColumn("_uid", F.monotonically_increasing_id()), "white-rows")
    part = F.shiftright("_uid", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(  # a row per written part
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(parts), "_part").withColumn(
        "_index", F.col("_before") + F.col("_uid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_uid")


# ---------------------------------------------------------------------------- matrices
def block_matrix(blocks: DataFrame, rows_per_block: int, columns_per_block: int, rows: int, columns: int) -> BlockMatrix:
    """A distributed matrix from a DataFrame (at, matrix), without a detour through Python objects."""
    java = callMLlibFunc("createBlockMatrix", blocks, rows_per_block, columns_per_block, rows, columns)
    return BlockMatrix(java, rows_per_block, columns_per_block)


def multiplied(a: BlockMatrix, b: BlockMatrix, parts: int) -> BlockMatrix:
    """a * b with the middle dimension split into ``parts`` partial products."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def _covariance_parts(batches: Iterator[pa.RecordBatch], c: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((c, c + 1)), 0
    for b in batches:
        for m in b.column("matrix").to_pylist():
            w = np.array(m["values"]).reshape(c, m["numRows"])
            total[:, :c] += w @ w.T
            total[:, c] += w.sum(axis=1)
            n += m["numRows"]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["pos", "v"])


OUT = ("_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _told(batches: Iterator[pa.RecordBatch], n: int, explained: list[float], some: int, error: float) -> Iterator[pa.RecordBatch]:
    c = len(explained)
    for b in batches:
        for ids, deviations, m in zip(*(b.column(k).to_pylist() for k in ("ids", "deviations", "matrix")), strict=True):
            rows = len(ids)
            w = np.full((rows, c), np.nan)
            w[:, :some] = np.array(m["values"]).reshape(m["numCols"], m["numRows"]).T[:, :some]
            for lo in range(0, rows, 2048):
                k = min(rows - lo, 2048)
                each = np.repeat(np.arange(lo, lo + k), c)
                flat = w[lo:lo + k].reshape(-1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()).take(pa.array(each)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), k)),
                    pa.array(np.full(k * c, n)), pa.array(deviations, pa.int64()).take(pa.array(each)),
                    pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, k)), pa.array(np.full(k * c, error))],
                    names=[f.split()[0] for f in OUT.split(", ")])


def whiten(table: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    rows, d = usable(table, id, vector)
    none = spark.createDataFrame([], OUT).withColumnRenamed("_id", id)
    if not d:
        return none
    rows = indexed(rows)
    sums = rows.select("_v").mapInArrow(lambda it: _sums(it, d), "pos int, s long, n long").groupBy("pos").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("pos").collect()  # one row per dimension
    n, s = sums[0]["n"], [r["s"] for r in sums]

    row_bytes = 8 * d
    block_bytes = min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, n * row_bytes // MANY_BLOCKS))
    per_block = max(1, block_bytes // row_bytes)
    parts = max(1, math.ceil(n * row_bytes / PART_BYTES))
    columns = min(d, BLOCK_COLUMNS)
    placed = rows.select("_id", "_v", F.expr(f"cast(_index div {per_block} as int)").alias("_block"), "_index")
    blocks = stored(placed.repartition("_block").sortWithinPartitions("_block", "_index").mapInArrow(
        lambda it: _blocks(it, d, columns, n, s), _BLOCKS), "white-blocks")
    matrix = block_matrix(spark.read.schema(_MATRIX_BLOCKS).parquet(blocks), per_block, columns, n, d)

    scatter = multiplied(matrix.transpose(), matrix, parts).toLocalMatrix().toArray()
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    c = min(components, d)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1][:, :c]
    trace = float(np.trace(scatter)) / n
    explained = (values[:c] / trace if trace > 0 else np.zeros(c)).tolist()
    some = int((values[:c] > NO_VARIANCE * values[0]).sum()) if values[0] > 0 else 0
    scale = np.where(np.arange(c) < some, 1 / np.sqrt(np.where(values[:c] > 0, values[:c], 1.0)), 0.0)

    whitening = vectors * scale
    pieces = [((j, 0), whitening[lo:lo + columns]) for j, lo in enumerate(range(0, d, columns))]
    # MLlib makes as many parts of the product as the larger operand has
    w = spark.createDataFrame([(at, DenseMatrix(*m.shape, m.T.reshape(-1))) for at, m in pieces], _MATRIX_BLOCKS)
    product = matrix.multiply(block_matrix(w.repartition(parts), columns, c, d, c))
    projected = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).toDF("at", "matrix")
    projected = projected.select(F.col("at").cast(_AT).alias("at"), "matrix")
    projected = spark.read.schema(T.StructType(_BLOCKS.fields[:2])).parquet(stored(projected, "white-projected"))

    found = projected.select("matrix").mapInArrow(lambda it: _covariance_parts(it, c), "pos long, v double").groupBy("pos").agg(
        F.sum("v").alias("v")).orderBy("pos").collect()  # components squared
    total = np.array([r["v"] for r in found]).reshape(c, c + 1) / n
    covariance = (total[:, :c] - np.outer(total[:, c], total[:, c]))[:some, :some]
    error = float(np.abs(covariance - np.eye(some)).max(initial=0.0))

    named = spark.read.schema(_BLOCKS).parquet(blocks).where("at.blockColIndex = 0").select(F.col("at.blockRowIndex").alias("_block"), "ids", "deviations")
    joined = projected.select(F.col("at.blockRowIndex").alias("_block"), "matrix").join(named, "_block")
    return joined.mapInArrow(lambda it: _told(it, n, explained, some, error), OUT).withColumnRenamed("_id", id)

