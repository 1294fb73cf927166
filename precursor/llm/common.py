"""Helpers shared by the corpus operators: written stages, row keys, word shingles."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precursor.session import scratch_dir


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds few texts as Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at the end the worker gives memory it has freed back to the system.

    A worker process is kept between tasks, and the C library holds on to what large arrays left free.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did.

    On a cluster, ship the package with ``--py-files`` or install it on the executors.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def stored(df: DataFrame, name: str, **options: str) -> str:
    """Path of ``df`` written as Parquet to the cluster's shared checkpoint folder."""
    path = f"{scratch_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the cluster's shared checkpoint folder and read back (cuts the lineage)."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name, **options))


def attach(rows: DataFrame, facts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi join of many ``rows`` with one ``facts`` row per key.

    Both sides should be scans or written stages: the sort-merge join then reads plain shuffles,
    whose hot keys adaptive execution splits; a small ``facts`` table is broadcast by its known size.
    """
    return rows.join(facts, key, how)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: A broadcast filter holds at most this many bucket numbers (8 bytes each), whatever the corpus size.
FILTER_BUCKETS = 1 << 18


def bucket_of(h: Column) -> Column:
    return F.pmod(h, F.lit(FILTER_BUCKETS)).cast("int")


def bucket_filter(keys: DataFrame, h: str) -> DataFrame:
    """Distinct filter buckets of a hash column: at most FILTER_BUCKETS small rows, so broadcast is safe."""
    return F.broadcast(keys.select(bucket_of(F.col(h)).alias("_bucket")).distinct())


# ---------------------------------------------------------------------------- word shingles
SHINGLE_WORDS = 5
#: Characters of text whose shingles are computed together (a longer text is taken alone).
BLOCK_CHARS = 1 << 18

# Word hashes: sum of table[byte] * K**i over the word's bytes, from prefix sums over a whole buffer.
_K = 0x9E3779B97F4A7C15
_K_INVERSE = pow(_K, -1, 1 << 64)
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """K**i and K**-i for i under n (at least), modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = 1 << max(20, n.bit_length())
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, k, dtype=np.uint64)]))
                      for k in (_K, _K_INVERSE)]
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, down) of bytes: the hash of part[i:j] before mixing is (total[j] - total[i]) * down[i]."""
    up, down = _powers(len(part) + 1)
    total = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[part] * up[:len(part)], out=total[1:])
    return total, down


def word_hashes(data: bytes, piece: int = 4 * BLOCK_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of UTF-8 text, a bounded piece at a time."""
    starts, hashes, lo = [], [], 0
    raw = np.frombuffer(data, dtype=np.uint8)
    while lo < len(raw):
        hi = lo + piece
        if hi < len(raw):  # cut behind a space: the last one of the piece, or the next one
            spaces = np.flatnonzero(_SPACE[raw[lo:hi]])
            while not len(spaces) and hi < len(raw):
                hi += piece
                spaces = np.flatnonzero(_SPACE[raw[lo:hi]])
            hi = lo + int(spaces[-1]) + 1 if len(spaces) and hi < len(raw) else len(raw)
        part = raw[lo:hi]
        space = np.ones(len(part) + 2, dtype=bool)
        space[1:-1] = _SPACE[part]
        begin = np.flatnonzero(space[:-1] & ~space[1:])
        end = np.flatnonzero(~space[:-1] & space[1:])
        total, down = prefix_sums(part)
        starts.append(begin + lo)
        hashes.append(mix64((total[end] - total[begin]) * down[begin]))
        lo = hi
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingles_of(texts: Sequence[str | None], n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ``n``-word shingles of each text in order, concatenated, and each text's bounds.

    Words are what white space separates.  A text of 1 to n-1 words is one shingle, none gives none.
    """
    data = [(" ".join(t.split()) if not t.isascii() and _WIDE_SPACE.search(t) else t).encode("utf-8", "surrogatepass")
            for t in (t or "" for t in texts)]
    first = np.cumsum([0, *(len(d) + 1 for d in data)])  # one space behind each text
    where, h = word_hashes(b" ".join(data))
    word = np.searchsorted(where, first)
    start, count = word[:-1], np.diff(word)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    acc = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
    for i in range(n):
        acc = acc * np.uint64(_K) + h[i:i + len(acc)]
    at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], made)
    out = acc[np.minimum(at, len(acc) - 1)] if len(acc) else np.zeros(len(at), dtype=np.uint64)
    for d in np.flatnonzero((count > 0) & (count < n)):
        v = int(count[d])
        for x in h[start[d]:start[d] + count[d]]:
            v = (v * _K + int(x)) & 0xFFFFFFFFFFFFFFFF
        out[bounds[d]] = v
    return mix64(out), bounds


def text_blocks(texts: Sequence[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles_of([text], n)[0])


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``count`` hash functions on 64-bit values."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, size=count, dtype=np.uint64)
    return a, b
