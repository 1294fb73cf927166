"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Benchmark items (sets of five-word shingles) are partitioned by size into classes of doubling width.
For a class of items with up to ``s`` shingles, every document is covered by overlapping windows of
``2 s`` shingles (a shorter document is one window), so a passage of ``s`` shingles lies whole in one
window, and even a short item has a fair Jaccard similarity to it, however long the document is.
MinHash values of blocks of shingles are combined to those of the windows of all classes.  The number
of hash functions follows from the least similarity that the containment threshold implies for the
class and the target recall; a window and an item that share the minimum of one function are
candidates.  Items of at most ``SHORT`` shingles, too small for the least class, are candidates of every
document that holds one of their shingles (an exact lookup).  All candidates are verified by the exact containment of the item's shingles in the whole document.

Items are taken in blocks of bounded size: each block is sent to the tasks and all documents are read
against it, so nothing is shuffled and no document is split from its text.

Defined results: items without words are never found; an item of fewer than five words is one
shingle; null and empty texts match nothing; null ids stay null; repeated items and rows are reported
each; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precursor.llm.common import permutations, shingle_set, shingles_of, slices, text_blocks, trimmed, written

THRESHOLD, RECALL = 0.8, 0.9999
#: Shingles of the items in one block: bounds what is sent to each task (about 40 bytes a shingle).
BLOCK_SHINGLES = 1 << 18
#: Shingles in the smallest block of a document that gets MinHash values of its own.
UNIT = 8
#: Items up to this size (half the smallest class) are looked up exactly.
SHORT = UNIT // 2


def functions_for(threshold: float, recall: float) -> int:
    """Hash functions needed: an item of a class (s/2, s] in a window of 2 s shingles at the threshold."""
    least = threshold * 0.5 / (2 + 0.5 * (1 - threshold))
    return math.ceil(math.log(1 - recall) / math.log(1 - least))


@dataclass
class ItemBlock:
    """Benchmark items with their shingle sets and, per size class, the MinHash values by function."""

    ids: list[int | None]
    sets: list[np.ndarray]
    classes: dict[int, np.ndarray]       # class -> positions of its items
    minima: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # class -> per function (sorted values, item positions)
    short: tuple[np.ndarray, np.ndarray]  # (sorted shingles, item positions) of the items without a class

    @staticmethod
    def of(items: list[tuple[int | None, np.ndarray]], a: np.ndarray, b: np.ndarray) -> "ItemBlock":
        sets = [s for _, s in items]
        cls = np.array([max(UNIT, 1 << (len(s) - 1).bit_length()) for s in sets], dtype=np.int64)
        size = np.array([len(s) for s in sets])
        classes = {int(c): np.flatnonzero((cls == c) & (size > SHORT)) for c in np.unique(cls[size > SHORT])}
        few = np.flatnonzero(size <= SHORT)
        values = np.concatenate([np.empty(0, dtype=np.uint64), *(sets[i] for i in few)])
        by_value = np.argsort(values, kind="stable")
        short = values[by_value], np.repeat(few, size[few])[by_value]
        minima = {}
        for c, at in classes.items():
            sig = np.array([[(sets[i] * x + y).min() for x, y in zip(a, b, strict=True)] for i in at], dtype=np.uint64)
            order = np.argsort(sig, axis=0, kind="stable")
            minima[c] = [(sig[order[:, f], f], at[order[:, f]]) for f in range(len(a))]
        return ItemBlock([i for i, _ in items], sets, classes, minima, short)


def _short_candidates(block: ItemBlock, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(document, item position) pairs that share a shingle, for the items without a class."""
    values, items = block.short
    lo = np.searchsorted(values, h)
    at = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == h) if len(values) else np.empty(0, dtype=np.int64)
    docs = np.searchsorted(bounds, at, "right") - 1
    hits = np.unique(np.stack([docs, lo[at]], axis=1), axis=0)  # a shingle counts once in a document
    n = np.searchsorted(values, values[hits[:, 1]], "right") - hits[:, 1]
    each = np.arange(n.sum()) + np.repeat(hits[:, 1] - (np.cumsum(n) - n), n)
    return np.stack([np.repeat(hits[:, 0], n), items[each]], axis=1)


def _candidates(block: ItemBlock, h: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(document, item position) pairs to verify, for documents with shingles h[bounds]."""
    found = [_short_candidates(block, h, bounds)]
    if not block.classes:
        return np.unique(found[0], axis=0)
    widest = max(block.classes)
    n = np.diff(bounds)
    padded = -(-n // widest) * widest  # every document fills whole blocks of the widest class
    first = np.cumsum(padded) - padded
    # padded with the document's last shingle, which changes no minimum
    at = np.repeat(bounds[1:] - 1, padded)
    at[np.arange(len(h)) + np.repeat(first - bounds[:-1], n)] = np.arange(len(h))
    units = np.ascontiguousarray(h[at].reshape(-1, UNIT).T)
    owner = np.repeat(np.arange(len(n)), padded // UNIT)
    docs = {c: owner[::c // UNIT] for c in block.classes}
    ends = {c: np.flatnonzero(np.append(d[1:] != d[:-1], True)) for c, d in docs.items()}
    for f in range(len(a)):
        v = units * a[f] + b[f]
        level, size = v[0], UNIT
        for row in v[1:]:
            level = np.minimum(level, row)
        for c in sorted(block.classes):
            while size < c:  # minima of blocks twice as large
                level, size = np.minimum(level[0::2], level[1::2]), size * 2
            window = level.copy()  # two neighbouring blocks of one document
            np.minimum(window[:-1], level[1:], out=window[:-1])
            window[ends[c]] = level[ends[c]]
            values, items = block.minima[c][f]
            lo = np.searchsorted(values, window)
            for w in np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == window):
                hits = items[lo[w]:np.searchsorted(values, window[w], "right")]
                found.append(np.stack([np.full(len(hits), docs[c][w]), hits], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def contained(block: ItemBlock, texts: list[str | None], a: np.ndarray, b: np.ndarray,
              threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(text position, item position, shared shingles, item shingles) of the items contained in texts."""
    for lo, hi in text_blocks(texts):
        h, bounds = shingles_of(texts[lo:hi])
        if not len(h):
            continue
        last, whole = -1, h
        for d, i in _candidates(block, h, bounds, a, b):
            if d != last:
                last, whole = d, np.unique(h[bounds[d]:bounds[d + 1]])
            item = block.sets[i]
            at = np.searchsorted(whole, item)
            shared = int((whole[np.minimum(at, len(whole) - 1)] == item).sum())
            if shared >= threshold * len(item) - 1e-9:
                yield lo + int(d), int(i), shared, len(item)


RESULT = "_doc long, _item long, shared_shingles long, item_shingles long, containment double"


def _search(batches: Iterator[pa.RecordBatch], block: ItemBlock, threshold: float, recall: float, filter_text: str | None):
    a, b = permutations(functions_for(threshold, recall), seed=8)
    for batch in slices(batches):
        texts = batch.column(filter_text or "_text").to_pylist()
        if filter_text is not None:
            clean = np.ones(len(texts), dtype=bool)
            clean[[d for d, *_ in contained(block, texts, a, b, threshold)]] = False
            yield batch.filter(pa.array(clean))
            continue
        ids = batch.column("_doc").to_pylist()
        rows = [(ids[d], block.ids[i], shared, n, shared / n)
                for d, i, shared, n in contained(block, texts, a, b, threshold)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                         names=["_doc", "_item", "shared_shingles", "item_shingles", "containment"])


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t) for t in b.column("_text").to_pylist()]
        keep = [i for i, s in enumerate(sets) if len(s)]
        yield pa.RecordBatch.from_arrays(
            [b.column("_item").take(pa.array(keep, pa.int64())),
             pa.array([sets[i].tobytes() for i in keep], pa.binary()), pa.array([len(sets[i]) for i in keep], pa.int64())],
            names=["_item", "_set", "_n"])


def item_blocks(items: DataFrame, id: str, text: str, threshold: float, recall: float,
                block_shingles: int = BLOCK_SHINGLES) -> Iterator[ItemBlock]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    a, b = permutations(functions_for(threshold, recall), seed=8)
    sets = written(items.select(F.col(id).cast("long").alias("_item"), F.col(text).alias("_text"))
                   .mapInArrow(_item_sets, "_item long, _set binary, _n long"), "benchmark-sets")
    total = sets.agg(F.sum("_n")).first()[0] or 0
    # hash parts of half the bound on average; a part is streamed and cut again at the bound
    parts = max(1, math.ceil(2 * total / block_shingles))
    for p in range(parts):
        block, size = [], 0
        for r in sets.where(F.pmod(F.xxhash64("_item", "_set"), F.lit(parts)) == p).toLocalIterator():
            if block and size + r["_n"] > block_shingles:
                yield ItemBlock.of(block, a, b)
                block, size = [], 0
            block.append((r["_item"], np.frombuffer(r["_set"], dtype=np.uint64)))
            size += r["_n"]
        if block:
            yield ItemBlock.of(block, a, b)


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                   id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) with containment of at least ``threshold``."""
    rows = docs.select(F.col(id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    out = None
    for block in item_blocks(items, item_id, item_text, threshold, recall):
        part = rows.mapInArrow(lambda it, block=block: trimmed(_search(it, block, threshold, recall, None)), RESULT)
        out = part if out is None else out.unionByName(part)
    out = docs.sparkSession.createDataFrame([], RESULT) if out is None else out
    return out.withColumnsRenamed({"_doc": id, "_item": item_id})


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                      text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    for block in item_blocks(items, item_id, item_text, threshold, recall):
        docs = docs.mapInArrow(lambda it, block=block: trimmed(_search(it, block, threshold, recall, text)), docs.schema)
    return docs
