"""Set similarity join by chosen paths: all pairs of documents with Jaccard similarity of word shingles >= 0.8.

1. Documents with equal shingle sets form one class of copies; the join works on distinct sets.
2. Every set is embedded as ``COORDINATES`` MinHash values.  In each of ``RUNS`` runs the sets are split
   recursively: a node samples coordinates (each with probability 1 / (threshold * COORDINATES)) and its
   sets go to one child per sampled coordinate and value.  A child of at most ``LEAF`` sets is a
   bucket to brute-force; larger ones are split again, down to ``DEPTH`` levels, where they are cut into
   pairs of blocks.  Equal buckets of several runs are compared once.
3. Buckets are compared on the low bytes of the MinHash values with a slack threshold; the links found
   connect sets to candidate groups.
4. Within a candidate group all pairs are verified on the exact shingle sets, in blocks of bounded
   size: links are counted in the task (no pair is emitted) and a spanning forest of the links goes on.
5. The forests are joined to classes.

The number of runs is the number needed for ``RECALL`` at the deepest level; since groups are closed
over all links found, a pair is lost only if no chain of links connects it.

Defined results: words are what white space separates, compared as they are; a text of one to four
words is one shingle; null and empty texts link to nothing and are classes of their own; repeated
rows link to each other; the class id is the smallest doc_id in the class (null ids last); an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precursor.llm.common import (bucket_filter, bucket_of, mix64, permutations, shingles_of, slices, text_blocks,
                                  trimmed, written)
from precursor.llm.components import components

THRESHOLD = 0.8
COORDINATES = 64
#: Levels of recursion, and the sets that a bucket to brute-force holds at most.
DEPTH, LEAF = 4, 8192
RECALL = 0.995
#: Share of equal MinHash values that makes a candidate: four standard deviations under the threshold.
SLACK = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
#: Sets, and bytes of sets, per block of the exact verification.
BLOCK, BLOCK_BYTES = 4096, 24 << 20
_SEED = np.uint64(0x5851F42D4C957F2D)


def runs_for(recall: float, depth: int) -> int:
    """Runs needed so that a pair at the threshold meets in a leaf at ``depth`` with probability ``recall``.

    A pair survives one level with a Poisson number of children of mean 1 (sampled coordinates 1 /
    threshold, times the threshold), so survival to depth k follows p(k) = 1 - exp(-p(k - 1)).
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


RUNS = runs_for(RECALL, DEPTH)


def _sampled(nodes: np.ndarray, threshold: float) -> np.ndarray:
    """For every node (64-bit path) which coordinates it samples: a boolean matrix."""
    at = np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u = mix64(nodes[:, None] ^ mix64(at + _SEED)[None, :])
    return u < np.uint64(int(2**64 / (threshold * COORDINATES)))


def _children(nodes: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row index and path of every child of rows at ``nodes`` (one per row) with MinHash values ``sig``."""
    row, j = np.nonzero(_sampled(nodes, threshold))
    value = sig[row, j].astype(np.uint64) + (j.astype(np.uint64) << np.uint64(32))
    return row, mix64(mix64(nodes[row]) + mix64(value))


# ---------------------------------------------------------------------------- sets
_SETS = "_id long, _row long, _key binary, _n int, _sig binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = permutations(COORDINATES, seed=7)
    for batch in slices(batches):
        texts = batch.column("_text").to_pylist()
        for lo, hi in text_blocks(texts):
            h, bounds = shingles_of(texts[lo:hi])
            some = np.flatnonzero(np.diff(bounds))
            sig = np.empty((len(some), COORDINATES), dtype=np.uint32)
            if len(some):
                for f in range(COORDINATES):
                    sig[:, f] = np.minimum.reduceat(h * a[f] + b[f], bounds[some]) >> np.uint64(32)
            key, n, sigs = [None] * (hi - lo), [0] * (hi - lo), [None] * (hi - lo)
            for i, d in enumerate(some):
                s = np.unique(h[bounds[d]:bounds[d + 1]])
                key[d], n[d], sigs[d] = xxhash.xxh3_128_digest(s.tobytes()), len(s), sig[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id")[lo:hi], batch.column("_row")[lo:hi], pa.array(key, pa.binary()),
                 pa.array(n, pa.int32()), pa.array(sigs, pa.binary())], names=["_id", "_row", "_key", "_n", "_sig"])


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_no, _low): the low byte of every MinHash value, which is what buckets compare."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("_sig").to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
        low = sig.astype(np.uint8)
        yield pa.RecordBatch.from_arrays([b.column("_no"), pa.array([r.tobytes() for r in low], pa.binary())], names=["_no", "_low"])


# ---------------------------------------------------------------------------- paths
def _paths(batches: Iterator[pa.RecordBatch], threshold: float, runs: int) -> Iterator[pa.RecordBatch]:
    """(path, set): rows with a path go to its children, rows without one to the children of every run's root."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("_sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        if "_path" in batch.schema.names:
            nodes, row = batch.column("_path").to_numpy().view(np.uint64), np.arange(len(sig))
            at, path = _children(nodes, sig, threshold)
        else:
            roots = mix64(np.arange(1, runs + 1, dtype=np.uint64) * _SEED)
            row = np.repeat(np.arange(len(sig)), runs)
            at, path = _children(np.tile(roots, len(sig)), sig[row], threshold)
        yield pa.RecordBatch.from_arrays(
            [pa.array(path.view(np.int64)), batch.column("_no").take(pa.array(row[at]))], names=["_path", "_no"])


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal ``by`` of sorted batches."""
    rows = (r for b in batches for r in b.to_pylist())
    for _, g in groupby(rows, key=lambda r: tuple(r[c] for c in by)):
        yield list(g)


def forest(similar: Callable[[int, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """For each of ``n`` items the first (smallest) item of its connected group; ``similar(i, others)`` tells links."""
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        queue, first = [left[0]], left[0]
        root[first], left = first, left[1:]
        while queue and len(left):
            hit = similar(queue.pop(), left)
            root[left[hit]] = first
            queue.extend(left[hit])
            left = left[~hit]
    return root


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect the sets of each bucket whose MinHash values agree enough.

    Values are compared by their low byte; unequal ones that agree by chance only add candidates.
    """
    need = math.ceil(SLACK * COORDINATES)
    a, b = [], []
    for rows in _groups(batches, ["_path"]):
        low = np.frombuffer(b"".join(r["_low"] for r in rows), dtype=np.uint8).reshape(-1, COORDINATES)
        root = forest(lambda i, others, low=low: (low[others] == low[i]).sum(axis=1) >= need, len(rows))
        for i in np.flatnonzero(root != np.arange(len(rows))):
            a.append(rows[i]["_no"])
            b.append(rows[root[i]]["_no"])
        if len(a) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is not wanted, by a filter of bounded size before the shuffle."""
    mark = bucket_filter(wanted.withColumn("_h", F.xxhash64(key)), "_h")
    return rows.withColumn("_bucket", bucket_of(F.xxhash64(key))).join(mark, "_bucket", "left_semi").drop("_bucket")


def _candidate_links(sets: DataFrame, threshold: float, runs: int, depth: int, leaf: int) -> DataFrame:
    rows = sets.select("_no", "_sig").mapInArrow(lambda it: trimmed(_paths(it, threshold, runs)), "_path long, _no long")
    found = []
    for level in range(1, depth + 1):
        # of equal buckets (same size and same mark of their members) one stays
        buckets = written(rows.groupBy("_path").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_no")).alias("_mark"))
                          .where("_n > 1").groupBy("_n", "_mark").agg(F.min("_path").alias("_path")), "cpj-buckets")
        inside = written(_likely(rows, buckets, "_path").join(buckets.select("_path", "_n"), "_path"), "cpj-inside")
        found.append(inside.where(F.col("_n") <= leaf).select("_path", "_no"))
        inside = inside.where(F.col("_n") > leaf)
        if inside.isEmpty():
            break
        if level < depth:
            inside = inside.join(_likely(sets, inside, "_no").select("_no", "_sig"), "_no")
            rows = written(inside.select("_path", "_no", "_sig").mapInArrow(
                lambda it: trimmed(_paths(it, threshold, runs)), "_path long, _no long"), "cpj-paths")
        else:  # still large: every pair of blocks of half a leaf is a bucket
            blocks = F.ceil(2 * F.col("_n") / leaf).cast("int")
            own = F.pmod(F.xxhash64("_no"), blocks).cast("int")
            inside = inside.select("_path", "_no", own.alias("_b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_o"))
            found.append(inside.select(F.xxhash64("_path", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("_path"), "_no"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    low = _likely(sets, out, "_no").select("_no", "_sig").mapInArrow(lambda it: trimmed(_low_bytes(it)), "_no long, _low binary")
    return (out.join(low, "_no").repartition("_path").sortWithinPartitions("_path", "_no")
            .mapInArrow(lambda it: trimmed(_bucket_links(it)), "a long, b long"))


# ---------------------------------------------------------------------------- exact verification
def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of each of ``a`` with each of ``b`` (sorted distinct arrays)."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], dtype=np.int64)
    out = np.zeros((len(a), len(b)), dtype=np.float32)  # exact: sizes are far under 2**24
    values, col = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    in_a = owner < len(a)
    both = np.zeros(len(values), dtype=np.int8)  # only values on both sides take part
    both[col[in_a]] |= 1
    both[col[~in_a]] |= 2
    used = both == 3
    keep = used[col]
    owner, col = owner[keep], (np.cumsum(used) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for lo in range(0, int(used.sum()), width):
        part = slice(*np.searchsorted(col, [lo, lo + width]))
        m = np.zeros((len(a) + len(b), width), dtype=np.float32)
        m[owner[part], col[part] - lo] = 1
        out += m[:len(a)] @ m[len(a):].T
    return out.astype(np.int64)


_VERIFIED = "_root long, _no long, _links long, _first long, _alone boolean"


def _sets_of(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of texts."""
    out: list[np.ndarray] = []
    for lo, hi in text_blocks(texts):
        h, bounds = shingles_of(texts[lo:hi])
        out += [np.unique(h[bounds[d]:bounds[d + 1]]) for d in range(hi - lo)]
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per set and block pair: documents linked to it there, and the first set of its connected group there."""
    names = [f.split()[0] for f in _VERIFIED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    out: list[list] = [[] for _ in names]
    for rows in _groups((s for b in batches for s in slices([b], 200)), ["_root", "_b1", "_b2"]):
        rows = [r for i, r in enumerate(rows) if not i or r["_no"] != rows[i - 1]["_no"]]  # repeated rows: once
        sets = _sets_of([r.pop("_text") for r in rows])
        size = np.array([len(s) for s in sets])
        # pairs of two blocks, or pairs inside one
        pair = rows[0]["_b1"] != rows[0]["_b2"]
        one = np.flatnonzero([r["_b"] == r["_b1"] for r in rows])
        two = np.flatnonzero([r["_b"] != r["_b1"] for r in rows]) if pair else one
        linked = np.zeros((len(rows), len(rows)), dtype=bool)
        if len(two):
            both = overlaps([sets[i] for i in one], [sets[i] for i in two])
            linked[np.ix_(one, two)] = both >= threshold * (size[one][:, None] + size[two][None, :] - both) - 1e-9
            linked |= linked.T
            np.fill_diagonal(linked, False)
        root = forest(lambda i, others, linked=linked: linked[i, others], len(rows))
        links = linked @ np.array([r["_members"] for r in rows], dtype=np.int64)
        for i, r in enumerate(rows):
            for c, v in zip(out, (r["_root"], r["_no"], int(links[i]), rows[root[i]]["_no"], r["_blocks"] == 1), strict=True):
                c.append(v)
        if len(out[0]) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
            out = [[] for _ in names]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def _exact_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, threshold: float, block: int) -> DataFrame:
    """(_no, _class, _links) of every set in a candidate group, verified on the exact sets.

    Texts go to their blocks, which are smaller than sets; the sets are made there.
    """
    members = written(groups.select(F.col("node").alias("_no"), F.col("root").alias("_root")).join(
        sets.select("_no", "_members", "_n", "_pick"), "_no"), "cpj-members")
    size = members.groupBy("_root").agg(F.ceil(F.greatest(
        F.count("*") / block, F.sum(F.col("_n").cast("long")) * 8 / BLOCK_BYTES)).cast("int").alias("_blocks"))
    wanted = written(members.join(written(size, "cpj-sizes"), "_root").select(
        "_no", "_root", "_members", "_blocks", F.col("_pick._id").alias("_want"), F.col("_pick._row").alias("_want_row"),
        F.xxhash64("_pick._id", "_pick._row").alias("_h")), "cpj-wanted")
    # one document of each wanted set is read again; a filter of bounded size finds most of them on the scan
    texts = docs.withColumn("_bucket", bucket_of(F.xxhash64("_id", "_row"))).join(bucket_filter(wanted, "_h"), "_bucket", "left_semi")
    full = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_want")) & (F.col("_row") == F.col("_want_row")))
    own = F.pmod(F.xxhash64("_no"), F.col("_blocks")).cast("int")
    blocks = full.select("_root", "_no", "_members", "_text", "_blocks", own.alias("_b"),
                         F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o"))
    blocks = blocks.select("_root", "_no", "_members", "_text", "_blocks", "_b",
                           F.least("_b", "_o").alias("_b1"), F.greatest("_b", "_o").alias("_b2"))
    by = ["_root", "_b1", "_b2"]
    found = written(blocks.repartition(*by).sortWithinPartitions(*by, "_no").mapInArrow(
        lambda it: trimmed(_verify(it, threshold)), _VERIFIED), "cpj-verified")
    done = found.where("_alone").select("_no", F.col("_first").alias("_class"), "_links")
    parts = found.where("not _alone")
    if parts.isEmpty():
        return done
    joined = components(parts.select(F.col("_no").alias("a"), F.col("_first").alias("b")))
    links = parts.groupBy("_no").agg(F.sum("_links").alias("_links"))
    return done.unionByName(links.join(joined.select(F.col("node").alias("_no"), F.col("root").alias("_class")), "_no")
                            .select("_no", "_class", "_links"))


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, depth: int = DEPTH,
                       leaf: int = LEAF, block: int = BLOCK, id: str = "doc_id", text: str = "text",
                       row_hash: bool = False) -> DataFrame:
    """One row per input row: id, class_id, class_size, n_links (documents with similarity >= threshold).

    ``row_hash`` adds ``_row``, a hash of the text, which with the id tells the row.
    """
    docs = docs.select(F.col(id).cast("long").alias("_id"), F.xxhash64(text).alias("_row"), F.col(text).alias("_text"))
    rows = written(docs.mapInArrow(lambda it: trimmed(_sketches(it)), _SETS), "cpj-rows")
    some = rows.where("_key is not null")
    sets = written(some.groupBy("_key").agg(F.count("*").alias("_members"), F.min("_id").alias("_min"),
                                            F.min(F.struct("_id", "_row")).alias("_pick"),
                                            F.any_value("_n").alias("_n"), F.any_value("_sig").alias("_sig"))
                   .withColumn("_no", F.monotonically_increasing_id()), "cpj-sets")  # the set's number from here on
    groups = written(components(_candidate_links(sets, threshold, runs, depth, leaf)), "cpj-groups")
    exact = written(_exact_links(docs, sets, groups, threshold, block), "cpj-exact")
    info = sets.select("_no", "_key", "_members", "_min").join(exact, "_no", "left").withColumn(
        "_class", F.coalesce("_class", "_no"))
    classes = written(exact.join(sets.select("_no", "_members", "_min"), "_no").groupBy("_class").agg(
        F.min("_min").alias("_class_id"), F.sum("_members").alias("_class_size")), "cpj-classes")
    info = written(info.join(classes, "_class", "left").select(
        "_key", F.coalesce("_class_id", "_min").alias("class_id"),
        F.coalesce("_class_size", "_members").cast("long").alias("class_size"),
        (F.coalesce("_links", F.lit(0)) + F.col("_members") - 1).cast("long").alias("n_links")), "cpj-info")
    extra = ["_row"] if row_hash else []
    alone = rows.where("_key is null").select(
        F.col("_id").alias(id), F.col("_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("n_links"), *extra)
    return (some.select("_id", "_row", "_key").join(info, "_key")
            .select(F.col("_id").alias(id), "class_id", "class_size", "n_links", *extra).unionByName(alone))


def keep_one_per_class(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: the smallest id of each class stays, with all columns.

    Of rows that agree in id and class one stays.
    """
    found = written(similarity_classes(docs, threshold, id=id, text=text, row_hash=True).where("class_size > 1")
                    .select(F.col(id).alias("_id"), "class_id", "_row"), "cpj-kept")
    # the row that stays of each class, by its id and text
    stays = written(found.where(F.col("_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("class_id").alias("_class")).agg(
        F.min("_row").alias("_keep"), F.count("*").alias("_same")), "cpj-stays")
    dropped = written(found.join(stays, F.col("class_id").eqNullSafe(F.col("_class")), "left")
                      .where(~(F.col("_id").eqNullSafe(F.col("class_id")) & (F.col("_row") == F.col("_keep"))))
                      .select("_id", "_row").distinct(), "cpj-dropped")
    out = docs.select(F.struct("*").alias("_doc"), F.col(id).cast("long").alias("_doc_id"),
                      F.xxhash64(text).alias("_text_hash"))
    out = out.join(dropped, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_row")), "left_anti")
    if not stays.where("_same > 1").isEmpty():  # rows that repeat both id and text
        out = out.dropDuplicates(["_doc_id", "_text_hash"])
    return out.select("_doc.*")
