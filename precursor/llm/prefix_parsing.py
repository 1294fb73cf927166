"""Removal of repeated 100-byte strings by prefix-free parsing.

Texts are byte strings.  A byte is removed when it lies in a string of ``length`` bytes that also
starts earlier in the corpus (smaller doc_id, or the same document and an earlier start); strings are
judged on the input, and matches never cross documents.

1. **Triggers.**  A rolling hash is taken of every ``WIDTH`` bytes; of the hashes inside a window of
   ``length`` bytes the smallest (leftmost of equal ones) is the window's trigger.  Equal windows have
   the same trigger at the same place, wherever they occur.
2. **Phrases.**  The windows of one trigger follow each other; the bytes they cover are a phrase.
   Phrases are content-defined, overlap, and cover every window once.  The distinct phrases are the
   dictionary, their occurrences in document order are the parse.
3. **Corpus order.**  Occurrences are grouped by (trigger, phrase): all but the first in corpus order
   are removed whole.  Tasks do this for their own rows before the shuffle, so a passage repeated in a
   third of all rows sends one row per task.
4. **Suffixes.**  Different phrases of one trigger can share windows (the edges of repeated
   passages).  Only for these the bytes are fetched; the phrases' suffixes that start at the same
   distance from the trigger are sorted by their first ``length`` bytes and by corpus order, and all
   but the first of equal ones are removed.  Phrases of a trigger are compared in one task; the
   windows of a trigger with more than ``TOGETHER`` phrases are grouped row by row instead.
5. The removed runs of each document are merged and cut out.

Strings are compared by two independent 64-bit hashes together.  Long texts are parsed in
overlapping pieces of bounded size.

Defined results: null is an empty text; a text shorter than ``length`` is kept whole; rows that agree
in doc_id and text are the same document and get the same result; rows that agree in doc_id only are
ordered by a hash of their text; a null doc_id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precursor.llm.common import FILTER_BUCKETS, mix64, slices, text_or_empty, trimmed, written

LENGTH = 100
WIDTH = 32
#: Bytes parsed together; a longer text is parsed in pieces that overlap by LENGTH - 1 bytes.
PIECE = 1 << 18
#: Bytes of parsed text whose phrases a task combines before it sends them.
COMBINE = 8 << 20
#: Bytes of text per partition of the phrase shuffle.
PER_PARTITION = 8 << 20

#: Phrases of one trigger that one task compares; windows of a trigger with more are grouped one by one.
TOGETHER = 10_000
#: Low bits of a rolling hash that make room for a place in a block of pieces.
_PLACE_BITS = np.uint64(22)
_RNG = np.random.default_rng(31)
#: Two independent polynomial hashes: a random value per byte, an odd base and its inverse.
_BYTES = _RNG.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        n = max(n, 2 * PIECE)
        _POWERS[:] = [tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, k, dtype=np.uint64)]))
                            for k in (base, pow(base, -1, 1 << 64))) for base in _BASES]
    return _POWERS


class Hashes:
    """Hash of any substring of a buffer, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        self.down = _powers(len(data) + 1)[which][1]
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[which][data] * _powers(len(data) + 1)[which][0][:len(data)], out=self.total[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.down[start])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (prefix and suffix minima of blocks)."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:len(x)] = x
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def parse(texts: list[bytes], length: int = LENGTH, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Phrases of some texts: trigger hash, phrase hash, text number, first window, trigger, last window.

    Positions are byte offsets in the text.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(size) - size
    if len(data) < length:
        return tuple(np.empty(0, dtype=d) for d in (np.uint64, np.uint64, *[np.int64] * 4))
    one, two = Hashes(data, 0), Hashes(data, 1)
    grams = one.of(slice(0, len(data) - width + 1), slice(width, len(data) + 1))
    # the position in the low bits: the leftmost of equal hashes is the smallest
    bits = _PLACE_BITS
    if len(data) >> int(bits):
        raise ValueError("too many bytes for one call")
    low = _window_min((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), length - width + 1)
    trigger = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    windows = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(owner)) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    trigger = trigger[start]
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])])) \
        if len(start) else np.empty(0, dtype=np.int64)
    a, t, doc = start[new], trigger[new], owner[new]
    b = start[np.append(new[1:], len(start)) - 1] if len(new) else a
    phrase = mix64(two.of(a, b + length) ^ mix64(((t - a) << 20 | (b - a)).astype(np.uint64)))
    return grams[t], phrase, doc, a - first[doc], t - first[doc], b - first[doc]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Blocks of about PIECE bytes: texts or overlapping pieces of long ones, their row and their offset."""
    block, rows, offsets, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for lo in range(0, max(1, len(t) - length + 1), PIECE):
            block.append(t[lo:lo + PIECE + length - 1])
            rows.append(i)
            offsets.append(lo)
            size += len(block[-1])
            if size >= PIECE:
                yield block, rows, offsets
                block, rows, offsets, size = [], [], [], 0
    if block:
        yield block, rows, offsets


# ---------------------------------------------------------------------------- records between tasks
#: A phrase occurrence: hashes, row (id and text hash), and its span.
PHRASE = np.dtype([("g", "<u8"), ("h", "<u8"), ("id", "<i8"), ("row", "<i8"), ("a", "<i4"), ("t", "u1"), ("b", "u1")])
#: First window, and from it the distances to the trigger and to the last window.
SPAN = np.dtype([("a", "<i4"), ("t", "u1"), ("b", "u1")])
SENT = "_part int, _id long, _row long, _kind string, _data binary"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_NAMES = [f.split()[0] for f in SENT.split(", ")]
_NULL_ID = -(1 << 63)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)


def _by_row(records: np.ndarray, kind: str) -> Iterator[tuple]:
    """One (id, row) record with the packed spans of each document in ``records``."""
    if not len(records):
        return
    records = records[np.lexsort((records["a"], records["row"], records["id"]))]
    new = np.flatnonzero(np.concatenate([[True], (records["id"][1:] != records["id"][:-1])
                                         | (records["row"][1:] != records["row"][:-1])])).tolist()
    spans = np.empty(len(records), dtype=SPAN)
    for f in SPAN.names:
        spans[f] = records[f]
    for lo, hi in zip(new, [*new[1:], len(records)], strict=True):
        yield None, int(records["id"][lo]), int(records["row"][lo]), kind, spans[lo:hi].tobytes()


def _first_and_rest(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences sorted by trigger, phrase and corpus order: the first of each phrase, and the others."""
    p = p[np.lexsort((p["a"], p["row"], p["id"], p["h"], p["g"]))]
    if not len(p):
        return p, p
    new = np.concatenate([[True], (p["g"][1:] != p["g"][:-1]) | (p["h"][1:] != p["h"][:-1])])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    same = np.ones(len(p), dtype=bool)  # the first itself, or a repeated row
    for f in ("id", "row", "a"):
        same &= p[f] == p[f][lead]
    return p[new], p[~same]


def _send(batches: Iterator[pa.RecordBatch], parts: int, length: int) -> Iterator[pa.RecordBatch]:
    """Phrases to the partition of their trigger; removals that the task already knows, by document."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        first, rest = _first_and_rest(np.concatenate(held))
        part = (first["g"] >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        first, part = first[order], part[order]
        bounds = np.searchsorted(part, np.arange(parts + 1))
        rows = [(k, None, None, "phrases", first[bounds[k]:bounds[k + 1]].tobytes())
                for k in range(parts) if bounds[k] < bounds[k + 1]]
        rows += [(r[2] % parts, *r[1:]) for r in _by_row(rest, "cut")]
        for lo in range(0, len(rows), 1000):
            yield _batch(rows[lo:lo + 1000])

    for b in slices(batches):
        ids = np.array([_NULL_ID if i is None else i for i in b.column("_id").to_pylist()], dtype=np.int64)
        hashes = b.column("_row").to_numpy()
        texts = [t.encode("utf-8", "surrogatepass") for t in b.column("_text").to_pylist()]
        for block, rows, offsets in _pieces(texts, length):
            g, h, doc, a, t, last = parse(block, length)
            p = np.empty(len(g), dtype=PHRASE)
            row = np.array(rows, dtype=np.int64)[doc]
            p["g"], p["h"], p["id"], p["row"] = g, h, ids[row], hashes[row]
            p["a"], p["t"], p["b"] = a + np.array(offsets, dtype=np.int64)[doc], t - a, last - a
            held.append(p)
            size += sum(map(len, block))
            if size >= COMBINE:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _settle(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """Cuts of all but the first occurrence of each phrase; asks for triggers with several phrases."""
    held: list[np.ndarray] = []
    for b in batches:
        kinds, data = b.column("_kind").to_pylist(), b.column("_data").to_pylist()
        held += [np.frombuffer(d, dtype=PHRASE) for k, d in zip(kinds, data, strict=True) if k == "phrases"]
        told = pa.array([k != "phrases" for k in kinds])
        yield b.filter(told)
    if not held:
        return
    first, rest = _first_and_rest(np.concatenate(held))
    _, n = np.unique(first["g"], return_counts=True)
    n = np.repeat(n, n)
    rows = list(_by_row(rest, "cut")) + list(_by_row(first[(n > 1) & (n <= together)], "ask"))
    rows += _by_row(first[n > together], "hot")
    for lo in range(0, len(rows), 1000):
        yield _batch(rows[lo:lo + 1000])


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(trigger hash, id, row, first window, trigger, windows, bytes) of the phrases asked for."""
    unzip = zstandard.ZstdDecompressor()
    names = ["_g", "_id", "_row", "_a", "_t", "_n", "_bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for b in slices(batches):
        cols: list[list] = [[] for _ in names]
        for id, row, packed, asks in zip(*(b.column(c).to_pylist() for c in ("_id", "_row", "_packed", "_asks")), strict=True):
            text = unzip.decompress(packed)
            for ask in asks:
                for a, t, n in np.frombuffer(ask, dtype=SPAN).tolist():
                    phrase = text[a:a + n + length]
                    g = int.from_bytes(hashlib.blake2b(phrase[t:t + WIDTH], digest_size=8).digest(), "little", signed=True)
                    for c, v in zip(cols, (g, id, row, a, t, n + 1, phrase), strict=True):
                        c.append(v)
            if len(cols[0]) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                cols = [[] for _ in names]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _windows(b: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Per window of some phrases: the phrase, two hashes of (trigger, distance to it, first bytes), its start."""
    g = b.column("_g").to_numpy().view(np.uint64)
    a, t, n = (b.column(c).to_numpy().astype(np.int64) for c in ("_a", "_t", "_n"))
    data = b.column("_bytes").to_pylist()
    buffer = np.frombuffer(b"".join(data), dtype=np.uint8)
    first = np.cumsum([0, *map(len, data)])[:-1]
    who = np.repeat(np.arange(len(n)), n)
    o = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    at = first[who] + o
    key = mix64(g[who] ^ mix64((t[who] - o).astype(np.uint64)))
    one = Hashes(buffer, 0).of(at, at + length) ^ key
    two = Hashes(buffer, 1).of(at, at + length) ^ mix64(key)
    return who, one, two, a[who] + o


_PHRASES = 2000


def _suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row per window: its hashes and its place."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _PHRASES):
            b = batch.slice(lo, _PHRASES)
            who, one, two, s = _windows(b, length)
            who = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), b.column("_id").take(who),
                 b.column("_row").take(who), pa.array(s)], names=["_one", "_two", "_id", "_row", "_s"])


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Cuts of the windows that are not the first of their kind, for phrases sorted by trigger."""

    def later(b: pa.RecordBatch) -> pa.RecordBatch:
        who, one, two, s = _windows(b, length)
        w = np.zeros(len(who), dtype=PHRASE)
        w["g"], w["h"], w["a"] = one, two, s
        w["id"], w["row"] = b.column("_id").to_numpy()[who], b.column("_row").to_numpy()[who]
        return _batch(list(_by_row(_first_and_rest(w)[1], "cut")))

    held: pa.Table | None = None
    for b in batches:
        table = pa.Table.from_batches([b])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows > _PHRASES:  # whole triggers, at least _PHRASES rows if there are that many
            g = held.column("_g").to_numpy()
            ends = np.flatnonzero(g[1:] != g[:-1]) + 1
            ends = ends[ends >= _PHRASES]
            if not len(ends):
                break
            yield later(held.slice(0, int(ends[0])).combine_chunks().to_batches()[0])
            held = held.slice(int(ends[0]))
    if held is not None and held.num_rows:
        yield later(held.combine_chunks().to_batches()[0])


def _kept(text: bytes, cuts: list[bytes], length: int) -> tuple[int, int, int, str]:
    """(bytes, removed bytes, removed runs, SHA-256 of the rest) of a text."""
    spans = np.frombuffer(b"".join(cuts), dtype=SPAN)
    start = spans["a"].astype(np.int64)
    end = start + spans["b"] + length
    if not len(start):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    starts, ends = start[new], end[np.append(new[1:], len(start)) - 1]
    rest, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        rest.update(text[at:s])
        at = e
    rest.update(text[at:])
    return len(text), int((ends - starts).sum()), len(starts), rest.hexdigest()


RESULT = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    names = [f.split()[0] for f in RESULT.split(", ")]
    for b in slices(batches):
        rows = [(id, *_kept(unzip.decompress(packed), cuts or [], length)) for id, packed, cuts in
                zip(*(b.column(c).to_pylist() for c in ("_id", "_packed", "_cuts")), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 4, pa.string()], strict=True)], names=names)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in slices(batches):
        packed = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_row"), pa.array(packed, pa.binary())],
                                         names=["_id", "_row", "_packed"])


def _bucket(id: Column, row: Column) -> Column:
    return F.pmod(F.xxhash64(id, row), F.lit(FILTER_BUCKETS)).cast("int")


def _texts_of(docs: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Packed texts joined with per-document ``facts``; a bounded filter drops most other texts on the scan."""
    mark = F.broadcast(facts.select(_bucket(F.col("_id"), F.col("_row")).alias("_b")).distinct())
    some = docs.withColumn("_b", _bucket(F.col("_id"), F.col("_row"))).join(mark, "_b", "left_semi")
    packed = some.select("_id", "_row", "_text").mapInArrow(lambda it: trimmed(_pack(it)), "_id long, _row long, _packed binary")
    return packed.join(facts, ["_id", "_row"], how)


def _packed_start(s: Column) -> Column:
    """A SPAN of one window: four little-endian bytes and two zeros."""
    big = F.lpad(F.hex(s), 8, "0")
    return F.unhex(F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)], F.lit("0000")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text",
                   together: int = TOGETHER) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans (removed runs), kept_sha256."""
    if not WIDTH < length <= 255:
        raise ValueError(f"length must be between {WIDTH + 1} and 255")
    docs = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_NULL_ID)).alias("_id"), text_or_empty(text).alias("_text"))
    docs = docs.withColumn("_row", F.xxhash64("_text")).select("_id", "_row", "_text")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_PARTITION))
    sent = docs.mapInArrow(lambda it: trimmed(_send(it, parts, length)), SENT)
    settled = written(sent.repartitionById(parts, "_part").mapInArrow(
        lambda it: trimmed(_settle(it, together)), SENT).drop("_part"), "pfp-settled")

    def phrases(kind: str) -> DataFrame:
        asks = written(settled.where(F.col("_kind") == kind).groupBy("_id", "_row").agg(
            F.collect_list("_data").alias("_asks")), f"pfp-{kind}")
        return _texts_of(docs, asks, "inner").dropDuplicates(["_id", "_row"]).mapInArrow(
            lambda it: trimmed(_fetch(it, length)), "_g long, _id long, _row long, _a int, _t int, _n int, _bytes binary")

    compared = phrases("ask").repartition("_g").sortWithinPartitions("_g").mapInArrow(lambda it: trimmed(_compare(it, length)), SENT)
    cuts = settled.where("_kind = 'cut'").unionByName(compared.drop("_part"))
    if not settled.where("_kind = 'hot'").isEmpty():
        windows = written(phrases("hot").mapInArrow(
            lambda it: trimmed(_suffixes(it, length)), "_one long, _two long, _id long, _row long, _s long"), "pfp-windows")
        place = F.struct("_id", "_row", "_s")
        first = written(windows.groupBy("_one", "_two").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
                        .where("_n > 1").drop("_n"), "pfp-first")
        later = windows.join(first, ["_one", "_two"]).where(place != F.col("_first"))
        cuts = cuts.unionByName(later.select("_id", "_row", F.lit("cut").alias("_kind"), _packed_start(F.col("_s")).alias("_data")))
    removed = written(cuts.groupBy("_id", "_row").agg(F.collect_list("_data").alias("_cuts")), "pfp-removed")

    touched = _texts_of(docs, removed, "left").mapInArrow(lambda it: trimmed(_cut(it, length)), RESULT)
    mark = F.broadcast(removed.select(_bucket(F.col("_id"), F.col("_row")).alias("_b")).distinct())
    whole = docs.withColumn("_b", _bucket(F.col("_id"), F.col("_row"))).join(mark, "_b", "left_anti").select(
        "_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("_text").cast("binary"), 256).alias("kept_sha256"))
    return touched.unionByName(whole).withColumn("_id", F.nullif("_id", F.lit(_NULL_ID))).withColumnRenamed("_id", id)
