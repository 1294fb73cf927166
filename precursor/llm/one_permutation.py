"""Document fingerprints by one-permutation MinHash, DataFrame functions only.

1. The five-word shingles of a text are hashed once.  The top bits of a hash name one of ``BINS`` bins,
   and every bin keeps its smallest hash.
2. Optimal densification: an empty bin probes other bins in an order of its own (random bins, and in
   the end a walk from a random start with an odd stride, which visits every bin) and takes the
   value of the first that is not empty.  The order depends on the bin alone, so that texts borrow alike.
3. Of every bin the low ``BITS`` bits are stored, eight bins to a 64-bit word.
4. Two fingerprints agree in a share m of their bins; unequal values agree by chance in 1 of
   2**BITS, so the similarity is (m - 2**-BITS) / (1 - 2**-BITS), cut to 0..1.

:func:`with_next` pairs each document with the next by ascending id without a global sort in one task:
documents are dealt to buckets of consecutive ids, and each bucket also gets the first document of
the next one.

Defined results: words are what white space (space, tab to carriage return) separates; a text of one to four words is one shingle;
null counts as empty; a text without words has an empty fingerprint, which equals only another empty
one.  A null id sorts as the smallest long; rows with equal ids follow each other by a hash of their
text; after the last document comes the first (a single document is its own next); an empty table
gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precursor.llm.common import SHINGLE_WORDS, text_or_empty, written

BINS, BITS = 256, 8
PER_WORD = 64 // BITS
#: Random bins that an empty bin tries before it walks through all.
FIRST_PROBES = 16
_SHIFT = 64 - BINS.bit_length() + 1
#: The largest hash of a bin; it stands for "empty" (a real hash is that one in 2**56 times).
_EMPTY = (1 << _SHIFT) - 1
_MARKS = [(b << _SHIFT) + _EMPTY for b in range(-BINS // 2, BINS // 2)]
_WHITE = "\\s+"
#: Text bytes of a bucket of consecutive ids, and how many buckets (cut points on the driver) there are at most.
BUCKET_BYTES, MAX_BUCKETS = 32 << 20, 1 << 16


def probe_order(seed: int = 13) -> tuple[list[list[int]], list[int], list[int]]:
    """The bins that every bin probes first (a list per attempt), then the start and odd stride of its walk."""
    rng = np.random.default_rng(seed)
    first = rng.integers(0, BINS, (FIRST_PROBES, BINS)).tolist()
    return first, rng.integers(0, BINS, BINS).tolist(), (rng.integers(0, BINS // 2, BINS) * 2 + 1).tolist()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (a plain alias may be put in for every use inside a lambda)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, n: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of the ``n``-word shingles of a text."""

    def of(h: Column) -> Column:
        # by index: a slice in a lambda would copy the whole array for each shingle
        at_all = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]))
        return F.when(F.size(h) >= n, F.slice(at_all, F.lit(1), F.size(h) - (n - 1))).when(
            F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    words = F.array_remove(F.split(text, _WHITE), "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _is_empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_EMPTY)) == F.lit(_EMPTY)


def _bins(hashes: Column) -> Column:
    """The smallest hash of every bin, in bin order; an empty bin has its mark."""

    def first(h: Column) -> Column:
        top = lambda x: F.shiftright(x, _SHIFT)
        return F.filter(h, lambda x, i: (i == 0) | (top(x) != top(F.get(h, i - 1))))

    return let(F.sort_array(F.concat(hashes, F.lit(_MARKS))), first)


def _dense(v: Column) -> Column:
    """bin * 2**BITS + low bits for every bin, in bin order; empty bins have what they borrow."""
    first, start, stride = probe_order()
    bins, start, stride = F.lit(list(range(BINS))), F.lit(start), F.lit(stride)
    low = F.transform(v, lambda x: F.when(~_is_empty(x), x.bitwiseAND(F.lit((1 << BITS) - 1))))
    placed = lambda j, x: F.shiftleft(j.cast("long"), BITS) + x

    def walk(v: Column, rest: Column) -> Column:
        """What the bins ``rest`` meet first on their walks, a step of all of them at a time."""
        met = lambda j, t: F.get(v, (F.get(start, j) + t * F.get(stride, j)).bitwiseAND(F.lit(BINS - 1)))

        def step(acc: Column, t: Column) -> Column:
            hit = F.filter(acc["rest"], lambda j: met(j, t).isNotNull())
            return F.when(F.size(acc["rest"]) == 0, acc).otherwise(F.struct(
                F.filter(acc["rest"], lambda j: met(j, t).isNull()).alias("rest"),
                F.concat(acc["got"], F.transform(hit, lambda j: placed(j, met(j, t)))).alias("got")))

        return F.aggregate(bins, F.struct(rest.alias("rest"), F.array().cast("array<bigint>").alias("got")), step)["got"]

    def fill(v: Column) -> Column:
        near = F.transform(bins, lambda j: placed(j, F.coalesce(F.get(v, j), *[F.get(v, F.get(F.lit(p), j)) for p in first])))
        left = lambda found: F.filter(bins, lambda j: F.get(found, j).isNull())
        return let(near, lambda found: F.when(~F.exists(found, lambda x: x.isNull()), found).otherwise(F.sort_array(
            F.concat(F.filter(found, lambda x: x.isNotNull()), walk(v, left(found))))))

    return let(low, fill)


def _packed(dense: Column) -> Column:
    def word(d: Column, at: Column) -> Column:
        bits = [F.shiftleft(F.get(d, at + i).bitwiseAND(F.lit((1 << BITS) - 1)), 64 - BITS * (i + 1)) for i in range(PER_WORD)]
        return reduce(Column.bitwiseOR, bits)

    return let(dense, lambda d: F.transform(F.lit(list(range(0, BINS, PER_WORD))), lambda at: word(d, at)))


def fingerprint(text: Column | str) -> Column:
    """Packed bins of a text (``array<bigint>``), empty for a text without words."""
    none = F.array().cast("array<bigint>")
    return let(shingle_hashes(text_or_empty(text)), lambda h: F.when(F.size(h) == 0, none).otherwise(
        let(_bins(h), lambda v: _packed(_dense(v)))))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda w: F.lpad(F.hex(w), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles of two fingerprints, corrected for chance agreement."""

    def equal_bins(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for by in (4, 2, 1):  # the lowest bit of a byte becomes the OR of its bits
            z = z.bitwiseOR(F.shiftrightunsigned(z, by))
        return F.lit(PER_WORD) - F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    m = F.aggregate(F.zip_with(a, b, equal_bins), F.lit(0), lambda acc, n: acc + n) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (m - chance) / (1 - chance))))


# ---------------------------------------------------------------------------- neighbours by id
def _count_below(cuts: Sequence[int], key: Column, equal: bool) -> Column:
    """How many of the sorted ``cuts`` are under ``key`` (or equal to it), by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    at = F.lit(list(cuts))

    def step(lo: Column, s: Column) -> Column:
        c = F.get(at, lo + s - 1)
        return F.when((lo + s <= len(cuts)) & ((c <= key) if equal else (c < key)), lo + s).otherwise(lo)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def _bucket(cuts: Sequence[int]) -> Column:
    """Bucket of a row: rising with (_key, _h).  A key at several cut points is spread over their buckets by _h."""
    low, high = _count_below(cuts, F.col("_key"), False), _count_below(cuts, F.col("_key"), True)
    share = F.col("_h").cast("double") / F.lit(2.0 ** 64) + 0.5
    return let(F.struct(low.alias("low"), (high - low).alias("n")), lambda x: x["low"] + F.least(
        x["n"], F.floor(share * (x["n"] + 1)).cast("int")))


def with_next(docs: DataFrame, columns: dict[str, Column], id: str = "doc_id", text: str = "text",
              bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(_id, _text, *columns, _next_text, next_*): every document beside the next by ascending id.

    ``columns`` are computed once per document from ``_text``.  One shuffle of the texts; the cut points
    of the buckets come from approximate quantiles of the ids, which only decide the balance.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("_id"), text_or_empty(text).alias("_text")).withColumns({
        "_key": F.coalesce("_id", F.lit(-(1 << 63)).cast("long")), "_h": F.xxhash64("_text")})
    order = written(rows.select("_key", "_h", F.octet_length("_text").alias("_bytes")), "opm-order")
    total = order.agg(F.sum("_bytes")).first()[0] or 0
    wanted = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bucket_bytes))
    n = min(MAX_BUCKETS, wanted)
    cuts = order.agg(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 4 * n)).first()[0] or []

    # the first row of every bucket is also the last of the bucket before it (at most MAX_BUCKETS small rows)
    firsts = order.groupBy(_bucket(cuts).alias("_bucket")).agg(F.min(F.struct("_key", "_h")).alias("_first"))
    by_bucket = Window.orderBy("_bucket")
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_bucket", F.coalesce(F.lead("_first").over(by_bucket), F.first("_first").over(whole)).alias("_f"))
    firsts = F.broadcast(firsts.select("_bucket", F.col("_f._key").alias("_key"), F.col("_f._h").alias("_h")))
    borders = rows.join(firsts, ["_key", "_h"]).withColumn("_border", F.lit(1)).dropDuplicates(["_bucket"])

    own = rows.withColumns({"_bucket": _bucket(cuts), "_border": F.lit(0)})
    both = own.unionByName(borders).withColumns(columns)
    after = Window.partitionBy("_bucket").orderBy("_border", "_key", "_h")
    return both.withColumns({"_next_text": F.lead("_text").over(after),
                             **{f"next_{c}": F.lead(c).over(after) for c in columns}}).where("_border = 0").select(
        "_id", "_text", *columns, "_next_text", *[f"next_{c}" for c in columns])


def spliced(text: Column, following: Column) -> Column:
    """A text whose last half (rounded down, in code points) is replaced by as much of the start of another."""
    half = F.shiftright(F.length(text), 1)
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text",
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (packed words), near_edited, near_next."""
    rows = with_next(docs, {"fingerprint": fingerprint("_text")}, id, text, bucket_bytes)
    rows = rows.withColumn("_edited", spliced(F.col("_text"), F.col("_next_text")))
    rows = rows.withColumn("edited_fingerprint", fingerprint("_edited"))
    own = F.col("fingerprint")
    return rows.select(
        F.col("_id").alias(id), F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        likeness(own, F.col("next_fingerprint")).alias("near_next"))
