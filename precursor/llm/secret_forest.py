"""Secret scan with a random forest that removes false positives.

Candidates are runs of at least MIN_LENGTH key characters, keys in a public issuer's format, and, at any
length and of any characters, values assigned to a secret's name (in quotes, or up to white space
without closing marks).  Spans that differ are reported each.  Each candidate gets features of its length and
character classes, its character transitions (mean log-probability under the corpus's transitions),
its dictionary coverage (share of it made of frequent corpus words), its path (the document's source,
hashed) and its neighbouring words (hashed, with assignment and quote marks).  A random forest trained
on labelled findings scores every candidate; those under ``THRESHOLD`` are removed as false positives.

Corpus statistics cover all documents: transition counts, and word counts in a table of fixed size
indexed by hash; a word is frequent if its entry holds at least FREQUENT of all words, so at most
1 / FREQUENT entries are sent to the tasks, whatever the corpus size.

Labelled findings: any table with the features and a 0/1 label can be given; by default findings are
labelled where a public issuer format or an assignment to a secret's name tells a secret, or plain
words or digits without such a name tell none, and the rest is left unlabelled.  Training takes the SAMPLE findings per
label with the smallest hash.

Defined results: null and empty texts have no candidate; rows that agree in all columns are reported
each; a null source is an empty path; without findings of both labels nothing can be learnt and every
finding not labelled 0 is kept with the score of its label (0.5 if it has none); an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precursor.llm.common import mix64, prefix_sums, slices, text_blocks, text_or_empty, word_hashes, written

MIN_LENGTH = 16
THRESHOLD = 0.5
#: Labelled findings per label that the forest learns from.
SAMPLE = 20_000
TREES, TREE_DEPTH = 32, 8
#: Entries of the word table, and the share of all words that makes an entry frequent.
WORD_ENTRIES, FREQUENT = 1 << 18, 2e-5
PATH_BUCKETS, NEAR_BUCKETS = 8, 24

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{%d,}={0,2}" % MIN_LENGTH)
# Public formats of issued keys, and names that a secret is assigned to (fixed values).
_ISSUED = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{20,}")
_ISSUED_KEY = re.compile(rf"(?<![A-Za-z0-9])(?:{_ISSUED.pattern})(?![A-Za-z0-9])")
_TO_NAME = r"(?:password|passwd|pwd|secret|token|api_?key|access_?key)[\"']?\s*(?::=|=|:)\s*"
_ASSIGNED = re.compile(_TO_NAME + r"[\"']?$", re.I)
_VALUE = re.compile(_TO_NAME + r"""(?:""|''|"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|["']?(\S*[^\s,;.)\]}>"']))""", re.I)
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SYMBOLS = 38  # 26 letters, 10 digits, other, edge
_CODE = np.full(256, 36, dtype=np.int64)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(26)
_CODE[0x30:0x3A] = 26 + np.arange(10)
_CODE[[0x09, 0x0A, 0x0D, 0x20]] = 37


# ---------------------------------------------------------------------------- corpus statistics
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task: transitions at keys 0 to _SYMBOLS**2, then word entries."""
    pairs = np.zeros(_SYMBOLS * _SYMBOLS, dtype=np.int64)
    words = np.zeros(WORD_ENTRIES, dtype=np.int64)
    for b in slices(batches):
        texts = b.column("_text").to_pylist()
        for lo, hi in text_blocks(texts):
            data = " ".join(texts[lo:hi]).encode("utf-8", "surrogatepass")
            code = _CODE[np.frombuffer(data, dtype=np.uint8)]
            pairs += np.bincount(code[:-1] * _SYMBOLS + code[1:], minlength=len(pairs))
            _, h = word_hashes(data.translate(_LETTERS))
            words += np.bincount((h % np.uint64(WORD_ENTRIES)).astype(np.int64), minlength=WORD_ENTRIES)
    all_ = np.concatenate([pairs, words])
    at = np.flatnonzero(all_)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(all_[at])], names=["_key", "_n"])


@dataclass(frozen=True)
class CorpusStatistics:
    """Log-probabilities of character transitions and the frequent entries of the word table."""

    transitions: np.ndarray
    frequent: frozenset[int]


def corpus_statistics(docs: DataFrame, text: str = "text") -> CorpusStatistics:
    counts = written(docs.select(text_or_empty(text).alias("_text")).mapInArrow(_count, "_key int, _n long")
                     .groupBy("_key").agg(F.sum("_n").alias("_n")), "secret-counts")
    edge = _SYMBOLS * _SYMBOLS
    pairs = np.ones(edge)
    for r in counts.where(F.col("_key") < edge).collect():  # at most _SYMBOLS ** 2 rows
        pairs[r["_key"]] += r["_n"]
    pairs = pairs.reshape(_SYMBOLS, _SYMBOLS)
    words = counts.where(F.col("_key") >= edge)
    total = words.agg(F.sum("_n")).first()[0] or 0
    frequent = words.where(F.col("_n") >= FREQUENT * total).select("_key").collect()  # at most 1 / FREQUENT rows
    return CorpusStatistics(np.log(pairs / pairs.sum(axis=1, keepdims=True)),
                            frozenset(r["_key"] - edge for r in frequent))


# ---------------------------------------------------------------------------- candidates
@lru_cache(maxsize=4)
def _entries(frequent: frozenset[int]) -> np.ndarray:
    entries = np.zeros(WORD_ENTRIES, dtype=bool)
    entries[list(frequent)] = True
    return entries


def coverage(value: str, frequent: frozenset[int], piece: int = 1 << 16) -> float:
    """Share of the bytes that lie in frequent words of 4 to 12 letters, longest first from the left.

    The words that begin at each byte are hashed from prefix sums, a piece of the value at a time.
    """
    raw = np.frombuffer(value.lower().encode(), dtype=np.uint8)
    letter = (raw >= 0x61) & (raw <= 0x7A)
    if len(raw) < 4 or not letter.any():
        return 0.0
    entries = _entries(frequent)
    longest = np.zeros(len(raw), dtype=np.uint8)  # longest frequent word that begins here
    for lo in range(0, len(raw), piece):
        part, ok = raw[lo:lo + piece + 11], np.concatenate([[0], np.cumsum(letter[lo:lo + piece + 11])])
        total, down = prefix_sums(part)
        for n in range(4, min(12, len(part)) + 1):
            begin = np.flatnonzero(ok[n:] - ok[:-n] == n)
            begin = begin[begin < piece]
            h = mix64((total[begin + n] - total[begin]) * down[begin])
            longest[lo + begin[entries[(h % np.uint64(WORD_ENTRIES)).astype(np.int64)]]] = n
    at = covered = 0
    for start in np.flatnonzero(longest).tolist():
        if start >= at:
            n = int(longest[start])
            covered, at = covered + n, start + n
    return covered / len(raw)


def features(value: str, before: str, after: str, path: str, stats: CorpusStatistics) -> list[float]:
    raw = np.frombuffer(value.encode(), dtype=np.uint8)
    code = _CODE[raw]
    digit, other = (code >= 26) & (code < 36), code >= 36
    upper = (raw >= 0x41) & (raw <= 0x5A)
    kind = np.where(digit, 0, np.where(other, 1, np.where(upper, 2, 3)))
    share = np.bincount(raw, minlength=256)
    p = share[share > 0] / len(raw)
    out = [len(raw), digit.mean(), upper.mean(), other.mean(), float(np.isin(raw, list(b"0123456789abcdef")).mean()),
           float(-(p * np.log2(p)).sum()), float((kind[1:] != kind[:-1]).sum() / max(len(raw) - 1, 1)),
           float(stats.transitions[code[:-1], code[1:]].sum() / max(len(raw) - 1, 1)), coverage(value, stats.frequent),
           float(before.rstrip(" \"'").endswith(("=", ":"))), float(before.endswith(("\"", "'")))]
    paths, near = [0.0] * PATH_BUCKETS, [0.0] * NEAR_BUCKETS
    for w in re.findall(r"[A-Za-z]+|[0-9]+", path.lower()):
        paths[zlib.crc32(w.encode()) % PATH_BUCKETS] += 1
    for w in re.findall(r"[^\W\d_]+", before.lower())[-2:] + re.findall(r"[^\W\d_]+", after.lower())[:1]:
        near[zlib.crc32(w.encode()) % NEAR_BUCKETS] += 1
    return [*map(float, out), *paths, *near]


def weak_label(value: str, before: str, covered: float) -> int | None:
    """1 or 0 where a public format or plain content tells, else None."""
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    assigned = _ASSIGNED.search(before)
    if _ISSUED.fullmatch(value) or (mixed and assigned):
        return 1
    if assigned:  # a plain word or number can be a password
        return None
    return 0 if not mixed or covered >= 0.8 else None


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate, each once."""
    found = {m.span() for r in (_CANDIDATE, _ISSUED_KEY) for m in r.finditer(text)}
    if "=" in text or ":" in text:
        found.update(m.span(m.lastindex) for m in _VALUE.finditer(text) if m.lastindex)
    return sorted(found)


FINDINGS = "_id long, start long, end long, length long, value_sha256 string, features array<double>, label int"
_NEAR = 40
_COVERED = 8  # where features() has the coverage


def _find(batches: Iterator[pa.RecordBatch], stats: CorpusStatistics) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FINDINGS.replace("array<double>", "a").split(", ")]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.float64()), pa.int32()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=names)

    rows: list[tuple] = []
    for b in slices(batches):
        for id, text, path in zip(*(b.column(c).to_pylist() for c in ("_id", "_text", "_path")), strict=True):
            for start, end in candidate_spans(text):
                before, after, value = text[max(0, start - _NEAR):start], text[end:end + _NEAR], text[start:end]
                f = features(value, before, after, path, stats)
                rows.append((id, start, end, len(value), hashlib.sha256(value.encode()).hexdigest(), f,
                             weak_label(value, before, f[_COVERED])))
                if len(rows) >= 5000:
                    yield batch(rows)
                    rows = []
    if rows:
        yield batch(rows)


def candidates(docs: DataFrame, stats: CorpusStatistics, id: str = "doc_id", text: str = "text",
               path: str = "source") -> DataFrame:
    """One row per candidate, with its features and (weak) label or null."""
    rows = docs.select(F.col(id).cast("long").alias("_id"), text_or_empty(text).alias("_text"),
                       F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"))
    return rows.mapInArrow(lambda it: _find(it, stats), FINDINGS).withColumnRenamed("_id", id)


def train(findings: DataFrame, sample: int = SAMPLE, seed: int = 10):
    """A forest learnt from labelled findings, or None if they don't hold both labels."""
    order = Window.partitionBy("label").orderBy("_h", "value_sha256")
    rows = findings.where("label is not null").select(
        F.col("label").cast("double"), "features", "value_sha256", F.xxhash64("value_sha256", "features").alias("_h"))
    # one of findings that agree in all features, so that copies of a document don't fill the sample
    chosen = written(rows.dropDuplicates(["_h"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
                     .select("label", "features", "_h"), "secret-sample")
    if chosen.select("label").distinct().count() < 2:
        return None
    # few partitions in a fixed order: the forest doesn't depend on how the sample was written
    vectors = chosen.repartition(4, "_h").sortWithinPartitions("_h").select("label", array_to_vector("features").alias("x"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH, seed=seed,
                                  cacheNodeIds=False).fit(vectors)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id: str = "doc_id", text: str = "text",
         path: str = "source") -> DataFrame:
    """One row per candidate: id, start, end (code points), length, value_sha256, label, score, is_secret."""
    found = written(candidates(docs, corpus_statistics(docs, text), id, text, path), "secret-findings")
    forest = train(found if labelled is None else labelled)
    if forest is None:
        score = F.coalesce(F.col("label").cast("double"), F.lit(0.5))
    else:
        found = forest.setFeaturesCol("x").transform(found.withColumn("x", array_to_vector("features")))
        score = vector_to_array("probability")[1]
    return found.select(id, "start", "end", "length", "value_sha256", "label", score.alias("score")).withColumn(
        "is_secret", F.col("score") >= THRESHOLD)
