"""Language identification by compression with per-language zstandard dictionaries.

Each learned language has a raw-content dictionary: the lower-cased texts of a bounded sample of its
labelled documents (SAMPLE_DOCS whole documents per language).  A text is
lower-cased, cut into chunks that cover all of it, and every chunk is compressed with every
dictionary; the language with the fewest bytes wins.  The score is 1 - fewest / second fewest, and a
prediction whose score is under ``min_margin`` is marked as rejected.

Defined results: a null text or one without a letter is ``und`` with score 0, rejected; ties go to
the first language by name, score 0, rejected; with one learned language the score is 1; without any
labelled text every row is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precursor.llm.common import slices, trimmed, written

#: Bound of the labelled sample: documents per language (whole texts).
SAMPLE_DOCS = 64
#: A label column with more values than this is not a language column.
MAX_LANGUAGES = 512
CHUNK = 4096
MIN_MARGIN = 0.01
#: Appended to each chunk: a compressible tail, so that short chunks are never stored uncompressed.
_PAD = b" " * 96
_LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary content by language, in name order."""

    dictionaries: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang, content in self.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # matches of three bytes and the greedy search fit short words at a good speed
            p = zstandard.ZstdCompressionParameters.from_level(
                3, source_size=CHUNK, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_GREEDY,
                write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=p)))
        return out


def _bytes(text: str) -> bytes:
    return f" {text.lower()} ".encode("utf-8", "replace")


def classify(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """(language, score) of a whole text."""
    if not text or not compressors or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    data = _bytes(text)
    chunks = [data[i:i + CHUNK] + _PAD for i in range(0, len(data), CHUNK)]
    sizes = sorted((sum(len(c.compress(x)) for x in chunks), lang) for lang, c in compressors)
    return sizes[0][1], 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]


def learn(docs: DataFrame, labelled: Column, id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """The model of the rows where ``labelled`` holds and the language is known.

    The sample is the rows with the smallest hash of the id per language (a limit per group before
    the shuffle, on ids and hashes only); its texts are then fetched by a small semi-join.
    """
    rows = docs.where(labelled & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("_lang"), F.xxhash64(F.col(id)).alias("_h"), F.col(text).alias("_text"))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    chosen = written(rows.select("_lang", "_h").withColumn("_n", first).where(F.col("_n") <= sample_docs)
                     .select("_lang", "_h").distinct(), "langid-sample")
    if chosen.select("_lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values in the language column {lang!r}")
    sample = (rows.join(F.broadcast(chosen), ["_lang", "_h"], "left_semi").groupBy("_lang", "_h")
              .agg(F.min("_text").alias("_text")).collect())  # at most sample_docs rows per language
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample:
        texts.setdefault(r["_lang"], []).append((r["_h"], r["_text"]))
    return LanguageModel(tuple((k, b"\n".join(_bytes(t) for _, t in sorted(texts[k]))) for k in sorted(texts)))


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel, text: str, kept: float | None):
    compressors = model.compressors()
    for b in slices(batches):
        found = [classify(t, compressors) for t in b.column(text).to_pylist()]
        if kept is not None:  # filter: the rows themselves
            yield b.filter(pa.array([lang != UNDETERMINED and score >= kept for lang, score in found], pa.bool_()))
        else:
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i, n in enumerate(b.schema.names) if n != text),
                 pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*(n for n in b.schema.names if n != text), "lang_pred", "score"])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per input row: the ``keep`` columns, lang_pred, score, rejected."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(lambda it: trimmed(_predict(it, model, "_text", None)),
                           f"{schema}, lang_pred string, score double").withColumn(
        "rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < min_margin))


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text",
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns; nothing is shuffled."""
    return docs.mapInArrow(lambda it: trimmed(_predict(it, model, text, min_margin)), docs.schema)
