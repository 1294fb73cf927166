"""One query per corpus operator, over the whole tables of a folder, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precursor.llm import (chosen_path, conversation_repair, decontaminate, disclosure, exact_dedup, hilbert_shards, one_permutation, prefix_parsing,
                           secret_forest, ss_packing, warc_salvage, whitening, zstd_langid)
from precursor.llm.common import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(_table(spark, sf_dir, "documents")).withColumn(
        "grown_shard", F.lit(None).cast("int"))


def op2_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_parsing.remove_repeats(_table(spark, sf_dir, "documents"))


def held_out(id: str = "doc_id"):
    """A fifth of the documents, by checksum of the id: never learnt from."""
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(5)) == 0


def op3_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = zstd_langid.learn(docs, ~F.coalesce(held_out(), F.lit(True)))
    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return zstd_langid.identify(rows, model, keep=("doc_id", "held_out"))


def op4_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(_table(spark, sf_dir, "documents"),
                                    extra={"text_sha256": F.sha2("_norm", 256)})


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.personal_data(_table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*disclosure.KINDS))

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[n(k) for k in disclosure.KINDS],
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss_packing.pack(_table(spark, sf_dir, "documents"))


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similarity_classes(_table(spark, sf_dir, "documents"))


def op8_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_salvage.read_archives(warc_salvage.write_archives(_table(spark, sf_dir, "pages")),
                                         with_payload=False)
    return records.where("gap_bytes is null").select(
        warc_salvage.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc_salvage.page_of("refers_to").alias("refers_to"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(_table(spark, sf_dir, "documents"))


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_suffix_dawg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.rows_of(_table(spark, sf_dir, "conversations"))
    return conversation_repair.report(conversation_repair.damaged(rows))


def op13_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = one_permutation.fingerprints(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: one_permutation.as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_hilbert_shards, op2_prefix_free_parsing, op3_zstd_language, op4_progressive_dedup,
        op5_disclosure, op6_sum_of_squares_packing, op7_chosen_path_join, op8_containment_search, op9_warc_salvage, op10_secret_forest,
        op11_block_whitening, op12_suffix_dawg, op13_one_permutation)}

ORACLE_SQL: dict[str, str] = {
    "op4_progressive_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM n WINDOW w AS (PARTITION BY h)""",
    "op9_warc_salvage": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, n AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31
                            AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM m""",
}
