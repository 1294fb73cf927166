"""Training-data pipeline over ``documents``: language, exact copies, near copies, benchmark leaks, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precursor.llm import chosen_path, decontaminate, exact_dedup, ss_packing, zstd_langid
from precursor.llm.common import importable, written
from precursor.llm.queries import held_out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier does not reject."""
    importable(spark)
    return zstd_langid.keep_identified(docs, zstd_langid.learn(docs, ~F.coalesce(held_out(), F.lit(True))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    importable(spark)
    return chosen_path.keep_one_per_class(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    importable(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    importable(spark)
    return ss_packing.pack(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies),
          ("benchmark_leaks", benchmark_leaks), ("packing", packing)]

#: Language identification by compression and packing of tokens are not SQL; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
