"""Fingerprinted parquet materialisation in the shared scratch folder.

``materialize`` writes a DataFrame once under ``<spark.checkpoint.dir>/precursor/<name>-<fp>``
and returns a DataFrame that reads it back, which also cuts the lineage: a lost
executor re-reads files instead of recomputing the upstream plan.  The
fingerprint is an md5 of the canonical JSON of the parameters plus a snapshot id
of the input files (names, sizes, modification times of all of them), so a change
of the data gives a new key.  Empty results are cached too.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precursor.session import scratch_dir


# Bumped whenever the columns of a materialised stage change, so that a cache in a
# persistent scratch folder is never read back with an old layout.
LAYOUT_VERSION = 5


def fingerprint(*parts) -> str:
    """md5 of the canonical JSON of ``parts`` and the layout version (dict keys sorted)."""
    text = json.dumps([LAYOUT_VERSION, parts], sort_keys=True, default=str, separators=(",", ":"))
    return hashlib.md5(text.encode("utf-8")).hexdigest()


def snapshot_id(*dfs: DataFrame) -> str | None:
    """Identity of the files behind ``dfs``: number, and hashes of path, length and modification time of all.

    The roots that a source was read from are listed by Spark's file source, and the listing is
    folded to sums by a Spark job; no list of files comes to the driver's Python or into a plan.
    None when a source has no files (a table behind JDBC, rows made in memory): its data cannot
    be told from its plan, so nothing made from it may be reused.
    """
    parts = []
    for df in dfs:
        for roots in _roots(df) or [None]:
            if not roots:
                return None
            listed = (df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
                      .select("path", "length", "modificationTime"))
            marks = [F.bit_xor(F.xxhash64("path", "length", "modificationTime", F.lit(i))) for i in (1, 2)]
            row = listed.agg(F.count("*"), F.sum("length"), *marks).first()
            parts.append([roots, *map(str, row)])
    return fingerprint(parts)


def snapshot(*dfs: DataFrame) -> str:
    """Identity of the data and plans of ``dfs``; a new one each time when their data cannot be identified."""
    files = snapshot_id(*dfs) or uuid.uuid4().hex
    # the plans cover what is computed from the files, such as the adapter's expressions
    plans = [df._jdf.queryExecution().analyzed().canonicalized().toString() for df in dfs]
    return fingerprint(files, plans, [df.semanticHash() for df in dfs], [df.schema.json() for df in dfs])


def _roots(df: DataFrame) -> list[list[str] | None]:
    """The root paths of every source in the plan of ``df``, as they were given to the reader (None: it has none)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out: list[list[str] | None] = []
    for i in range(leaves.size()):
        try:
            paths = leaves.apply(i).relation().location().rootPaths()
        except Py4JError:  # not a table of files
            out.append(None)
        else:
            out.append(sorted(paths.apply(k).toString() for k in range(paths.size())))
    return out


def cache_path(spark: SparkSession, name: str, fp: str) -> str:
    return f"{scratch_dir(spark)}/precursor/{name}-{fp}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialize(df: DataFrame, name: str, fp: str) -> DataFrame:
    """Write ``df`` as parquet under the scratch folder (once per fingerprint) and read it back.

    A folder counts as written only when its ``_SUCCESS`` marker exists, so a job
    that died half-way is simply redone.  The read uses ``df``'s schema, which
    keeps empty and partitioned results readable and the column order stable.
    """
    spark = df.sparkSession
    path = cache_path(spark, name, fp)
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)



def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the scratch folder and read back: cuts the lineage, and its size is known to the planner."""
    path = cache_path(df.sparkSession, name, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
