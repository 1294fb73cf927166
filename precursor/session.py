"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the pipeline relies on.  Timestamps in the data are zone-less, so the
# session zone is pinned; AQE re-plans joins and partition counts at runtime.
RECOMMENDED_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # HotSpot never compiles methods of more than 8000 bytes: wide projections of one such method ran interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "precursor") -> SparkSession:
    """A local session for tests and benchmarks (UI off)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_recommended_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings the pipeline expects on an existing session."""
    for k, v in RECOMMENDED_CONF.items():
        spark.conf.set(k, v)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Uses the cluster's ``spark.checkpoint.dir``.  Only when it is unset and the
    session runs in local mode (tests) is a private folder created; on a cluster
    an unset checkpoint dir is an error, since a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if d is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3)")
        d = tempfile.mkdtemp(prefix="precursor-")
    sc.setCheckpointDir(d)
    return (sc.getCheckpointDir() or d).rstrip("/")
