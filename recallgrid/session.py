"""Session settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Runtime settings: adaptive plans, splitting of skewed join partitions even
# where that costs one more shuffle, and UTC so that timestamps compare equal
# across engines.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "recallgrid", cpus: int | None = None) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RECALLGRID_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    session = tune(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session on one machine may go without the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "/tmp/recallgrid-local"
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def spread(scan: DataFrame) -> DataFrame:
    """A file scan on all cores, where its files split into fewer tasks than that.

    Worth one shuffle of the raw rows for work that is heavy per row, such as
    cutting long texts.  A scan with enough splits is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
