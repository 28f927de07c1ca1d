"""A session for streaming jobs with keyed state."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own on the same cluster, with the RocksDB state store.

    ``partitions`` is the number of state partitions, which a stream keeps for
    good once it has started; by default one for each core.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own
