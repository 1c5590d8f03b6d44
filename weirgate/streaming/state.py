"""A session for stateful streams: state kept in RocksDB, partitions sized for the stream."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BYTES_PER_PARTITION = 32 * 1024 * 1024


def state_partitions(spark: SparkSession, input_bytes: int | None = None) -> int:
    """Partitions for the state of a stream: one per core, more for large batches.

    A stream keeps the number it first ran with, so it is chosen for the stream and not left to the
    setting for batch queries.
    """
    wanted = -(-(input_bytes or 0) // BYTES_PER_PARTITION)
    return max(spark.sparkContext.defaultParallelism, wanted)


def stateful_session(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """A sibling of ``spark`` for one stateful stream; the settings of ``spark`` stay as they are.

    RocksDB keeps state outside the heap and on disk, and uploads only its changes with each batch.
    """
    session = spark.newSession()
    settings = {
        "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
        "spark.sql.shuffle.partitions": str(state_partitions(spark, input_bytes)),
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    for key, value in settings.items():
        session.conf.set(key, value)
    return session
