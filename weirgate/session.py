"""Session defaults and the shared scratch folder used to cut lineage and to stage rewrites."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
INITIAL_PARTITIONS_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SHUFFLE_PARTITION_BYTES = 128 * 1024 * 1024


def with_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every job here relies on. Sizes (memory, partitions) stay with the cluster.

    AQE splits skewed join partitions and joins small ones, so the partition count only has to be large
    enough: see :func:`size_shuffles`.
    """
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at a path, from the file system; 0 when there is nothing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def shuffle_partitions(input_bytes: int) -> int:
    """Partitions that keep a shuffle of the whole input at about 128 MB each."""
    return -(-input_bytes // SHUFFLE_PARTITION_BYTES)


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Let shuffles start with enough partitions for an input of this size; never fewer than set already.

    AQE joins the small ones afterwards but does not split ordinary large ones, so the start has to be high.
    """
    current = int(spark.conf.get(INITIAL_PARTITIONS_CONF, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = shuffle_partitions(input_bytes)
    if wanted > current:
        spark.conf.set(INITIAL_PARTITIONS_CONF, str(wanted))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; on a cluster executors would each write to
    their own disk, so this raises.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _local_scratch() -> str:
    """One temporary folder for a local process, removed when it ends."""
    base = tempfile.mkdtemp(prefix="weirgate-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    This cuts lineage in iterative jobs, survives the loss of executors, and hands the planner the real
    file size, so a later join is broadcast only when it is known to be small. Fails if fewer or more rows
    are read than were written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    verify_rows(back, seen.get["rows"], path)
    return back


def verify_rows(df: DataFrame, rows: int, path: str) -> None:
    """Raise unless a folder holds as many rows as were written to it; reads file footers only."""
    found = df.count()
    if found != rows:
        raise RuntimeError(f"{path} holds {found} rows of {rows} written; is it shared by all executors?")
