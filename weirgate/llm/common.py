"""Reading tables, cutting lineage, label splits and connected components shared by the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import threading
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirgate.session import scratch_path, verify_rows

#: While a job runs: its shuffle files go when it ends, and what goes to Python at once is bounded by bytes.
JOB_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give executors this package, for sessions that were started without it on their Python path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="weirgate-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = shutil.make_archive(os.path.join(folder, "weirgate"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def _job_settings(spark: SparkSession):
    """``JOB_CONF`` for one job, whose rows are in the shared folder when it ends."""
    before = {key: spark.conf.get(key, None) for key in JOB_CONF}
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to a new folder of the shared scratch folder and read back, and that folder."""
    spark, seen = df.sparkSession, Observation()
    path = scratch_path(spark, label)
    with _job_settings(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    verify_rows(back, seen.get["rows"], path)
    return back, path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class _Scopes(threading.local):
    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back, without leaving shuffle files behind."""
    back, path = _written(df, label)
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    return back


@contextmanager
def passing_tables(spark: SparkSession):
    """Within it, tables that are ``stored`` are deleted at the end; those stored by what it yields stay.

    For an operator that returns rows of a few of its tables: nothing it returns may read the others.
    """
    paths: list[str] = []
    _SCOPES.open.append(paths)
    try:
        yield lambda df, label: _written(df, label)[0]
    finally:
        _SCOPES.open.pop()
        for path in paths:
            _delete(spark, path)


class Newest:
    """Tables of a job that goes in rounds: each is written and verified, then the one before it is deleted."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.path = spark, label, None

    def keep(self, df: DataFrame) -> DataFrame:
        back, path = _written(df, self.label)
        self.drop()
        self.path = path
        return back

    def drop(self) -> None:
        """Delete the newest table as well, once nothing reads it any more."""
        if self.path:
            _delete(self.spark, self.path)
            self.path = None


_HELD: dict[tuple, object] = {}


def held(key: tuple, make):
    """What a Python worker keeps from task to task, made once; only one operator's at a time.

    Workers go from one operator to the next, so what the one before it has kept is dropped first.
    """
    if key not in _HELD:
        _HELD.clear()
        _give_back()
        _HELD[key] = make()
    return _HELD[key]


def _give_back() -> None:
    """Give freed memory back to the system; the allocators of Arrow and C would keep it for this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def label_split(doc_id: Column) -> Column:
    """0, 1 or 2 by the CRC-32 of the id as text; documents in part 1 are held out of every fit."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: ``(id, component)`` with the smallest id reachable.

    ``nodes`` has ``id`` (distinct), ``edges`` has ``a`` and ``b``, both ids of nodes. Each round gives every
    node the smallest label among its neighbours and then the label of that label, so the number of rounds
    grows with the logarithm of a component's diameter. Labels and edges are written every round; edges
    inside one label are dropped, so a large group of copies shrinks at once. Aggregates combine before the
    shuffle, which keeps a hub from filling one task. Nodes without edges are their own component.
    """
    links = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    # roots: a table old label -> new label that is composed over the rounds
    labels = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(
            both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select(F.col("a").alias("id"), "to"),
            "lowest",
        )
        if lowest.isEmpty():
            break
        # follow the pointers to their ends: they only go down, so this ends
        jumped = lowest
        while True:
            target = jumped.select(F.col("id").alias("to"), F.col("to").alias("next"))
            further = stored(
                jumped.join(target, "to", "left").select(
                    "id", F.coalesce("next", "to").alias("to"), (F.col("next") < F.col("to")).alias("moved")
                ),
                "jumped",
            )
            moved = not further.where("moved").isEmpty()
            jumped = further.select("id", "to")
            if not moved:
                break
        if labels is None:
            labels = jumped
        else:
            step = jumped.select(F.col("id").alias("to"), F.col("to").alias("next"))
            labels = stored(labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "labels")
        at_a = jumped.select(F.col("id").alias("a"), F.col("to").alias("ra"))
        at_b = jumped.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        links = stored(
            links.join(at_a, "a")
            .join(at_b, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
    if labels is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(labels, "id", "left").select("id", F.coalesce("to", "id").alias("component"))
