"""File and topic streams: ingest, on-change runs, fan-out, enrichment and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weirgate.operators.events import enrich_events, reshape_events
from weirgate.sources.readers import decode_json, kafka_options
from weirgate.sources.writers import is_folder


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Stream of the files in a folder, or of one file."""
    reader = spark.readStream.format(file_format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if is_folder(spark, path):
        return reader.load(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).load(folder)


def topic_stream(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType, max_offsets: int | None = None
) -> DataFrame:
    """Decoded messages of a topic from the earliest offset; needs the spark-sql-kafka module."""
    reader = spark.readStream.format("kafka").options(**kafka_options(servers, topic))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    try:
        return decode_json(reader.load(), schema)
    except Exception as error:
        if "Failed to find data source" in str(error):
            raise RuntimeError("topics need the spark-sql-kafka module on the class path") from error
        raise


def run_available(writer) -> StreamingQuery:
    """Process everything present now in as many batches as the source limits ask for, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_events(
    raw: DataFrame, names: Mapping[str, str], path: str, checkpoint: str, processed_at: Column | None = None
):
    """Reshaped events appended as snappy parquet by processing date. Start it or pass it to run_available.

    The file sink commits each batch once, so a restart neither loses nor repeats events.
    """
    events = reshape_events(raw, names, processed_at)
    dated = events.withColumn("date", F.date_format("processed_at", "yyyy-MM-dd"))
    return (
        dated.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).option("compression", "snappy")
        .partitionBy("date")
    )


def enrich_stream(events: DataFrame, users: Callable[[], DataFrame], path: str, checkpoint: str):
    """Streamed events joined with the user table as it is in each batch; unknown users stay.

    Spark turns AQE off in streams. It is turned on again for the batch, so that a user with most of the
    batch's events is split when the table is too large to broadcast. Each batch has its own folder,
    replaced when the batch is retried.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
        enrich_events(batch, users()).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def on_change(
    spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, run: Callable[[DataFrame], None],
    file_format: str = "parquet",
) -> int:
    """Run ``run`` on the files that arrived since the last call with this checkpoint; number of runs made.

    The checkpoint remembers the files, so nothing happens when the input has not changed. A call that
    fails in ``run`` is made again on the same files.
    """
    runs = 0

    def process(batch: DataFrame, batch_id: int) -> None:
        nonlocal runs
        run(batch)
        runs += 1

    stream = file_stream(spark, path, schema, file_format)
    run_available(stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint))
    return runs


def fan_out_stream(stream: DataFrame, paths: Mapping[str, str], checkpoint: str):
    """Write each batch to several folders, one subfolder per batch, replaced when a batch is retried.

    The batch is computed once, for the first folder; the others are copied from the files there, so nothing is
    held in the memory of executors.
    """
    first, *others = paths.values()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{first}/batch_id={batch_id}")
        for path in others:
            done = batch.sparkSession.read.schema(batch.schema).parquet(f"{first}/batch_id={batch_id}")
            done.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def score_stream(
    events: DataFrame, model: Callable[[pd.DataFrame], pd.Series], inputs: list[str], path: str, checkpoint: str
):
    """Every event with the score that user code gives its inputs, in Arrow batches."""
    kept = T.StructType([f for f in events.schema.fields] + [T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=model(batch[inputs]))

    return (
        events.mapInPandas(score, kept).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
