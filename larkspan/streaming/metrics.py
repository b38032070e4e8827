"""Metrics over streams of operator events.

Events: ts, user_id, event_type, value.  A stream is aggregated as it comes, late
events included up to the watermark of a query in append mode; in complete mode,
which the functions below leave to the caller, no state is dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources.shared import shared_folder

#: How late an event may come in append mode.
LATE = "1 day"


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream of its files, ``files`` a batch; ts becomes an event time in UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))).withWatermark("ts", LATE)


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total in cents) of windows that follow each other."""
    g = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def latest_states(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type, value) of each user's last event; ties go to the greater event_id."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("x")
    return events.groupBy("user_id").agg(last).select("user_id", "x.*")


def finished(stream: DataFrame, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """What the stream has come to when everything that is there now has been read: a table in ``folder``, by default a new shared one.

    Started again with the folder it goes on from its checkpoint.  Each batch is
    written under its own number, so a batch that runs again after a failure
    replaces itself; the newest one there is read.
    """
    spark = stream.sparkSession
    home = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{home}/rows/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{home}/rows")
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == (-1 if newest is None else newest)).drop("batch")
