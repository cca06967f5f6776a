"""Audit events appended to a lake table as they land, each event id once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hedgewise.plans import keyed_join

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """Event files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Folder of the commit records, beside the batches. Spark's readers pass over names that begin with an underscore.
COMMITS = "_commits"


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The batches that were written whole; none before the first."""
    try:
        return spark.read.schema("batch_id long").json(f"{path}/{COMMITS}").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def read_lake(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """The lake's events with ``event_date``: those of committed batches, so what a dead batch left is not seen."""
    whole = f"{schema}, batch_id long, event_date date"
    batches = committed(spark, path)
    if batches is None:
        return spark.createDataFrame([], whole).drop("batch_id")
    return keyed_join(spark.read.schema(whole).parquet(path), batches, ["batch_id"], "left_semi").drop("batch_id")


def unseen(batch: DataFrame, path: str) -> DataFrame:
    """A batch's events, each id once, without those that the lake holds under the same date.

    Only the dates that the batch touches are read. Events may come as late as they like, and a batch that is run again
    finds its own events and adds none.
    """
    events = batch.dropDuplicates(["event_id"]).withColumn("event_date", F.to_date("ts"))
    dates = events.select("event_date").distinct()
    held = read_lake(batch.sparkSession, path, ", ".join(f"`{name}` {kind}" for name, kind in batch.dtypes))
    held = held.select("event_id", "event_date").join(F.broadcast(dates), "event_date", "left_semi")  # a row per day
    return keyed_join(events, held, ["event_id", "event_date"], "left_anti")


def add_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch into a folder of its own, then its commit record. A batch that died in between is written anew."""
    spark = batch.sparkSession
    done = committed(spark, path)
    if done is not None and not done.where(F.col("batch_id") == batch_id).isEmpty():
        return
    unseen(batch, path).write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/batch_id={batch_id}")
    spark.range(0, 1, 1, 1).select(F.lit(batch_id).cast("long").alias("batch_id")).write.mode("append").json(f"{path}/{COMMITS}")


def append_to_lake(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each event id once to Parquet partitioned by batch and date, to be read by ``read_lake``. An event's date is its
    day in the session's time zone."""
    writer = events.writeStream.foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, path))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
