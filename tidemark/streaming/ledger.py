"""Streams of events: windowed counts under a watermark, dedup, and late rows kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type; works on a stream and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_of_key(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def split_late(batch: DataFrame, closed_before: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the reference point decides by event time, and what is dropped stays countable."""
    late = F.coalesce(F.col("ts") < F.lit(closed_before).cast("timestamp_ntz"), F.lit(True))
    return batch.filter(~late), batch.filter(late)


def run_once(stream: DataFrame, folder: str, each) -> None:
    """Runs a stream over all that is there, `each` taking every micro-batch and its number; the folder's checkpoint keeps the cursor, so the next run goes on behind it."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an appending stream over all that is there into a parquet table and returns the table."""
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/cursor").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def keep_ledger(events: DataFrame, table, folder: str, key: str, at: str, member: str, buckets: int = 16) -> None:
    """A running ledger by key: first and last time, hits and the distinct members seen, each micro-batch an upsert into `table` (partitioned by `bucket`).

    Hits are kept by number of the micro-batch, so one that is repeated after a failure counts once; they are few, as a run is a batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        one = batch.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("hits"), F.sort_array(F.collect_set(member)).alias("members"))
        one = one.withColumn("batches", F.array(F.struct(F.lit(number).cast("long").alias("no"), F.col("hits").alias("n")))).drop("hits").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
        table.upsert(one, [key], {"first_seen": F.min, "last_seen": F.max, "members": union, "batches": union})

    run_once(events, folder, each)
