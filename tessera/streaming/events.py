"""Structured Streaming over the event feed. Timestamps are cast to instants, since watermarks need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.sources.committed import CommittedTable


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The feed as a stream of its Parquet files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/event[s].parquet"  # a pattern, so that a single file may be the source as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and distinct-free sums by class and window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events at most `gap` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """First row of each event_id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upserts(events: DataFrame, table: CommittedTable, name: str, late: str | None = None, time: str = "ts") -> DataStreamWriter:
    """D8 on a stream: each batch is one commit of the table, under the stream's name, so that a replayed batch adds nothing. Of a key the row
    with the largest ordinal stays, however late another comes; rows later than `late`, if given, are dropped."""
    rows = events.withWatermark(time, late).dropDuplicatesWithinWatermark([*table.keys, table.ordinal]) if late else events
    return rows.writeStream.foreachBatch(lambda df, batch: table.upsert(df, (name, batch)) and None)
