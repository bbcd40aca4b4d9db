"""Structured Streaming over the events table: counts of each kind by hour, each event once. An addition of this library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.shared import shared_dir


def hourly_counts(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """A streaming aggregation; late events count up to the watermark, repeated ids within it count once."""
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def run_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drains the events table through the stream and returns what stands in the sink.

    The watermark lags by the time that the table spans, so no event is late in whatever order the files come.
    """
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    schema = table.schema
    ts = F.col("ts").cast("timestamp").cast("long")
    span = table.agg((F.max(ts) - F.min(ts)).alias("s")).first().s or 0
    here = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = hourly_counts(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*"), f"{span + 3600} seconds")
    query = (
        stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{here}/state")
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{here}/out")).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{here}/out")
