"""An extension: profiles of tables that still grow, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling window and key; rows later than the watermark are left out of a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    w = F.window(time, window)
    return rows.groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total")


def run_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, time: str, key: str, value: str) -> None:
    """Process what is new in a folder of Parquet files since the last call, then stop."""
    stream = spark.readStream.schema(schema).parquet(source)
    q = windowed_counts(stream, time, key, value).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
