"""Continuous curation of arriving files: cleaning, exact duplicates within a watermark, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions import text as X


def arriving(spark: SparkSession, path: str, schema: str, at_once: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)


def curated(stream: DataFrame, time: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """Cleaned records, each key once within the watermark."""
    text, _ = X.clean_text("text")
    rows = stream.filter(F.col("text").isNotNull()).withColumn("text", text).withColumn("key", X.dedup_key("text")).filter("key <> ''")
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["key"])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def run_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived and ends; a restart goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
