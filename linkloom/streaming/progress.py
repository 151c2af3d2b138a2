"""Streams: new pages as they are dropped into a folder, and counts of events as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkloom.operators import rows


def page_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Pages written as Parquet into a folder, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)


def links_per_source(pages: DataFrame) -> DataFrame:
    """Running numbers of links by source; the same expressions as in a batch."""
    found = rows.hyperlink_occurrences(pages).unionByName(rows.text_occurrences(pages))
    return found.groupBy("source").agg(F.count("*").alias("n_urls"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n_events", "total")
