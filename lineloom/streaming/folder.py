"""Structured Streaming over a folder of documents.  An extension: batch and stream share the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.text import stripped


def watch(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, ts timestamp", files: int = 100) -> DataFrame:
    """New Parquet files of ``folder`` as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def content_by_window(documents: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Content and gibberish lines by event-time window, late documents within ``late`` counted."""
    rows = documents.withWatermark("ts", late).select("ts", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", stripped(F.col("line"))).filter(L.is_content(F.col("line")))
    return rows.groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("content_lines"), F.sum(L.is_gibberish(F.col("line")).cast("int")).alias("gibberish_lines"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events at most ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
