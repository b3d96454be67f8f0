"""Responses as a stream: append-only answer files, each answer once, metrics over what has come in so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import parse_letter

SCHEMA = "condition string, branch string, mode string, id string, text string, at timestamp"
KEYS = ["condition", "branch", "mode", "id"]


def answers(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Parsed answers; a repeated (condition, branch, mode, id) within the watermark is dropped."""
    stream = spark.readStream.schema(SCHEMA).parquet(path).withWatermark("at", late)
    return stream.dropDuplicatesWithinWatermark(KEYS).withColumn("parsed", parse_letter(F.col("text")))


def write_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that has arrived and stop; the checkpoint makes a restart resume where it ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
