"""Prediction scoring over files as they arrive (an extension: the batch operators do not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    schema = "id string, is_robust boolean, valid boolean, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def windowed_validity(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Valid and all predictions by event-time window, late rows within the watermark counted."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid")).select(F.col("window.start").alias("start"), "n", "n_valid")


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
