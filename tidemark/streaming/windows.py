"""The same analytics over streams of artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import timex


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files of a folder as they come."""
    return spark.readStream.schema(schema).parquet(path)


def dated(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """Artifacts with an event time and a watermark on it."""
    return df.withColumn("at", timex.at(F.col("timestamp"))).withWatermark("at", late)


def deduplicated(df: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Each artifact once within the watermark."""
    return df.dropDuplicatesWithinWatermark([key])


def session_bursts(df: DataFrame, keys: Sequence[str] = ("party",), gap: str = "45 minutes", least: int = 3) -> DataFrame:
    """Bursts as sessions; a gap of exactly that length ends one here, as session windows are open at their end."""
    out = df.groupBy(*keys, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= least).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def counts(df: DataFrame, window: str = "1 hour") -> DataFrame:
    out = df.groupBy(F.window("at", window).alias("w"), "category").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "category", "n")
