"""Profile fixture files: ``{fixtures: [{id, lenSec, binMs, scale, scores[100]}]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles (item_id, duration, bin_seconds, vals) of fixture files; a value is its score over the scale."""
    schema = "fixtures array<struct<id: string, lenSec: double, binMs: double, scale: double, scores: array<double>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("fixtures"))
    return rows.select(F.col("id").alias("item_id"), F.col("lenSec").alias("duration"), (F.col("binMs") / 1000).alias("bin_seconds"), F.transform("scores", lambda s: s / F.col("scale")).alias("vals"))
