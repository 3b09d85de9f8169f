"""Listing of runs from two places: those remembered, and those found on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_listing(jobs: DataFrame, disk: DataFrame) -> DataFrame:
    """(id, source, modified) of remembered ``jobs`` (id, modified) and of ``disk`` runs not among them.

    A run is the same with and without the prefix ``web-``. Newest first is up to the reader.
    """
    plain = F.regexp_replace("id", "^web-", "")
    seen = jobs.select(plain.alias("plain")).distinct()
    rest = disk.withColumn("plain", plain).join(seen, "plain", "left_anti")
    row = lambda df, source: df.select("id", F.lit(source).alias("source"), "modified")
    return row(jobs, "memory").unionByName(row(rest, "disk"))


def manifests(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """(path, modified, url, title, clips) of the manifest files in a folder; unreadable ones are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest*.json").text(folder).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    v = files.withColumn("v", F.try_parse_json("value")).filter("v IS NOT NULL")
    text = lambda p: F.coalesce(F.try_variant_get("v", p, "string"), F.lit(""))
    return v.select(F.col("file_path").alias("path"), F.col("file_modification_time").alias("modified"), text("$.video.url").alias("url"), text("$.video.title").alias("title"), F.coalesce(F.size(F.try_variant_get("v", "$.clips", "array<variant>")), F.lit(0)).alias("clips"))
