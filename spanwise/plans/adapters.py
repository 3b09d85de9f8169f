"""The given tables as items, profiles, cues and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.operators.captions import clean_cues
from spanwise.operators.profile import event_profiles
from spanwise.session import table
from spanwise.sources import info_json


def user_profiles(spark: SparkSession, d: str) -> DataFrame:
    return event_profiles(table(spark, d, "events"), "user_id")


def type_profiles(spark: SparkSession, d: str) -> DataFrame:
    return event_profiles(table(spark, d, "events"), "event_type", "value")


def parsed_info(spark: SparkSession, d: str) -> DataFrame:
    return info_json.parse(table(spark, d, "info_json"), "record_id", "body")


def caption_cues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "caption_cues").select(F.col("caption_id").cast("string").alias("item_id"), "cue_idx", "start_sec", "end_sec", "text")


def cue_durations(cues: DataFrame) -> DataFrame:
    """(item_id, duration): an item of cues lasts until its last usable cue ends."""
    return clean_cues(cues).groupBy("item_id").agg((F.max("end_ms") / 1000).alias("duration"))


def caption_heat(spark: SparkSession, d: str) -> DataFrame:
    """Heat profiles of captioned videos, by caption_id, where Info JSON has them."""
    heat = parsed_info(spark, d).filter("reason IS NULL AND vals IS NOT NULL AND video_id != ''").groupBy("video_id").agg(F.min_by(F.struct("bin_seconds", "vals"), "record_id").alias("p"))
    docs = table(spark, d, "caption_docs").select(F.col("caption_id").cast("string").alias("item_id"), "video_id").distinct()
    return docs.join(heat, "video_id").select("item_id", "p.bin_seconds", "p.vals")


def document_cues(spark: SparkSession, d: str) -> DataFrame:
    """Documents as cues of eight words every four seconds."""
    words = F.filter(F.split("text", r"[ \n\r\t]+"), lambda w: w != "")
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("item_id"), words.alias("w"))
    chunks = rows.filter(F.size("w") > 0).select("item_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 8).cast("int"))).alias("cue_idx"))
    start = F.col("cue_idx") * 4.0
    return chunks.select("item_id", "cue_idx", start.alias("start_sec"), (start + 3.5).alias("end_sec"), F.array_join(F.slice("w", F.col("cue_idx") * 8 + 1, 8), " ").alias("text"))
