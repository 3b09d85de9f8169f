"""Plans, profiles and candidates as JSON, one document per item, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.config import DetectConfig, PlanConfig, RunConfig
from spanwise.functions.scalars import clip_filename


def manifest(videos: DataFrame, detected: DataFrame, clips: DataFrame, cfg: PlanConfig = PlanConfig(), detect: DetectConfig = DetectConfig(), run: RunConfig = RunConfig()) -> DataFrame:
    """(item_id, json): what was planned for each item, and how.

    ``videos`` has item_id, title, channel, url; clips need a label. ``heatmapPresent`` tells whether
    the profile came from a heatmap (mode not caption-only).
    """
    c = F.struct(F.col("clip_index").alias("index"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), (F.col("end_sec") - F.col("start_sec")).alias("duration"), F.col("peak_bin").alias("peakBin"), F.col("peak_score").alias("peakScore"), "centroid", "label", clip_filename(F.col("clip_index"), F.col("start_sec")).alias("file"), F.struct(F.lit(False).alias("start"), F.lit(False).alias("end")).alias("snapped"))
    per = clips.groupBy("item_id").agg(F.array_sort(F.collect_list(c)).alias("clips"))
    rows = detected.join(videos, "item_id").join(per, "item_id", "left")
    params = {"max_clips": cfg.max_clips, "format": run.format, "keep_intro": detect.keep_intro, "strict": cfg.strict, "clip_len": cfg.clip_len or 0.0, "min_gap": cfg.min_gap or 0.0}
    params |= {"source": run.source, "dry_run": run.dry_run, "full_download": run.full_download, "try_sections": run.try_sections}
    doc = F.struct(
        F.struct(F.col("item_id").alias("id"), "title", "channel", "duration", "url").alias("video"),
        F.struct(*[F.lit(v).alias(k) for k, v in params.items()]).alias("params"),
        (F.coalesce("mode", F.lit("off")) != "caption-only").alias("heatmapPresent") if "mode" in detected.columns else F.lit(True).alias("heatmapPresent"),
        F.struct(F.col("ratio").alias("maxOverMedian"), "flat").alias("quality"),
        F.coalesce("clips", F.array().cast(per.schema["clips"].dataType)).alias("clips"),
    )
    return rows.select("item_id", F.to_json(doc).alias("json"))


def heatmap_json(profiles: DataFrame) -> DataFrame:
    """(item_id, json) of the profiles that detection ran on."""
    bins = F.transform("vals", lambda v, i: F.struct((i * F.col("bin_seconds")).alias("start"), ((i + 1) * F.col("bin_seconds")).alias("end"), v.alias("value")))
    return profiles.select("item_id", F.to_json(F.struct(F.col("bin_seconds").alias("binSeconds"), bins.alias("bins"))).alias("json"))


def captions_json(candidates: DataFrame, items: DataFrame, weight: float) -> DataFrame:
    """(item_id, json) of each item's caption candidates, best first.

    ``items`` has item_id, lang and the mode that its profile was chosen with, a row for each item
    with usable captions; those without a candidate have an empty list.
    """
    c = F.struct("rank", "start_sec", "end_sec", "score", F.col("hook_text").alias("hook"), "four_beat", "cold_open_match", "signals")
    per = candidates.groupBy("item_id").agg(F.array_sort(F.collect_list(c)).alias("candidates"))
    rows = items.select("item_id", F.coalesce("lang", F.lit("")).alias("lang"), "mode").join(per, "item_id", "left")
    found = F.coalesce("candidates", F.array().cast(per.schema["candidates"].dataType)).alias("candidates")
    return rows.select("item_id", F.to_json(F.struct("lang", "mode", F.lit(weight).alias("weight"), found)).alias("json"))


def write_documents(docs: DataFrame, folder: str, column: str = "json", mode: str = "errorifexists") -> None:
    """Writes documents as JSON lines {item_id, document}, as many files as there are tasks.

    The document's name stays a column, so that the number of files does not grow with the items.
    ``mode`` is Spark's: what is there already is kept unless asked otherwise.
    """
    docs.select("item_id", F.col(column).alias("document")).write.mode(mode).json(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, document) of what :func:`write_documents` wrote."""
    return spark.read.schema("item_id string, document string").json(folder)
