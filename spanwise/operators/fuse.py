"""Profiles fused with caption scores, and clips fitted to captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.config import N_BINS
from spanwise.operators.arrays import let


def choose_profile(heat: DataFrame, captions: DataFrame, durations: DataFrame, detect: str = "fused", weight: float = 0.4) -> DataFrame:
    """(item_id, duration, bin_seconds, vals, mode) of every item in ``durations``.

    ``heat`` has (item_id, bin_seconds, vals), ``captions`` (item_id, cap): the 100 shares of usable
    captions. With ``detect`` fused, both are blended bin by bin where both exist; with heatmap
    captions are not looked at, with captions the profile is not. Items left without a profile keep
    their row with null ``vals`` and mode ``rejected``.
    """
    if detect not in ("fused", "heatmap", "captions"):
        raise ValueError("detect is fused, heatmap or captions")
    rows = durations.select("item_id", "duration")
    none = F.lit(None).cast("array<double>")
    rows = rows.join(heat.select("item_id", "bin_seconds", "vals"), "item_id", "left") if detect != "captions" else rows.withColumn("bin_seconds", F.lit(None).cast("double")).withColumn("vals", none)
    rows = rows.join(captions.select("item_id", "cap"), "item_id", "left") if detect != "heatmap" else rows.withColumn("cap", none)
    has_heat, has_cap = F.col("vals").isNotNull(), F.col("cap").isNotNull()
    blend = F.zip_with("vals", "cap", lambda a, b: (1.0 - weight) * a + weight * b)
    value = F.when(has_heat & has_cap & F.lit(weight > 0), blend).when(has_heat, F.col("vals")).otherwise(F.col("cap"))
    mode = F.when(has_heat & has_cap, "fused").when(has_heat, "off").when(has_cap, "caption-only").otherwise("rejected")
    width = F.when(has_heat, F.col("bin_seconds")).otherwise(F.col("duration") / N_BINS)
    return rows.select("item_id", "duration", width.alias("bin_seconds"), value.alias("vals"), mode.alias("mode"))


def caption_arrays(envelope: DataFrame) -> DataFrame:
    """(item_id, cap): the long form of an envelope as one array per item."""
    by = envelope.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("m"))
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(N_BINS - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))
    return by.select("item_id", let(F.col("m"), dense).alias("cap"))


def adopt(clips: DataFrame, candidates: DataFrame, keep_length: bool = False) -> DataFrame:
    """Clips with the bounds of the best candidate they overlap, and its hook as ``label`` if they have none.

    Two clips may adopt one candidate. With ``keep_length`` (an explicit clip length) bounds stay.
    ``candidates`` has at most a dozen rows per item; ties go to the better rank.
    """
    key = ["item_id", "clip_index"]
    cand = candidates.select("item_id", F.col("start_sec").alias("cs"), F.col("end_sec").alias("ce"), "score", "rank", "hook_text")
    over = clips.join(cand, "item_id").filter("cs < end_sec AND ce > start_sec")
    best = over.groupBy(*key).agg(F.min(F.struct(F.negative("score").alias("order"), "rank", "cs", "ce", "hook_text")).alias("b"))
    rows = clips.join(best, key, "left")
    take = F.col("b").isNotNull() & F.lit(not keep_length)
    end = F.greatest(F.col("b.ce"), F.col("b.cs") + 30.0)
    hook = F.when(F.col("b").isNotNull(), utf8_truncate(F.coalesce(F.col("b.hook_text"), F.lit("")), 80)).otherwise("")
    return rows.withColumns({"centroid": F.when(take, (F.col("b.cs") + end) / 2.0).otherwise(F.col("centroid")), "start_sec": F.when(take, F.col("b.cs")).otherwise(F.col("start_sec")), "end_sec": F.when(take, end).otherwise(F.col("end_sec")), "label": F.when(F.coalesce("label", F.lit("")) == "", hook).otherwise(F.col("label"))}).drop("b")


def snap(clips: DataFrame, cues: DataFrame, slack: float = 3.0) -> DataFrame:
    """Clips whose bounds move to those of cues: the start to the earliest cue start within ``slack``
    before it, the end to the end of the last cue that holds it and ends within ``slack``.

    ``cues`` is clean (start_ms, end_ms). Cues meet a clip by item and minute of their start; a cue
    that holds a clip's end within the slack may have begun long before, so ends meet by the minute
    of the cue's end.
    """
    key = ["item_id", "clip_index"]
    minute = lambda c: F.floor(c / 60.0)
    near = lambda c, lo, hi: F.explode(F.array_distinct(F.array(minute(c + lo), minute(c + hi)))).alias("m")
    c = cues.select("item_id", "cue_idx", (F.col("start_ms") / 1000).alias("cs"), (F.col("end_ms") / 1000).alias("ce"))
    starts = clips.select(*key, "start_sec", near(F.col("start_sec"), -slack, 0.0)).join(c.withColumn("m", minute(F.col("cs"))), ["item_id", "m"]).filter((F.col("cs") <= F.col("start_sec")) & (F.col("start_sec") - F.col("cs") <= slack))
    ends = clips.select(*key, "end_sec", near(F.col("end_sec"), 0.0, slack)).join(c.withColumn("m", minute(F.col("ce"))), ["item_id", "m"]).filter((F.col("cs") <= F.col("end_sec")) & (F.col("ce") >= F.col("end_sec")) & (F.col("ce") - F.col("end_sec") <= slack))
    s = starts.groupBy(*key).agg(F.min("cs").alias("s"))
    e = ends.groupBy(*key).agg(F.max_by("ce", F.struct("cs", "cue_idx")).alias("e"))
    return clips.join(s, key, "left").join(e, key, "left").withColumn("start_sec", F.coalesce("s", "start_sec")).withColumn("end_sec", F.coalesce("e", "end_sec")).drop("s", "e")


def utf8_truncate(text: Column, most: int) -> Column:
    """At most ``most`` bytes; a multi-byte character that reaches the cut is dropped, even if it ends there."""
    view = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    cut = F.regexp_replace(F.substring(view, 1, most), "[\\xC0-\\xFF][\\x80-\\xBF]*$", "")
    return F.when(F.octet_length(text) > most, F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8")).otherwise(text)
