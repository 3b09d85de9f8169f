"""Subtitles of clips: cues cut to a clip, chained, split into short lines, written as ASS text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanwise.config import SubtitleConfig
from spanwise.functions.scalars import ass_timestamp, escape_ass, words
from spanwise.operators.arrays import let


#: Seconds of the buckets in which cues and clips, or successive segments, meet.
MINUTE = 60.0
#: Longer cues than 2 ** LEVELS minutes meet clips at the last level, in as many buckets as they span.
LEVELS = 24


def trim_to_clips(cues: DataFrame, clips: DataFrame, offset: float = 0.0) -> DataFrame:
    """(item_id, clip_index, cue_idx, start_sec, end_sec, text): cues that overlap a clip, cut to it,
    in the clip's time. ``cues`` is clean (start_ms, end_ms); clips are a few minutes long at most.

    A cue that begins within a clip meets it by the minute of its start. One that begins before the
    clip and lasts into it meets the clip's start in buckets as wide as the cue is long (a power of
    two minutes), of which it touches at most two. So an equi-join finds each pair once, and a hot
    item's cues stay spread over its minutes.
    """
    c = cues.select("item_id", "cue_idx", (F.col("start_ms") / 1000).alias("cs"), (F.col("end_ms") / 1000).alias("ce"), "text")
    at = lambda x, level: F.floor(x / (MINUTE * F.pow(F.lit(2.0), level))).cast("long")
    key = lambda level, b: F.struct(level.cast("int").alias("level"), b.alias("b"))
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2((F.col("ce") - F.col("cs")) / MINUTE)))).cast("int")
    over = F.transform(F.sequence(at(F.col("cs"), level), at(F.col("ce"), level)), lambda b: key(level, b))
    keyed = c.select("*", F.explode(F.concat(F.array(key(F.lit(-1), at(F.col("cs"), F.lit(0)))), over)).alias("k"))
    own = clips.select("item_id", "clip_index", F.col("start_sec").alias("s"), F.col("end_sec").alias("e"))
    minutes = F.transform(F.sequence(at(F.col("s"), F.lit(0)), at(F.col("e"), F.lit(0))), lambda b: key(F.lit(-1), b))
    starts = F.array(*[key(F.lit(n), at(F.col("s"), F.lit(n))) for n in range(LEVELS + 1)])
    both = own.select("*", F.explode(F.concat(minutes, starts)).alias("k")).join(keyed, ["item_id", "k"])
    both = both.filter(F.when(F.col("k.level") < 0, (F.col("cs") >= F.col("s")) & (F.col("cs") < F.col("e"))).otherwise((F.col("cs") < F.col("s")) & (F.col("ce") > F.col("s"))))
    start = F.greatest("cs", "s") - F.col("s") + offset
    end = F.least("ce", "e") - F.col("s") + offset
    return both.select("item_id", "clip_index", "cue_idx", start.alias("start_sec"), end.alias("end_sec"), "text").filter("end_sec > start_sec")


def split_words(text: Column, start: Column, end: Column, cfg: SubtitleConfig = SubtitleConfig()) -> Column:
    """Array of (text, start_sec, end_sec): as few parts as the words per cue allow, of nearly equal
    word counts, sharing the time evenly; a part of more words than a line holds has two lines."""
    most, line = max(1, cfg.words_per_cue), max(1, cfg.words_per_line)
    none = F.array().cast("array<struct<text: string, start_sec: double, end_sec: double>>")

    def parts(w: Column) -> Column:
        n = F.size(w)
        count = F.ceil(n / most).cast("int")
        base, extra = F.floor(n / count).cast("int"), (n % count).cast("int")

        def part(i: Column) -> Column:
            take = base + F.when(i < extra, 1).otherwise(0)
            own = F.slice(w, i * base + F.least(i, extra) + 1, take)
            top = F.ceil(take / 2).cast("int")
            two = F.concat(F.array_join(F.slice(own, 1, top), " "), F.lit("\\N"), F.array_join(F.slice(own, top + 1, take), " "))
            return F.struct(F.when(take <= line, F.array_join(own, " ")).otherwise(two).alias("text"), (start + (end - start) * i / count).alias("start_sec"), (start + (end - start) * (i + 1) / count).alias("end_sec"))

        return F.when((n > 0) & (end > start), F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), part)).otherwise(none)

    return let(words(text), parts)


def split_cues(cues: DataFrame, keys: list[str], cfg: SubtitleConfig = SubtitleConfig()) -> DataFrame:
    """One row per part of every cue: the keys, part, start_sec, end_sec, text."""
    parts = cues.select(*keys, F.posexplode(split_words(F.col("text"), F.col("start_sec"), F.col("end_sec"), cfg)).alias("part", "p"))
    return parts.select(*keys, "part", "p.start_sec", "p.end_sec", "p.text")


def chain(segments: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Segments that end where the next begins if they overlap it; what has no length left is dropped.

    Segments are ordered within minutes of their group. Each minute also has a row for the first
    start of the next one that has segments, found from one short row per minute, so that a hot
    group's segments spread over many tasks.
    """
    minute = F.floor(F.col("start_sec") / MINUTE)
    rows = segments.withColumn("_minute", minute)
    heads = rows.groupBy(*group, "_minute").agg(F.min("start_sec").alias("start_sec"))
    before = heads.withColumn("_minute", F.lag("_minute").over(W.Window.partitionBy(*group).orderBy("_minute"))).filter("_minute IS NOT NULL")
    both = rows.withColumn("_own", F.lit(True)).unionByName(before, allowMissingColumns=True)
    w = W.Window.partitionBy(*group, "_minute").orderBy("start_sec", *order)
    cut = both.withColumn("end_sec", F.least("end_sec", F.coalesce(F.lead("start_sec").over(w), F.col("end_sec"))))
    return cut.filter("_own AND end_sec > start_sec").drop("_minute", "_own")


def ass_text(segments: DataFrame, group: list[str], cfg: SubtitleConfig = SubtitleConfig()) -> DataFrame:
    """(group, ass): one subtitle file per group that has segments; line breaks are kept."""
    head = "\n".join(
        [
            "﻿[Script Info]",
            "ScriptType: v4.00+",
            f"PlayResX: {cfg.width}",
            f"PlayResY: {cfg.height}",
            "",
            "[V4+ Styles]",
            "Format: Name, Fontname, Fontsize, PrimaryColour, OutlineColour, Bold, Alignment, MarginL, MarginR, MarginV",
            f"Style: Default,Arial,{cfg.font_size},&H00FFFFFF,&H00000000,-1,2,{cfg.margin_h},{cfg.margin_h},{cfg.margin_v}",
            "",
            "[Events]",
            "Format: Layer, Start, End, Style, Text",
            "",
        ]
    )
    shown = F.array_join(F.transform(F.split("text", r"\\N"), escape_ass), "\\N")
    line = F.concat(F.lit("Dialogue: 0,"), ass_timestamp(F.col("start_sec")), F.lit(","), ass_timestamp(F.col("end_sec")), F.lit(",Default,"), shown)
    rows = segments.select(*group, F.struct("start_sec", "end_sec", line.alias("line")).alias("x")).groupBy(*group).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select(*group, F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n")).alias("ass"))
