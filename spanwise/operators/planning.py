"""Clips around hot regions, and what follows from them: sections to fetch and their time frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.config import PlanConfig
from spanwise.functions.scalars import fixed, hms, pad, zero_pad_to
from spanwise.operators.greedy import greedy_top_k
from spanwise.operators.profile import REGION


def auto_clip_len(bin_seconds: Column) -> Column:
    return F.least(F.greatest(1.5 * bin_seconds, F.lit(40.0)), F.lit(90.0))


def auto_min_gap(bin_seconds: Column) -> Column:
    return F.greatest(F.lit(90.0), 2.0 * bin_seconds)


def ranked_regions() -> Column:
    """Regions best first: by peak, ties by start bin."""
    key = lambda r: F.struct(F.negative(r["peak_score"]).alias("p"), r["start_bin"].alias("b"), r.alias("r"))
    return F.transform(F.array_sort(F.transform("regions", key)), lambda k: k["r"])


def select_regions(detected: DataFrame, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Adds ``kept``: the regions clips are made of.

    Of an item no longer than three minutes the best region alone; of others the best ones whose
    centres keep the least gap, as many as clips are wanted.
    """
    gap = F.lit(float(cfg.min_gap)) if cfg.min_gap is not None else auto_min_gap(F.col("bin_seconds"))
    long = greedy_top_k(ranked_regions(), "centroid", gap, cfg.max_clips, f"array<{REGION}>")
    return detected.withColumn("kept", F.when(F.col("duration") <= cfg.short_sec, F.slice(ranked_regions(), 1, 1)).otherwise(long))


def window(detected: DataFrame, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """(item_id, clip_index, start_sec, end_sec, peak_score, peak_bin, centroid): clips by start.

    A clip is centred on its region and shifted, not cut, where it would leave the item.
    """
    length = F.lit(float(cfg.clip_len)) if cfg.clip_len is not None else auto_clip_len(F.col("bin_seconds"))
    short = F.col("duration") <= cfg.short_sec

    def clip(r: Column) -> Column:
        s0, e0 = r["centroid"] - length / 2.0, r["centroid"] + length / 2.0
        e1 = F.when(s0 < 0, e0 + (F.lit(0.0) - s0)).otherwise(e0)
        s1 = F.greatest(s0, F.lit(0.0))
        s2 = F.when(e1 > F.col("duration"), s1 - (e1 - F.col("duration"))).otherwise(s1)
        start = F.when(short, 0.0).otherwise(F.greatest(s2, F.lit(0.0)))
        end = F.when(short, F.col("duration")).otherwise(F.least(e1, F.col("duration")))
        return F.struct(start.alias("start_sec"), r["peak_bin"].alias("peak_bin"), end.alias("end_sec"), r["peak_score"].alias("peak_score"), r["centroid"].alias("centroid"))

    clips = F.array_sort(F.transform("kept", clip))
    return detected.select("item_id", F.posexplode(clips).alias("at", "c")).select("item_id", (F.col("at") + 1).alias("clip_index"), "c.start_sec", "c.end_sec", "c.peak_score", "c.peak_bin", "c.centroid")


def plan(detected: DataFrame, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Clips of detected profiles. Items without regions have none; with ``strict`` flat items have none."""
    kept = detected.filter("NOT coalesce(flat, true)") if cfg.strict else detected
    return window(select_regions(kept, cfg), cfg)


def label(clips: DataFrame, chapters: DataFrame) -> DataFrame:
    """Adds ``label``: the title of the first chapter that holds the clip's centre, or "".

    ``chapters`` has (item_id, chapter_idx, start_sec, end_sec, title). An equi-join on the item with
    the point-in-interval test beside it; of several chapters the lowest index wins.
    """
    key = ["item_id", "clip_index"]
    hit = clips.select(*key, "centroid").join(chapters, "item_id").filter("start_sec <= centroid AND centroid < end_sec")
    first = hit.groupBy(*key).agg(F.min(F.struct("chapter_idx", F.coalesce("title", F.lit("")).alias("title"))).alias("c"))
    return clips.join(first.select(*key, F.col("c.title").alias("label")), key, "left").withColumn("label", F.coalesce("label", F.lit("")))


def strategy(clips: DataFrame, durations: DataFrame, try_sections: bool = True, full_download: bool = False) -> DataFrame:
    """(item_id, clips, clip_sec, strategy): whether an item is fetched whole or per clip.

    Per clip if asked for, and the item is longer than 15 minutes with two clips or more that make
    up less than 30 % of it.
    """
    per = clips.groupBy("item_id").agg(F.count("*").alias("clips"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("clip_sec"))
    both = per.join(durations.select("item_id", "duration"), "item_id")
    some = (F.col("clips") >= 2) & (F.col("duration") > 900) & (F.col("clip_sec") < 0.30 * F.col("duration"))
    choice = F.when(some, "per_clip").otherwise("full") if try_sections and not full_download else F.lit("full")
    return both.select("item_id", "clips", "clip_sec", choice.alias("strategy"))


def sections(clips: DataFrame, durations: DataFrame, pad: float = 10.0) -> DataFrame:
    """(item_id, clip_index, src_start, src_end, stem): what to fetch around each clip."""
    rows = clips.join(durations.select("item_id", "duration"), "item_id")
    most = F.max("clip_index").over(_by_item())
    end = F.when(F.col("duration") > 0, F.least(F.col("end_sec") + pad, F.col("duration"))).otherwise(F.col("end_sec") + pad)
    stem = zero_pad_to(F.col("clip_index"), F.length(most.cast("string")))
    return rows.select("item_id", "clip_index", F.greatest(F.col("start_sec") - pad, F.lit(0.0)).alias("src_start"), end.alias("src_end"), stem.alias("stem"))


def _by_item():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("item_id")


def translate(clips: DataFrame, sections_: DataFrame) -> DataFrame:
    """Clip times within the fetched file: relative to the first section that holds the clip.

    Clips no section holds keep their times.
    """
    key = ["item_id", "clip_index"]
    s = sections_.select("item_id", F.col("clip_index").alias("sec"), "src_start", "src_end")
    held = clips.select(*key, "start_sec", "end_sec").join(s, "item_id").filter("src_start <= start_sec AND end_sec <= src_end").groupBy(*key).agg(F.min_by("src_start", "sec").alias("origin"))
    moved = clips.join(held, key, "left").withColumn("origin", F.coalesce("origin", F.lit(0.0)))
    return moved.select(*key, (F.col("start_sec") - F.col("origin")).alias("start_sec"), (F.col("end_sec") - F.col("origin")).alias("end_sec"))


#: Bytes that a file of each kind has at least.
LEAST_BYTES = {"download": 65_536, "input": 65_536, "cut": 32_768, "card": 4_096}


def plausible(size: Column, seconds: Column, kind: str = "download") -> Column:
    """Whether a file of ``size`` bytes can be what it should; a download also must have 50,000 bytes for
    each of the ``seconds`` expected of it, if any. Null sizes (no such file) are not plausible."""
    enough = size >= LEAST_BYTES[kind]
    if kind == "download":
        enough = enough & ((F.coalesce(seconds, F.lit(0.0)) <= 0) | (size / seconds >= 50_000))
    return F.coalesce(enough, F.lit(False))


def plan_lines(clips: DataFrame) -> DataFrame:
    """(item_id, clip_index, line): clips as the lines of a table of fixed columns."""
    time = lambda c: pad(hms(F.col(c)), 10)
    line = F.concat_ws("  ", pad(F.col("clip_index").cast("string"), 3), time("start_sec"), time("end_sec"), pad(fixed(F.col("end_sec") - F.col("start_sec"), 1), 6), pad(fixed(F.col("peak_score"), 3), 6), pad(F.col("peak_bin").cast("string"), 5), "label")
    return clips.select("item_id", "clip_index", line.alias("line"))


def candidate_lines(candidates: DataFrame) -> DataFrame:
    """(item_id, rank, line): caption candidates as the lines of a table; hooks are cut at 72 bytes."""
    yes = lambda c: pad(F.when(F.col(c), "yes").otherwise("-"), 4)
    hook = F.make_valid_utf8(F.substring(F.encode(F.coalesce("hook_text", F.lit("")), "UTF-8"), 1, 72).cast("string"))
    line = F.concat_ws("  ", pad(F.col("rank").cast("string"), 3), pad(hms(F.col("start_sec")), 10), pad(hms(F.col("end_sec")), 10), pad(fixed(F.col("score"), 1), 7), yes("four_beat"), yes("cold_open_match"), hook)
    return candidates.select("item_id", "rank", line.alias("line"))


def run_results(clips: DataFrame, out_dir: str | None = None) -> DataFrame:
    """(item_id, json): how many clips each item has, with where they are or that none were made."""
    tail = F.lit(True).alias("dryRun") if out_dir is None else F.lit(out_dir).alias("out")
    return clips.groupBy("item_id").agg(F.count("*").alias("clips")).select("item_id", F.to_json(F.struct("clips", tail)).alias("json"))
