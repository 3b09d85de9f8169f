"""Info JSON as videos, chapters and profiles; what is no valid record is told apart with a reason."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanwise.config import N_BINS
from spanwise.operators.arrays import once

_NUMBER = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def lenient_number(raw: Column, default: float = 0.0) -> Column:
    """A number, or the number a text begins with, else the default."""
    return F.coalesce(F.regexp_extract(raw, _NUMBER, 0).try_cast("double"), F.lit(default))


def _member(v: str, name: str) -> Column:
    """A member as text: strings as they are, null and absent as "", others as JSON."""
    value = F.try_variant_get(v, f"$['{name}']", "string")
    return F.coalesce(value, F.lit(""))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def parse(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, reason, video_id, title, channel, channel_url, channel_handle, follower_count, url,
    duration, is_live, language, chapters, vals, bin_seconds) of every row.

    ``reason`` is null for a valid record; else why it is none: ``malformed`` (null, empty, not JSON
    or no object), ``no id`` or ``profile size`` (a non-empty heatmap that has not 100 elements).
    Absent, null, empty and non-array heatmaps are no profile (null ``vals``), which is valid.
    Numbers may be texts; members of another type count as absent.
    """
    rows = once(df.select(F.col(id_col), F.try_parse_json(F.col(body_col)).alias("v")), "v")
    rows = rows.withColumn("v", F.when(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), F.col("v")))
    part = lambda name: F.try_variant_get("v", f"$['{name}']", "variant")
    rows = rows.select(id_col, "v", F.try_variant_get("v", "$.heatmap", "array<variant>").alias("heat"), F.try_variant_get("v", "$.chapters", "array<variant>").alias("chap"), part("uploader_url").isNotNull().alias("has_uploader_url"), _kind(part("id")).alias("id_kind"))
    size = F.coalesce(F.size("heat"), F.lit(0))
    size = F.when(F.col("heat").isNull(), 0).otherwise(size)
    reason = F.when(F.col("v").isNull(), "malformed").when(F.col("id_kind").isin("ABSENT", "VOID"), "no id").when((size > 0) & (size != N_BINS), "profile size")
    field = lambda x, name: lenient_number(F.try_variant_get(x, f"$.{name}", "string"))
    duration = lenient_number(_member("v", "duration"))
    vals = F.when(size == N_BINS, F.transform("heat", lambda x: field(x, "value")))
    first = F.get("heat", 0)
    width = F.when(size == N_BINS, field(first, "end_time") - field(first, "start_time"))
    live_status = _member("v", "live_status")
    url = F.when(F.col("has_uploader_url"), _member("v", "uploader_url")).otherwise(_member("v", "channel_url"))
    chapters = F.transform("chap", lambda x: F.struct(field(x, "start_time").alias("start_sec"), field(x, "end_time").alias("end_sec"), F.coalesce(F.try_variant_get(x, "$.title", "string"), F.lit("")).alias("title")))
    out = rows.select(
        id_col,
        reason.alias("reason"),
        _member("v", "id").alias("video_id"),
        _member("v", "title").alias("title"),
        _member("v", "channel").alias("channel"),
        url.alias("channel_url"),
        _member("v", "uploader_id").alias("channel_handle"),
        lenient_number(_member("v", "channel_follower_count")).cast("long").alias("follower_count"),
        _member("v", "webpage_url").alias("url"),
        duration.alias("duration"),
        (F.coalesce(F.try_variant_get("v", "$.is_live", "string") == "true", F.lit(False)) | live_status.isin("is_live", "is_upcoming", "post_live")).alias("is_live"),
        F.when(_member("v", "language") != "", _member("v", "language")).otherwise(_member("v", "original_language")).alias("language"),
        F.coalesce(chapters, F.array().cast("array<struct<start_sec: double, end_sec: double, title: string>>")).alias("chapters"),
        vals.alias("vals"),
        F.when(width > 0, width).when((size == N_BINS) & (duration > 0), duration / N_BINS).otherwise(width).alias("bin_seconds"),
    )
    return once(out, *(c for c in out.columns if c != id_col))


def profiles(parsed: DataFrame, id_col: str) -> DataFrame:
    """Profiles of valid records, item_id being the record's id as text."""
    return parsed.filter("reason IS NULL AND vals IS NOT NULL").select(F.col(id_col).cast("string").alias("item_id"), "duration", "bin_seconds", "vals")


def chapter_rows(parsed: DataFrame, id_col: str) -> DataFrame:
    """(item_id, chapter_idx, start_sec, end_sec, title) of valid records."""
    rows = parsed.filter("reason IS NULL").select(F.col(id_col).cast("string").alias("item_id"), F.posexplode("chapters").alias("chapter_idx", "c"))
    return rows.select("item_id", "chapter_idx", "c.start_sec", "c.end_sec", "c.title")


#: What an error text means, first match first: all texts of one of the groups occur in it.
ERROR_HINTS = (
    ("cookies unreadable", (("Failed to decrypt with DPAPI",), ("app-bound",))),
    ("browser missing", (("could not find", "cookies database"),)),
    ("bot check", (("confirm you're not a bot",),)),
    ("sign-in", (("age",), ("Sign in to confirm",))),
)
#: What the origin answers to too many requests.
RATE_LIMITS = ("HTTP Error 429", "Too Many Requests")


def error_hint(text: Column) -> Column:
    """What to do about an error text, "" if nothing is known; null for null."""
    out = None
    for hint, groups in ERROR_HINTS:
        test = F.lit(False)
        for group in groups:
            every = F.lit(True)
            for part in group:
                every = every & text.contains(part)
            test = test | every
        out = F.when(test, hint) if out is None else out.when(test, hint)
    return F.when(text.isNotNull(), out.otherwise(""))


def rate_limited(text: Column) -> Column:
    """Whether an error text is that of a rate limit, after which it is worth trying again."""
    return F.coalesce(text.contains(RATE_LIMITS[0]) | text.contains(RATE_LIMITS[1]), F.lit(False))


def language_order(wanted: Column, preferred: Column) -> Column:
    """Languages in the order to try: the item's own first, unless the list begins with it; "en" if none."""
    listed = F.filter(F.transform(F.split(preferred, ","), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("en")))
    own = F.coalesce(wanted, F.lit("")) != ""
    return F.when(own & ~preferred.startswith(wanted), F.concat(F.array(wanted), listed)).otherwise(listed)


def first_available(available: DataFrame, order: DataFrame) -> DataFrame:
    """(item_id, lang, path): the first language of ``order`` (item_id, langs) that is available.

    If none of them is, the first available file by path. ``available`` is (item_id, lang, path).
    """
    both = available.join(order, "item_id", "left")
    rank = F.array_position("langs", F.col("lang"))
    rank = F.when(F.coalesce(rank, F.lit(0)) > 0, rank).otherwise(F.lit(2_147_483_647))
    best = both.groupBy("item_id").agg(F.min(F.struct(rank.alias("rank"), "path", "lang")).alias("b"))
    return best.select("item_id", "b.lang", "b.path")


def pick_asset(assets: DataFrame, kind: str) -> DataFrame:
    """(item_id, path) of the best banner or avatar of ``assets`` (item_id, path, w, h, hint, ord)."""
    ratio = F.col("w") / F.col("h")
    fits = F.col("hint") | ((ratio >= 1.5) & (F.col("h") >= 240) if kind == "banner" else (ratio > 0.7) & (ratio < 1.3))
    ok = assets.filter("w > 0 AND h > 0").filter(fits)
    return ok.groupBy("item_id").agg(F.max_by("path", F.struct("hint", F.col("w") * F.col("h"), F.negative("ord"))).alias("path"))


#: Thumbnails by preference.
THUMBNAILS = (".jpg", ".png", ".webp")


def pick_thumbnail(files: DataFrame) -> DataFrame:
    """(item_id, path) of the preferred thumbnail among ``files`` (item_id, path); ties go to the first path."""
    rank = F.array_position(F.array(*map(F.lit, THUMBNAILS)), F.regexp_extract("path", r"\.[A-Za-z0-9]+$", 0))
    return files.filter("item_id IS NOT NULL").withColumn("rank", rank).filter("rank > 0").groupBy("item_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def _jpeg_size(data: bytes) -> tuple[int, int]:
    """(width, height) in a JPEG's frame header, (0, 0) if it has none."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + max(2, size)
    return 0, 0


def channel_assets(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, path, w, h, ord) of the images ``chan*.jpg`` below ``folder``, item_id being the folder they
    are in. Files without a readable size are left out."""
    @F.pandas_udf("struct<w: int, h: int>")
    def size(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_jpeg_size(c) for c in content], columns=["w", "h"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "chan*.jpg").option("recursiveFileLookup", True).load(folder)
    own = files.select("path", size("content").alias("s")).select(F.element_at(F.split("path", "/"), -2).alias("item_id"), "path", "s.w", "s.h")
    by_path = W.Window.partitionBy("item_id").orderBy("path")
    return own.filter("w > 0 AND h > 0").withColumn("ord", F.row_number().over(by_path))
