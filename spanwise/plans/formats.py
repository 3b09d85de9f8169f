"""Queries of the formats of single values, texts and documents, on columns of the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.config import PlanConfig
from spanwise.functions import scalars
from spanwise.operators import planning, profile
from spanwise.plans import profiles
from spanwise.plans.adapters import parsed_info, user_profiles
from spanwise.session import table
from spanwise.sources import info_json

_ERRORS = ("ERROR: Failed to decrypt with DPAPI", "could not find chrome cookies database", "confirm you're not a bot", "Sign in to confirm your birthday", "HTTP Error 429", "no space left", "could not find file", "429 Too Many Requests, page 2")
_EXTENSIONS = (".jpg", ".png", ".webp", ".gif")
_NAMES = ("a.HTML", "run.log", "x.webm", "../y.mp4", "z.tar.GZ", "", "noext", "a\\b.txt", "pic.jpeg", "d/e.svg")


def _pick(n: str, values: tuple[str, ...]):  # noqa: ANN202
    """One of some texts, by a number modulo how many there are."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.col(n), F.lit(len(values))).cast("int"))


def text_formats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "caption_cues").filter("text IS NOT NULL").select("text").distinct()
    return c.select("text", scalars.escape_ass(F.col("text")).alias("ass"), scalars.escape_path(F.col("text")).alias("path"), scalars.drawtext_escape(F.col("text")).alias("drawtext"), F.size(scalars.words(F.col("text"))).alias("words"))


def number_formats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return c.select("c_custkey", scalars.fixed(F.col("x"), 3).alias("fixed"), scalars.compact(F.col("x") * 1000 / 7).alias("compact"), scalars.compact(F.col("x") / 1e9).alias("small"), scalars.zero_pad(F.col("c_custkey"), 5).alias("padded"))


def negative_times(spark: SparkSession, d: str) -> DataFrame:
    """Subtitle times of account balances, which may be negative."""
    return table(spark, d, "customer").select("c_custkey", scalars.ass_timestamp(F.col("c_acctbal")).alias("ass"))


def names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", _pick("o_orderkey", _NAMES).alias("name"), _pick("o_orderkey", ("blur", "crop", "orig", "other")).alias("kind"))
    return rows.select("o_orderkey", "name", scalars.mime(F.col("name")).alias("mime"), scalars.safe_id(F.col("name")).alias("safe"), scalars.format_name(F.col("kind")).alias("format"))


def job_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts")).filter("ts IS NOT NULL")
    named = e.select("event_id", "ts", F.concat(F.when(F.col("event_id") % 3 == 0, "cli-").otherwise("web-"), scalars.job_id(F.col("ts"))).alias("id"))
    began = scalars.job_time(F.col("id"), F.col("ts") + F.expr("INTERVAL 1 DAY"), F.col("ts") + F.expr("INTERVAL 2 DAYS"))
    return named.select("event_id", "id", F.date_format(began, "yyyy-MM-dd HH:mm:ss.SSS").alias("began"))


def error_hints(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", _pick("o_orderkey", _ERRORS).alias("text"))
    return rows.select("o_orderkey", info_json.error_hint(F.col("text")).alias("hint"), info_json.rate_limited(F.col("text")).alias("again"))


def thumbnails(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 3).alias("item_id"), F.concat(F.lit("thumb"), F.col("p_partkey").cast("string"), _pick("p_partkey", _EXTENSIONS)).alias("path"))
    return info_json.pick_thumbnail(files)


def assets(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 5).alias("item_id"), F.col("p_name").alias("path"), (F.col("p_size") * 40).alias("w"), (F.pmod(F.col("p_partkey"), F.lit(7)) * 200).cast("int").alias("h"), (F.col("p_partkey") % 11 == 0).alias("hint"), F.col("p_partkey").alias("ord"))
    kind = lambda k: info_json.pick_asset(files, k).withColumn("kind", F.lit(k))
    return kind("banner").unionByName(kind("avatar"))


def plausible_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("size"), (F.col("o_orderkey") % 5 - 1).cast("double").alias("sec"))
    return rows.select("o_orderkey", *[planning.plausible(F.col("size"), F.col("sec"), k).alias(k) for k in planning.LEAST_BYTES])


def run_arguments(spark: SparkSession, d: str) -> DataFrame:
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    params = F.to_json(F.struct(F.when(key % 2 == 0, key % 10).alias("max_clips"), (key % 3 * 12.5).alias("clip_len"), _pick("o_orderkey", ("916blur", "", "orig")).alias("format"), _pick("o_orderkey", ("none", "edge")).alias("cookies"), _pick("o_orderkey", ("fused", "captions", "heatmap")).alias("detect"), (key % 7 == 0).alias("dry_run"), F.when(key % 4 > 0, key % 4 == 1).alias("dump_heatmap"), (key % 5 == 0).alias("strict")))
    return o.select("o_orderkey", F.array_join(scalars.run_arguments(F.try_parse_json(params)), " ").alias("arguments"))


def log_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select("p_partkey", F.struct(scalars.log_chunk(F.col("p_name"), F.col("p_partkey") % 40).alias("c")).alias("x"))
    return c.select("p_partkey", "x.c.from", "x.c.next", "x.c.chunk")


def info_json_fields(spark: SparkSession, d: str) -> DataFrame:
    return parsed_info(spark, d).filter("reason IS NULL").select("record_id", "channel", "channel_url", "channel_handle", "url", "language", F.round("bin_seconds", 6).alias("bin_seconds"))


def clips_strict(spark: SparkSession, d: str) -> DataFrame:
    det = profile.detect(user_profiles(spark, d))
    return planning.plan(det, PlanConfig(strict=True)).select("item_id", "clip_index", F.round("start_sec", 6).alias("start_sec"))


def clip_lines(spark: SparkSession, d: str) -> DataFrame:
    return planning.plan_lines(profiles._labelled(spark, d))


def run_results(spark: SparkSession, d: str) -> DataFrame:
    clips = profiles._labelled(spark, d)
    return planning.run_results(clips).unionByName(planning.run_results(clips, "out/x"))


def manifest_fields(spark: SparkSession, d: str) -> DataFrame:
    """What manifest_json holds, read back."""
    clip = "struct<index: int, file: string, label: string, snapped: struct<start: boolean>>"
    kind = f"struct<video: struct<id: string, title: string, url: string>, params: struct<max_clips: int, format: string, keep_intro: boolean, strict: boolean, clip_len: double, min_gap: double, source: string, dry_run: boolean, full_download: boolean, try_sections: boolean>, heatmapPresent: boolean, quality: struct<flat: boolean>, clips: array<{clip}>>"
    j = profiles.manifest_json(spark, d).select("item_id", F.from_json("json", kind).alias("j"))
    return j.select("item_id", "j.video.title", "j.video.url", "j.params.*", F.col("j.heatmapPresent").alias("present"), "j.quality.flat", F.size("j.clips").alias("clips"), F.get("j.clips", 0)["file"].alias("file"), F.get("j.clips", 0)["label"].alias("label"))


def heatmap_json_bins(spark: SparkSession, d: str) -> DataFrame:
    """What heatmap_json holds, read back."""
    j = profiles.heatmap_json(spark, d).select("item_id", F.from_json("json", "struct<binSeconds: double, bins: array<struct<start: double, end: double, value: double>>>").alias("j"))
    bins = j.select("item_id", "j.binSeconds", F.posexplode("j.bins").alias("bin", "b"))
    return bins.select("item_id", "bin", *[F.round(c, 6).alias(a) for c, a in (("binSeconds", "width"), ("b.start", "start"), ("b.end", "end"), ("b.value", "value"))])


QUERIES = {
    f.__name__: f
    for f in (
        text_formats, number_formats, negative_times, names, job_names, error_hints, thumbnails, assets, plausible_files, run_arguments, log_chunks, info_json_fields, clips_strict, clip_lines, run_results,
        manifest_fields, heatmap_json_bins,
    )
}


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _of(n: str, values: tuple[str, ...]) -> str:
    return f"({_list(values)})[{n} % {len(values)} + 1]"


_TEXT = profiles._TEXT
_MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalars.MIME.items())
_CLIP_LABELS = f"{profiles._C}, {profiles._CHAPTERS}, lb AS (SELECT cl.item_id, clip_index, coalesce(arg_min(title, chapter_idx), '') AS label FROM cl LEFT JOIN ch ON ch.item_id = cl.item_id AND ch.start_sec <= centroid AND centroid < ch.end_sec GROUP BY 1, 2)"
ORACLES = {
    "text_formats": r"""SELECT DISTINCT text, trim(replace(replace(regexp_replace(text, '([\\{}])', '\\\1', 'g'), chr(10), ' '), chr(13), ''), ' ') AS ass, replace(replace(replace(text, chr(92), '/'), ':', chr(92) || ':'), chr(39), chr(92) || chr(39)) AS path, regexp_replace(regexp_replace(text, '[\x00-\x1f]', '', 'g'), '([\\:''%])', '\\\1', 'g') AS drawtext, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\r\n]'), lambda w: w <> '')) AS INTEGER) AS words FROM caption_cues WHERE text IS NOT NULL""",
    "number_formats": "SELECT c_custkey, printf('%.3f', c_acctbal) AS fixed, printf('%.6g', c_acctbal * 1000 / 7) AS compact, printf('%.6g', c_acctbal / 1e9::DOUBLE) AS small, CASE WHEN len(CAST(c_custkey AS VARCHAR)) >= 5 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS padded FROM customer",
    "negative_times": "WITH k AS (SELECT c_custkey, CAST(floor(greatest(c_acctbal, 0) * 100 + 0.5) AS BIGINT) AS cs FROM customer) SELECT c_custkey, printf('%d:%02d:%02d.%02d', cs // 360000, cs % 360000 // 6000, cs % 6000 // 100, cs % 100) AS ass FROM k",
    "names": f"WITH n AS (SELECT o_orderkey, {_of('o_orderkey', _NAMES)} AS name, {_of('o_orderkey', ('blur', 'crop', 'orig', 'other'))} AS kind FROM orders) SELECT o_orderkey, name, CASE lower(regexp_extract(name, '[.]([A-Za-z0-9]+)$', 1)) {_MIME} ELSE 'application/octet-stream' END AS mime, name <> '' AND NOT contains(name, '..') AND NOT contains(name, '/') AND NOT contains(name, chr(92)) AS safe, CASE kind WHEN 'blur' THEN '916blur' WHEN 'crop' THEN '916crop' WHEN 'orig' THEN 'orig' ELSE '?' END AS format FROM n",
    "job_names": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'cli-' ELSE 'web-' END || strftime(date_trunc('millisecond', ts), '%Y%m%d-%H%M%S-%g') AS id, strftime(date_trunc('millisecond', ts) + CASE WHEN event_id % 3 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%d %H:%M:%S.%g') AS began FROM events WHERE ts IS NOT NULL",
    "error_hints": f"WITH t AS (SELECT o_orderkey, {_of('o_orderkey', _ERRORS)} AS t FROM orders) SELECT o_orderkey, CASE WHEN contains(t, 'Failed to decrypt with DPAPI') OR contains(t, 'app-bound') THEN 'cookies unreadable' WHEN contains(t, 'could not find') AND contains(t, 'cookies database') THEN 'browser missing' WHEN contains(t, 'confirm you''re not a bot') THEN 'bot check' WHEN contains(t, 'age') OR contains(t, 'Sign in to confirm') THEN 'sign-in' ELSE '' END AS hint, contains(t, 'HTTP Error 429') OR contains(t, 'Too Many Requests') AS again FROM t",
    "thumbnails": f"WITH f AS (SELECT p_partkey // 3 AS item_id, {_of('p_partkey', _EXTENSIONS)} AS ext, 'thumb' || p_partkey || {_of('p_partkey', _EXTENSIONS)} AS path FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY list_position(['.jpg', '.png', '.webp'], ext), path) AS n FROM f WHERE ext <> '.gif') SELECT item_id, path FROM r WHERE n = 1",
    "assets": """WITH f AS (SELECT p_partkey // 5 AS item_id, p_name AS path, p_size * 40 AS w, (p_partkey % 7) * 200 AS h, p_partkey % 11 = 0 AS hint, p_partkey AS ord FROM part), g AS (SELECT f.*, kind FROM f, (VALUES ('banner'), ('avatar')) k(kind) WHERE w > 0 AND h > 0 AND (hint OR CASE kind WHEN 'banner' THEN w::DOUBLE / h >= 1.5 AND h >= 240 ELSE w::DOUBLE / h > 0.7 AND w::DOUBLE / h < 1.3 END)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY hint DESC, w * h DESC, ord) AS n FROM g)
SELECT item_id, path, kind FROM r WHERE n = 1""",
    "plausible_files": "WITH x AS (SELECT o_orderkey, floor(o_totalprice) AS size, o_orderkey % 5 - 1 AS sec FROM orders) SELECT o_orderkey, size >= 65536 AND (sec <= 0 OR size / sec >= 50000) AS download, size >= 65536 AS input, size >= 32768 AS cut, size >= 4096 AS card FROM x",
    "run_arguments": f"""WITH p AS (SELECT o_orderkey AS k, {_of('o_orderkey', ('916blur', '', 'orig'))} AS format, {_of('o_orderkey', ('none', 'edge'))} AS cookies, {_of('o_orderkey', ('fused', 'captions', 'heatmap'))} AS detect FROM orders)
SELECT k AS o_orderkey, concat_ws(' ', CASE WHEN k % 2 = 0 THEN '-n ' || k % 10 END, CASE WHEN k % 3 > 0 THEN '-l ' || printf('%.6g', k % 3 * 12.5::DOUBLE) END, CASE WHEN format <> '' THEN '--format ' || format END, CASE WHEN cookies <> 'none' THEN '--cookies-from-browser ' || cookies END, CASE WHEN detect <> 'fused' THEN '--detect ' || detect END, CASE WHEN k % 7 = 0 THEN '--dry-run' END, CASE WHEN k % 4 IN (0, 1) THEN '--dump-heatmap' END, CASE WHEN k % 5 = 0 THEN '--strict' END) AS arguments FROM p""",
    "log_chunks": 'SELECT p_partkey, least(p_partkey % 40, strlen(p_name)) AS "from", strlen(p_name) AS "next", substr(p_name, least(p_partkey % 40, strlen(p_name)) + 1) AS chunk FROM part',
    "info_json_fields": f"WITH {profiles._INFO.replace('WITH ', '')} SELECT j.record_id, {_TEXT.format('channel')} AS channel, CASE WHEN list_contains(json_keys(body), 'uploader_url') THEN {_TEXT.format('uploader_url')} ELSE {_TEXT.format('channel_url')} END AS channel_url, {_TEXT.format('uploader_id')} AS channel_handle, {_TEXT.format('webpage_url')} AS url, CASE WHEN {_TEXT.format('language')} <> '' THEN {_TEXT.format('language')} ELSE {_TEXT.format('original_language')} END AS language, round(w.bin_s, 6) AS bin_seconds FROM j LEFT JOIN (SELECT DISTINCT item_id, bin_s FROM prof) w ON w.item_id = CAST(j.record_id AS VARCHAR) WHERE n = 0 OR n = 100",
    "clips_strict": f"{profiles._UC} SELECT cl.item_id, clip_index, round(start_sec, 6) AS start_sec FROM cl JOIN th USING (item_id) WHERE NOT ratio < 2",
    "clip_lines": f"{_CLIP_LABELS} SELECT cl.item_id, cl.clip_index, printf('%-3d  %-10s  %-10s  %-6.1f  %-6.3f  %-5d  %s', cl.clip_index, {profiles._HMS.format('start_sec')}, {profiles._HMS.format('end_sec')}, end_sec - start_sec, peak_score, peak_bin, label) AS line FROM cl JOIN lb USING (item_id, clip_index)",
    "run_results": f"{profiles._C}, n AS (SELECT item_id, count(*) AS n FROM cl GROUP BY 1) SELECT item_id, '{{\"clips\":' || n || ',\"dryRun\":true}}' AS json FROM n UNION ALL SELECT item_id, '{{\"clips\":' || n || ',\"out\":\"out/x\"}}' FROM n",
    "manifest_fields": f"{_CLIP_LABELS}, m AS (SELECT CAST(record_id AS VARCHAR) AS item_id, {_TEXT.format('title')} AS title, {_TEXT.format('webpage_url')} AS url FROM j WHERE n = 100), f AS (SELECT cl.item_id, count(*) AS clips, arg_min(printf('clip_%02d_', cl.clip_index) || replace({profiles._HMS.format('start_sec')}, ':', '') || '.mp4', cl.clip_index) AS file, arg_min(label, cl.clip_index) AS label FROM cl JOIN lb USING (item_id, clip_index) GROUP BY 1) SELECT m.item_id, title, url, 6 AS max_clips, '916blur' AS format, false AS keep_intro, false AS strict, 0.0::DOUBLE AS clip_len, 0.0::DOUBLE AS min_gap, 'ytdlp' AS source, false AS dry_run, false AS full_download, false AS try_sections, true AS present, ratio < 2 AS flat, CAST(coalesce(clips, 0) AS INTEGER) AS clips, file, label FROM m JOIN th USING (item_id) LEFT JOIN f USING (item_id)",
    "heatmap_json_bins": f'{profiles._P} SELECT item_id, bin, round(bin_s, 6) AS width, round(bin * bin_s, 6) AS start, round((bin + 1) * bin_s, 6) AS "end", round(value, 6) AS value FROM prof',
}
