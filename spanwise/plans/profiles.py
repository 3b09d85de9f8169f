"""Queries over profiles and plans, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.config import PlanConfig
from spanwise.functions import scalars
from spanwise.operators import planning, profile
from spanwise.plans.adapters import parsed_info, type_profiles, user_profiles
from spanwise.session import table
from spanwise.sources import info_json, sinks


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def info_profiles(spark: SparkSession, d: str) -> DataFrame:
    return info_json.profiles(parsed_info(spark, d), "record_id")


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return profile.detect(info_profiles(spark, d))


def profile_bins(spark: SparkSession, d: str) -> DataFrame:
    return profile.to_bins(user_profiles(spark, d)).select("item_id", "bin", *_r("value"))


def profile_bins_by_type(spark: SparkSession, d: str) -> DataFrame:
    return profile.to_bins(type_profiles(spark, d)).select("item_id", "bin", *_r("value"))


def profile_mask(spark: SparkSession, d: str) -> DataFrame:
    return profile.candidate_mask(info_profiles(spark, d)).select("item_id", F.posexplode("cand").alias("bin", "cand"))


def profile_smooth(spark: SparkSession, d: str) -> DataFrame:
    return profile.to_bins(profile.smooth(info_profiles(spark, d)), "hs").select("item_id", "bin", *_r("value"))


def profile_stats(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d).select("item_id", *_r("median", "mean", "sd", "top"))


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d).select("item_id", *_r("ratio"), "flat")


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d).select("item_id", *_r("t", "t_low"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    p = profile.candidate_mask(info_profiles(spark, d))
    return profile.raw_regions(profile.robust_stats(profile.smooth(p)))


def regions_raw(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("item_id", F.inline("runs"))


def regions_merged(spark: SparkSession, d: str) -> DataFrame:
    return profile.merge_runs(_marked(spark, d)).select("item_id", F.inline("runs"))


def regions_scored(spark: SparkSession, d: str) -> DataFrame:
    return profile.regions(_detected(spark, d)).select("item_id", "start_bin", "end_bin", "peak_bin", *_r("peak_score", "centroid"))


def clips_greedy(spark: SparkSession, d: str) -> DataFrame:
    kept = planning.select_regions(_detected(spark, d)).select("item_id", F.inline("kept"))
    return kept.select("item_id", "start_bin", *_r("centroid"))


def clips_windowed(spark: SparkSession, d: str) -> DataFrame:
    return planning.plan(_detected(spark, d)).select("item_id", "clip_index", "peak_bin", *_r("start_sec", "end_sec"))


def clips_per_user(spark: SparkSession, d: str) -> DataFrame:
    """Hot windows of every user's activity."""
    return planning.plan(profile.detect(user_profiles(spark, d))).select("item_id", "clip_index", "peak_bin", *_r("start_sec", "end_sec"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return planning.label(planning.plan(_detected(spark, d)), info_json.chapter_rows(parsed_info(spark, d), "record_id"))


def clips_labelled(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("item_id", "clip_index", "label")


def clips_fixed_length(spark: SparkSession, d: str) -> DataFrame:
    cfg = PlanConfig(max_clips=3, clip_len=30.0, min_gap=30.0)
    return planning.plan(_detected(spark, d), cfg).select("item_id", "clip_index", "peak_bin", *_r("start_sec", "end_sec"))


def download_strategy(spark: SparkSession, d: str) -> DataFrame:
    det = profile.detect(user_profiles(spark, d))
    return planning.strategy(planning.plan(det), det).select("item_id", "clips", *_r("clip_sec"), "strategy")


def section_windows(spark: SparkSession, d: str) -> DataFrame:
    det = _detected(spark, d)
    return planning.sections(planning.plan(det), det).select("item_id", "clip_index", *_r("src_start", "src_end"), "stem")


def section_times(spark: SparkSession, d: str) -> DataFrame:
    det = _detected(spark, d)
    clips = planning.plan(det)
    return planning.translate(clips, planning.sections(clips, det)).select("item_id", "clip_index", *_r("start_sec", "end_sec"))


def sparkline(spark: SparkSession, d: str) -> DataFrame:
    return info_profiles(spark, d).select("item_id", profile.sparkline(F.col("vals")).alias("spark"))


def info_json_valid(spark: SparkSession, d: str) -> DataFrame:
    return parsed_info(spark, d).filter("reason IS NULL").select("record_id", "video_id", "title", *_r("duration"), "is_live", "follower_count", F.size("chapters").alias("chapters"), F.col("vals").isNotNull().alias("has_profile"))


def info_json_rejects(spark: SparkSession, d: str) -> DataFrame:
    return parsed_info(spark, d).filter("reason IS NOT NULL").select("record_id", "reason")


def info_json_chapters(spark: SparkSession, d: str) -> DataFrame:
    return info_json.chapter_rows(parsed_info(spark, d), "record_id").select("item_id", "chapter_idx", *_r("start_sec", "end_sec"), "title")


def manifest_json(spark: SparkSession, d: str) -> DataFrame:
    videos = parsed_info(spark, d).filter("reason IS NULL").select(F.col("record_id").cast("string").alias("item_id"), "title", "channel", "url")
    return sinks.manifest(videos, _detected(spark, d), _labelled(spark, d))


def heatmap_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.heatmap_json(info_profiles(spark, d))


def run_catalogue(spark: SparkSession, d: str) -> DataFrame:
    from spanwise.operators.listing import run_listing

    orders = table(spark, d, "orders")
    run = lambda df: df.select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "web-").otherwise(""), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderdate").alias("modified"))
    disk = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("modified"))
    return run_listing(run(orders.filter("o_orderstatus = 'F'")), disk)


def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest runs; the limit is the feature."""
    return run_catalogue(spark, d).orderBy(F.desc("modified"), "id").limit(50)


def scalar_formats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("video_id", "chapter_idx", F.coalesce("start_sec", F.lit(0.0)).alias("s"), F.coalesce("end_sec", F.lit(0.0)).alias("e")).distinct().filter("s >= 0 AND e >= 0")
    return c.select("video_id", "chapter_idx", "s", "e", scalars.hms(F.col("s")).alias("hms"), scalars.clip_filename(F.col("chapter_idx"), F.col("s")).alias("file"), scalars.ass_timestamp(F.col("s")).alias("ass"), scalars.time_range(F.col("s"), F.col("e")).alias("range"))


def follower_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "channels")
    return c.select("channel_id", scalars.followers(F.col("follower_count")).alias("followers"), scalars.subline(F.col("channel_handle"), F.col("follower_count")).alias("subline"))


QUERIES = {
    f.__name__: f
    for f in (
        profile_bins, profile_bins_by_type, profile_mask, profile_smooth, profile_stats, quality_gate, thresholds, regions_raw, regions_merged, regions_scored,
        clips_greedy, clips_windowed, clips_per_user, clips_labelled, clips_fixed_length, download_strategy, section_windows, section_times, sparkline, info_json_valid,
        info_json_rejects, info_json_chapters, manifest_json, heatmap_json, run_catalogue, recent_runs, scalar_formats, follower_labels,
    )
}

_USERS = """e AS (SELECT CAST({key} AS VARCHAR) AS item_id, epoch_us(ts) AS us, {w} AS v FROM events WHERE {key} IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT item_id, min(us) AS t0, max(us) AS t1 FROM e GROUP BY 1),
b AS (SELECT e.item_id, CASE WHEN t1 > t0 THEN least(99, CAST(floor(100.0::DOUBLE * (us - t0) / (t1 - t0)) AS INTEGER)) ELSE 0 END AS bin, sum(v)::DOUBLE AS w FROM e JOIN s USING (item_id) GROUP BY 1, 2),
m AS (SELECT item_id, max(w) AS top FROM b GROUP BY 1),
prof AS (SELECT s.item_id, g.bin, coalesce(b.w / m.top, 0)::DOUBLE AS value, (t1 - t0) / 1e6::DOUBLE AS duration, (t1 - t0) / 1e6::DOUBLE / 100 AS bin_s
  FROM s JOIN m USING (item_id) CROSS JOIN (SELECT unnest(range(100))::INTEGER AS bin) g LEFT JOIN b ON b.item_id = s.item_id AND b.bin = g.bin)"""
_PER_USER = _USERS.format(key="user_id", w="1")
_NUM = "coalesce(TRY_CAST(regexp_extract(json_extract_string({}), '^\\s*[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') AS DOUBLE), 0)"
_VALID = """j AS (SELECT record_id, body, coalesce(json_array_length(CASE WHEN json_type(body, '$.heatmap') = 'ARRAY' THEN json_extract(body, '$.heatmap') END), 0) AS n
  FROM info_json WHERE body IS NOT NULL AND body <> '' AND json_valid(body) AND json_type(body) = 'OBJECT' AND coalesce(json_type(body, '$.id'), 'NULL') <> 'NULL')"""
_INFO = (
    _VALID
    + f""", h AS (SELECT CAST(record_id AS VARCHAR) AS item_id, {_NUM.format("body, '$.duration'")} AS duration, {_NUM.format("body, '$.heatmap[0].end_time'")} - {_NUM.format("body, '$.heatmap[0].start_time'")} AS w, CAST(json_extract(body, '$.heatmap') AS JSON[]) AS xs FROM j WHERE n = 100),
u AS (SELECT item_id, duration, CASE WHEN w > 0 THEN w WHEN duration > 0 THEN duration / 100 ELSE w END AS bin_s, unnest(xs) AS x, (generate_subscripts(xs, 1) - 1)::INTEGER AS bin FROM h),
prof AS (SELECT item_id, bin, {_NUM.format("x, '$.value'")} AS value, duration, bin_s FROM u)"""
)
_CHAIN = """,
mk AS (SELECT *, bin <> 0 AND NOT (bin = 1 AND max(CASE WHEN bin = 1 THEN value END) OVER p > max(CASE WHEN bin = 2 THEN value END) OVER p AND max(CASE WHEN bin = 2 THEN value END) OVER p > max(CASE WHEN bin = 3 THEN value END) OVER p) AS cand FROM prof WINDOW p AS (PARTITION BY item_id)),
sm AS (SELECT *, CASE WHEN bin_s < 60 AND bin BETWEEN 1 AND 98 THEN (lag(value) OVER o + 2.0::DOUBLE * value + lead(value) OVER o) / 4.0::DOUBLE ELSE value END AS hs FROM mk WINDOW o AS (PARTITION BY item_id ORDER BY bin)),
st AS (SELECT item_id, any_value(duration) AS duration, any_value(bin_s) AS bin_s, median(hs) FILTER (cand) AS median, avg(hs) FILTER (cand) AS mean, stddev_pop(hs) FILTER (cand) AS sd, max(hs) FILTER (cand) AS top FROM sm GROUP BY 1),
th AS (SELECT *, CASE WHEN median > 0 THEN top / median ELSE top * 1000 END AS ratio, CASE WHEN top >= 1e-6 THEN greatest(median + 1.5::DOUBLE * sd, 0.4::DOUBLE * top) END AS t FROM st),
hot AS (SELECT sm.item_id, bin, hs, t, bin - row_number() OVER (PARTITION BY sm.item_id ORDER BY bin) AS grp FROM sm JOIN th USING (item_id) WHERE cand AND hs >= 0.6::DOUBLE * t - 1e-12),
rr AS (SELECT item_id, min(bin) AS lo, max(bin) AS hi FROM hot GROUP BY item_id, grp HAVING max(hs - t) >= -1e-12),
mg0 AS (SELECT *, CASE WHEN lo - lag(hi) OVER w - 1 > 1 OR lag(hi) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM rr WINDOW w AS (PARTITION BY item_id ORDER BY lo)),
mg1 AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY lo) AS grp FROM mg0),
mg AS (SELECT item_id, min(lo) AS lo, max(hi) AS hi FROM mg1 GROUP BY item_id, grp),
sc AS (SELECT mg.item_id, lo AS start_bin, hi AS end_bin, max(hs) AS peak_score, arg_min(bin, -hs * 1000 + bin * 1e-9) AS peak_bin, least(CASE WHEN sum(hs) > 0 THEN sum((bin + 0.5::DOUBLE) * bin_s * hs) / sum(hs) ELSE (lo + 0.5::DOUBLE) * any_value(bin_s) END, any_value(duration)) AS centroid, any_value(duration) AS duration, any_value(bin_s) AS bin_s FROM mg JOIN sm ON sm.item_id = mg.item_id AND bin BETWEEN lo AND hi GROUP BY mg.item_id, lo, hi)"""
_GREEDY = """,
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(peak_score, 12) DESC, start_bin) AS rn, {gap} AS gap FROM sc),
gr AS (SELECT item_id, 0::BIGINT AS rn, []::DOUBLE[] AS kept, []::INTEGER[] AS bins FROM rk GROUP BY 1
  UNION ALL SELECT rk.item_id, rk.rn, CASE WHEN ok THEN list_append(kept, centroid) ELSE kept END, CASE WHEN ok THEN list_append(bins, start_bin) ELSE bins END FROM (
    SELECT rk.*, g.kept, g.bins, len(g.kept) < {k} AND (rk.duration > 180 OR len(g.kept) = 0) AND len(list_filter(g.kept, lambda x: abs(x - rk.centroid) < rk.gap)) = 0 AS ok FROM gr g JOIN rk ON rk.item_id = g.item_id AND rk.rn = g.rn + 1) rk),
fin AS (SELECT item_id, arg_max(bins, rn) AS bins FROM gr GROUP BY 1),
kp AS (SELECT sc.* FROM sc JOIN fin USING (item_id) WHERE list_contains(bins, start_bin)),
w0 AS (SELECT *, {len} AS len FROM kp),
w1 AS (SELECT *, centroid - len / 2 AS s0, centroid + len / 2 AS e0 FROM w0),
w2 AS (SELECT *, greatest(s0, 0) AS s1, CASE WHEN s0 < 0 THEN e0 - s0 ELSE e0 END AS e1 FROM w1),
w3 AS (SELECT *, CASE WHEN duration <= 180 THEN 0 WHEN e1 > duration THEN greatest(s1 - (e1 - duration), 0) ELSE s1 END::DOUBLE AS start_sec, CASE WHEN duration <= 180 THEN duration ELSE least(e1, duration) END AS end_sec FROM w2),
cl AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(start_sec, 9), peak_bin) AS INTEGER) AS clip_index FROM w3)"""
_AUTO = {"gap": "greatest(90, 2 * bin_s)", "k": 6, "len": "least(greatest(1.5::DOUBLE * bin_s, 40), 90)"}
_P = f"WITH RECURSIVE {_INFO}{_CHAIN}"
_C = _P + _GREEDY.format(**_AUTO)
_UC = f"WITH RECURSIVE {_PER_USER}{_CHAIN}" + _GREEDY.format(**_AUTO)
_CHAPTERS = f"""ch0 AS (SELECT CAST(record_id AS VARCHAR) AS item_id, CAST(json_extract(body, '$.chapters') AS JSON[]) AS xs FROM j WHERE (n = 0 OR n = 100) AND json_type(body, '$.chapters') = 'ARRAY'),
ch1 AS (SELECT item_id, unnest(xs) AS x, (generate_subscripts(xs, 1) - 1)::INTEGER AS chapter_idx FROM ch0),
ch AS (SELECT item_id, chapter_idx, {_NUM.format("x, '$.start_time'")} AS start_sec, {_NUM.format("x, '$.end_time'")} AS end_sec, coalesce(json_extract_string(x, '$.title'), '') AS title FROM ch1)"""
_TEXT = "coalesce(json_extract_string(body, '$.{0}'), '')"
_SECTIONS = ", sec AS (SELECT item_id, clip_index, start_sec, end_sec, greatest(start_sec - 10, 0) AS src_start, CASE WHEN duration > 0 THEN least(end_sec + 10, duration) ELSE end_sec + 10 END AS src_end, max(clip_index) OVER (PARTITION BY item_id) AS most FROM cl)"
_HMS = "printf('%02d:%02d:%02d', CAST(floor(floor({0} + 0.5) / 3600) AS BIGINT), CAST(floor(floor({0} + 0.5) % 3600 / 60) AS BIGINT), CAST(floor({0} + 0.5) % 60 AS BIGINT))"
_RUNS = """WITH mem AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'web-' ELSE '' END || o_orderkey AS id, o_orderdate AS modified FROM orders WHERE o_orderstatus = 'F'),
al AS (SELECT id, 'memory' AS source, modified FROM mem UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'disk', o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM mem WHERE replace(mem.id, 'web-', '') = CAST(o_orderkey AS VARCHAR)))"""

ORACLES = {
    "profile_bins": f"WITH {_PER_USER} SELECT item_id, bin, round(value, 6) AS value FROM prof",
    "profile_bins_by_type": f"WITH {_USERS.format(key='event_type', w='value')} SELECT item_id, bin, round(value, 6) AS value FROM prof",
    "profile_mask": f"{_P} SELECT item_id, bin, cand FROM mk",
    "profile_smooth": f"{_P} SELECT item_id, bin, round(hs, 6) AS value FROM sm",
    "profile_stats": f"{_P} SELECT item_id, round(median, 6) AS median, round(mean, 6) AS mean, round(sd, 6) AS sd, round(top, 6) AS top FROM st",
    "quality_gate": f"{_P} SELECT item_id, round(ratio, 6) AS ratio, ratio < 2.0 AS flat FROM th",
    "thresholds": f"{_P} SELECT item_id, round(t, 6) AS t, round(0.6::DOUBLE * t, 6) AS t_low FROM th",
    "regions_raw": f"{_P} SELECT item_id, lo, hi FROM rr",
    "regions_merged": f"{_P} SELECT item_id, lo, hi FROM mg",
    "regions_scored": f"{_P} SELECT item_id, start_bin, end_bin, peak_bin, round(peak_score, 6) AS peak_score, round(centroid, 6) AS centroid FROM sc",
    "clips_greedy": f"{_C} SELECT item_id, start_bin, round(centroid, 6) AS centroid FROM kp",
    "clips_windowed": f"{_C} SELECT item_id, clip_index, peak_bin, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec FROM cl",
    "clips_per_user": f"{_UC} SELECT item_id, clip_index, peak_bin, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec FROM cl",
    "clips_fixed_length": f"{_P}{_GREEDY.format(gap='30.0', k=3, len='30.0::DOUBLE')} SELECT item_id, clip_index, peak_bin, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec FROM cl",
    "clips_labelled": f"{_C}, {_CHAPTERS} SELECT cl.item_id, clip_index, coalesce(arg_min(title, chapter_idx), '') AS label FROM cl LEFT JOIN ch ON ch.item_id = cl.item_id AND ch.start_sec <= centroid AND centroid < ch.end_sec GROUP BY 1, 2",
    "download_strategy": f"{_UC} SELECT item_id, count(*) AS clips, round(sum(end_sec - start_sec), 6) AS clip_sec, CASE WHEN count(*) >= 2 AND any_value(duration) > 900 AND sum(end_sec - start_sec) < 0.3 * any_value(duration) THEN 'per_clip' ELSE 'full' END AS strategy FROM cl GROUP BY 1",
    "section_windows": f"{_C}{_SECTIONS} SELECT item_id, clip_index, round(src_start, 6) AS src_start, round(src_end, 6) AS src_end, lpad(CAST(clip_index AS VARCHAR), CAST(len(CAST(most AS VARCHAR)) AS INTEGER), '0') AS stem FROM sec",
    "section_times": f"{_C}{_SECTIONS}, org AS (SELECT a.item_id, a.clip_index, arg_min(b.src_start, b.clip_index) AS origin FROM sec a JOIN sec b ON a.item_id = b.item_id AND b.src_start <= a.start_sec AND a.end_sec <= b.src_end GROUP BY 1, 2) SELECT item_id, clip_index, round(start_sec - coalesce(origin, 0), 6) AS start_sec, round(end_sec - coalesce(origin, 0), 6) AS end_sec FROM sec LEFT JOIN org USING (item_id, clip_index)",
    "sparkline": f"{_P} SELECT item_id, string_agg(substr(' .,-=+*#%@', CAST(floor(least(greatest(value, 0), 1) * 9 + 0.5) AS INTEGER) + 1, 1), '' ORDER BY bin) AS spark FROM prof GROUP BY 1",
    "info_json_valid": f"WITH {_VALID} SELECT record_id, {_TEXT.format('id')} AS video_id, {_TEXT.format('title')} AS title, round({_NUM.format(chr(98) + 'ody, ' + repr('$.duration'))}, 6) AS duration, coalesce(json_extract_string(body, '$.is_live') = 'true', false) OR {_TEXT.format('live_status')} IN ('is_live', 'is_upcoming', 'post_live') AS is_live, CAST({_NUM.format(chr(98) + 'ody, ' + repr('$.channel_follower_count'))} AS BIGINT) AS follower_count, CASE WHEN json_type(body, '$.chapters') = 'ARRAY' THEN CAST(json_array_length(body, '$.chapters') AS INTEGER) ELSE 0 END AS chapters, n = 100 AS has_profile FROM j WHERE n = 0 OR n = 100",
    "info_json_rejects": f"WITH {_VALID}, o AS (SELECT record_id, body IS NOT NULL AND body <> '' AND json_valid(body) AS ok, CASE WHEN body <> '' AND json_valid(body) THEN json_type(body) END AS kind FROM info_json) SELECT o.record_id, CASE WHEN NOT ok OR kind <> 'OBJECT' THEN 'malformed' WHEN j.record_id IS NULL THEN 'no id' ELSE 'profile size' END AS reason FROM o LEFT JOIN j USING (record_id) WHERE j.record_id IS NULL OR (n > 0 AND n <> 100)",
    "info_json_chapters": f"WITH {_VALID}, {_CHAPTERS} SELECT item_id, chapter_idx, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, title FROM ch",
    "run_catalogue": f"{_RUNS} SELECT * FROM al",
    "recent_runs": f"{_RUNS} SELECT * FROM al ORDER BY modified DESC, id LIMIT 50",
    "scalar_formats": f"""WITH c AS (SELECT DISTINCT video_id, chapter_idx, coalesce(start_sec, 0) AS s, coalesce(end_sec, 0) AS e FROM chapters), k AS (SELECT *, CAST(floor(s * 100 + 0.5) AS BIGINT) AS cs FROM c WHERE s >= 0 AND e >= 0)
SELECT video_id, chapter_idx, s, e, {_HMS.format('s')} AS hms, printf('clip_%02d_', chapter_idx) || replace({_HMS.format('s')}, ':', '') || '.mp4' AS file, printf('%d:%02d:%02d.%02d', cs // 360000, cs % 360000 // 6000, cs % 6000 // 100, cs % 100) AS ass, printf('*%.2f-%.2f', s, e) AS "range" FROM k""",
    "follower_labels": """WITH c AS (SELECT *, CASE WHEN follower_count >= 1000000 THEN printf('%.2fM', follower_count / 1e6::DOUBLE) WHEN follower_count >= 1000 THEN printf('%.2fK', follower_count / 1e3::DOUBLE) ELSE CAST(follower_count AS VARCHAR) END AS f FROM channels)
SELECT channel_id, f AS followers, concat_ws('  ·  ', CASE WHEN channel_handle <> '' THEN channel_handle END, CASE WHEN follower_count > 0 THEN f || ' subscribers' END) AS subline FROM c""",
}
