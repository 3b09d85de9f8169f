"""Queries over captions and text, and their SQL."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.config import PlanConfig
from spanwise.functions import text as txt
from spanwise.functions.lexicon import DEFAULT_MARKERS, LOANWORDS, MAGNITUDES, NO_ENGLISH
from spanwise.operators import captions, fuse, planning, profile, subtitles
from spanwise.plans import profiles
from spanwise.plans.adapters import caption_cues, caption_heat, cue_durations, document_cues
from spanwise.session import materialize, table
from spanwise.sources import info_json, sinks, vtt


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return captions.clean_cues(caption_cues(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return captions.usable_items(_clean(spark, d), cue_durations(caption_cues(spark, d)))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return captions.score_windows(caption_cues(spark, d))


def cues_clean(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d)


def caption_usable(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)


def cue_lines(spark: SparkSession, d: str) -> DataFrame:
    return document_cues(spark, d).select("item_id", "cue_idx", "start_sec", "text")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Caption files made of the cue table: a header and, per cue, a timing line and its text."""
    c = caption_cues(spark, d).filter("start_sec >= 0 AND end_sec > start_sec AND text IS NOT NULL")
    c = c.groupBy("item_id", "cue_idx").agg(F.min(F.struct("start_sec", "end_sec", "text")).alias("c")).select("item_id", "cue_idx", "c.*")
    at = lambda s: F.format_string("%02d:%02d.%03d", F.floor(F.floor(s) / 60).cast("long"), F.floor(s).cast("long") % 60, (F.round(s * 1000).cast("long") % 1000))
    block = F.concat(at(F.col("start_sec")), F.lit(" --> "), at(F.col("end_sec")), F.lit(" align:start\n"), F.col("text"), F.lit("\n"))
    per = c.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("cue_idx", block.alias("b")))).alias("bs"))
    return per.select("item_id", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(F.transform("bs", lambda b: b["b"]), "\n")).alias("body"))


def cue_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return vtt.parse(_files(spark, d), "item_id", "body").select("item_id", "cue_idx", *_r("start_sec", "end_sec"), "text")


def cue_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("item_id", "cue_idx", captions.normalise(F.col("text")).alias("norm"))


def marker_hits(spark: SparkSession, d: str) -> DataFrame:
    m = captions.mark(_clean(spark, d)).filter(F.size("signals") > 0)
    return m.select("item_id", "cue_idx", "pre", "payload", "trailing", "negative", F.array_join("signals", ",").alias("signals"))


def numeric_payloads(spark: SparkSession, d: str) -> DataFrame:
    return captions.mark(_clean(spark, d)).filter("numeric > 0").select("item_id", "cue_idx", F.col("numeric").cast("int").alias("numeric"))


def shingle_df(spark: SparkSession, d: str) -> DataFrame:
    return captions.shingle_df(captions.mark(_clean(spark, d))).select("item_id", "shingle", "df")


def shingles(spark: SparkSession, d: str) -> DataFrame:
    return captions.mark(_clean(spark, d)).select("item_id", "cue_idx", F.explode(captions.shingles(F.col("norm"))).alias("shingle"))


def position_prior(spark: SparkSession, d: str) -> DataFrame:
    rows = _clean(spark, d).join(_items(spark, d), "item_id")
    return rows.select("item_id", "cue_idx", captions.prior((F.col("start_ms") + F.col("end_ms")) / 2.0, F.col("duration_ms")).alias("prior"))


def cold_open_echo(spark: SparkSession, d: str) -> DataFrame:
    return _opening(caption_cues(spark, d))


def _opening(cues: DataFrame) -> DataFrame:
    """Echoes need no markers: cues are only cleaned, and kept for both that read them."""
    clean = materialize(captions.clean_cues(cues).select("item_id", "cue_idx", "start_ms", "end_ms", captions.normalise(F.col("text")).alias("norm")))
    items = clean.groupBy("item_id").agg(F.count("*").alias("cues"), F.max("end_ms").alias("duration_ms"))
    return captions.cold_open_echoes(clean, items.filter(F.col("cues") >= captions.CFG.least_cues))


def cold_open_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same on the documents, which have no usable word repeated across their length by design."""
    return _opening(document_cues(spark, d))


def forward_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("item_id", "cue_idx", *_r("start_sec", "end_sec", "score"), "four_beat", "masked", "hook_idx")


def four_beat(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).filter("four_beat").select("item_id", "cue_idx")


def promo_mask(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).filter("masked").select("item_id", "cue_idx")


def caption_envelope(spark: SparkSession, d: str) -> DataFrame:
    return captions.envelope(_windows(spark, d)).select("item_id", "bin", *_r("value"))


def caption_nms(spark: SparkSession, d: str) -> DataFrame:
    return captions.candidates(_windows(spark, d)).select("item_id", "rank", *_r("start_sec", "end_sec", "score"))


class _Scored(NamedTuple):
    """Prepared cues and their windows, kept for the several steps that read them."""

    cues: captions.Prepared
    windows: DataFrame


def _scored(spark: SparkSession, d: str) -> _Scored:
    cues = captions.prepare(caption_cues(spark, d))
    return _Scored(cues, materialize(captions.windows_of(cues)))


def _candidates(scored: _Scored) -> DataFrame:
    return captions.with_hooks(captions.candidates(scored.windows), scored.cues.marked)


def captions_json(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    chosen = _chosen(spark, d, scored).filter("mode IN ('fused', 'caption-only')").select("item_id", "mode")
    return sinks.captions_json(_candidates(scored), chosen.join(_langs(spark, d), "item_id", "left"), 0.4)


def _chosen(spark: SparkSession, d: str, scored: _Scored | None = None) -> DataFrame:
    cues, windows = scored or _Scored(p := captions.prepare(caption_cues(spark, d)), captions.windows_of(p))
    durations = cues.items.select("item_id", (F.col("duration_ms") / 1000).alias("duration"))
    return fuse.choose_profile(caption_heat(spark, d), fuse.caption_arrays(captions.envelope(windows)), durations)


def profile_fusion(spark: SparkSession, d: str) -> DataFrame:
    return profile.to_bins(_chosen(spark, d).filter("mode = 'fused'")).select("item_id", "bin", *_r("value"))


def profile_mode(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d).select("item_id", "mode")


def profile_mode_heatmap(spark: SparkSession, d: str) -> DataFrame:
    heat = caption_heat(spark, d)
    none = heat.select("item_id", F.col("vals").alias("cap"))
    return fuse.choose_profile(heat, none, cue_durations(caption_cues(spark, d)), "heatmap").select("item_id", "mode")


def _planned(spark: SparkSession, d: str, scored: _Scored | None = None) -> DataFrame:
    clips = planning.plan(profile.detect(_chosen(spark, d, scored).filter("mode != 'rejected'")), PlanConfig())
    return clips.withColumn("label", F.lit(""))


def _adopted(spark: SparkSession, d: str, scored: _Scored | None = None) -> DataFrame:
    # windows serve both the envelope and the candidates, clips all that follows: each is kept once
    scored = scored or _scored(spark, d)
    return materialize(fuse.adopt(_planned(spark, d, scored), _candidates(scored)))


def clip_adoption(spark: SparkSession, d: str) -> DataFrame:
    return _adopted(spark, d).select("item_id", "clip_index", *_r("start_sec", "end_sec"))


def clip_hooks(spark: SparkSession, d: str) -> DataFrame:
    return _adopted(spark, d).select("item_id", "clip_index", "label")


def clip_snap(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    return fuse.snap(_adopted(spark, d, scored), scored.cues.marked).select("item_id", "clip_index", *_r("start_sec", "end_sec"))


def subtitle_split(spark: SparkSession, d: str) -> DataFrame:
    c = _clean(spark, d).select("item_id", "cue_idx", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"), "text")
    return subtitles.split_cues(c, ["item_id", "cue_idx"]).select("item_id", "cue_idx", "part", *_r("start_sec", "end_sec"), "text")


def subtitle_chain(spark: SparkSession, d: str) -> DataFrame:
    c = _clean(spark, d).select("item_id", "cue_idx", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"))
    return subtitles.chain(c, ["item_id"], ["cue_idx"]).select("item_id", "cue_idx", *_r("start_sec", "end_sec"))


def subtitle_files(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    cut = subtitles.trim_to_clips(scored.cues.marked, materialize(_planned(spark, d, scored)))
    parts = subtitles.split_cues(cut, ["item_id", "clip_index", "cue_idx"])
    return subtitles.ass_text(subtitles.chain(parts, ["item_id", "clip_index"], ["cue_idx", "part"]), ["item_id", "clip_index"])


def caption_choice(spark: SparkSession, d: str) -> DataFrame:
    """The caption document of each video to take: in its own language, else English, else Hindi, else any."""
    videos = table(spark, d, "videos").filter("video_id IS NOT NULL").groupBy(F.col("video_id").alias("item_id")).agg(F.min("language").alias("wanted"))
    order = videos.select("item_id", info_json.language_order(F.col("wanted"), F.lit("en,hi")).alias("langs"))
    available = table(spark, d, "caption_docs").select(F.col("video_id").alias("item_id"), "lang", F.col("caption_id").cast("string").alias("path")).distinct()
    return info_json.first_available(available, order)


def script_detect(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("item_id", "cue_idx", txt.detect_script(F.col("text")).alias("script"))


def _langs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "caption_docs").groupBy(F.col("caption_id").cast("string").alias("item_id")).agg(F.min("lang").alias("lang"))


def _with_lang(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).join(_langs(spark, d), "item_id", "left")


def romanise_sound(spark: SparkSession, d: str) -> DataFrame:
    return _with_lang(spark, d).select("item_id", "cue_idx", txt.to_latin(F.col("text"), F.col("lang")).alias("latin"))


def romanise(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_lang(spark, d).select(F.struct("item_id", "cue_idx").alias("id"), "text", "lang")
    return txt.romanise(rows, _english(spark, d), txt.loanword_table(spark)).select("id.item_id", "id.cue_idx", "latin")


def fuzzy_recover(spark: SparkSession, d: str) -> DataFrame:
    words = _clean(spark, d).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return txt.recover_english(words, _english(spark, d))


def _english(spark: SparkSession, d: str) -> DataFrame:
    """English words by frequency, of the captions and prose that are known to be English."""
    own = lambda name: table(spark, d, name).filter("lang = 'en'").select("text")
    return txt.english_table(txt.word_counts(own("lang_samples").unionByName(own("graded_samples"))))


def english_words(spark: SparkSession, d: str) -> DataFrame:
    return _english(spark, d)


def loanwords(spark: SparkSession, d: str) -> DataFrame:
    """Devanagari runs of the cues that are loanwords."""
    runs = _clean(spark, d).select("item_id", "cue_idx", F.posexplode(F.regexp_extract_all("text", F.lit(f"[{txt.DEVA}]+"), F.lit(0))).alias("pos", "run"))
    return runs.join(txt.loanword_table(spark).withColumnRenamed("deva", "run"), "run").select("item_id", "cue_idx", "pos", "run", "eng")


def script_route(spark: SparkSession, d: str) -> DataFrame:
    return _with_lang(spark, d).select("item_id", "cue_idx", txt.route(F.col("text"), F.col("lang")).alias("script"))


def fuzzy_parts(spark: SparkSession, d: str) -> DataFrame:
    """What recovery looks at in each word of the cues, against the commonest English word of its first letter."""
    words = _clean(spark, d).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word != ''").distinct()
    head = _english(spark, d).groupBy("first").agg(F.min_by("english", "rank").alias("english"))
    both = words.join(head, F.substring("word", 1, 1) == F.col("first"))
    n = F.length("word")
    return both.select("word", "english", txt.length_bucket(n).alias("bucket"), txt.looks_native(F.col("word")).alias("native"), F.round(txt.letter_overlap(F.col("word"), F.col("english")), 6).alias("overlap"), F.levenshtein("word", "english", 3).alias("distance"))


def short_texts(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("item_id", "cue_idx", fuse.utf8_truncate(F.col("text"), 20).alias("short"))


def subtitle_trim(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    cut = subtitles.trim_to_clips(scored.cues.marked, materialize(_planned(spark, d, scored)))
    return cut.select("item_id", "clip_index", "cue_idx", *_r("start_sec", "end_sec"), "text")


def candidate_lines(spark: SparkSession, d: str) -> DataFrame:
    return planning.candidate_lines(_candidates(_scored(spark, d)))


def captions_json_fields(spark: SparkSession, d: str) -> DataFrame:
    """What captions_json holds, read back."""
    doc = F.from_json("json", "struct<lang: string, mode: string, weight: double, candidates: array<struct<hook: string, score: double>>>")
    rows = captions_json(spark, d).select("item_id", doc.alias("j"))
    return rows.select("item_id", "j.lang", "j.mode", "j.weight", F.size("j.candidates").alias("n"), F.get("j.candidates", 0)["hook"].alias("hook"))


QUERIES = {
    f.__name__: f
    for f in (
        cues_clean, caption_usable, cue_lines, cue_dedupe, cue_normalised, marker_hits, numeric_payloads, shingles, position_prior, shingle_df, cold_open_echo, cold_open_documents, forward_windows, four_beat, promo_mask,
        caption_envelope, caption_nms, captions_json, profile_fusion, profile_mode, profile_mode_heatmap, clip_adoption, clip_hooks, clip_snap, subtitle_split, subtitle_chain, subtitle_files,
        caption_choice, script_detect, script_route, romanise_sound, romanise, loanwords, english_words, fuzzy_parts, fuzzy_recover, short_texts, subtitle_trim, candidate_lines, captions_json_fields,
    )
}


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CUES = """cu AS (SELECT item_id, cue_idx, min(s).start_ms AS start_ms, min(s).end_ms AS end_ms, min(s).text AS text FROM (SELECT *, {'start_ms': start_ms, 'end_ms': end_ms, 'text': text} AS s FROM (
  SELECT CAST(caption_id AS VARCHAR) AS item_id, cue_idx, CAST(round(start_sec * 1000) AS BIGINT) AS start_ms, CAST(round(end_sec * 1000) AS BIGINT) AS end_ms, coalesce(text, '') AS text FROM caption_cues) WHERE start_ms >= 0 AND end_ms > start_ms AND item_id IS NOT NULL AND cue_idx IS NOT NULL) GROUP BY 1, 2),
it AS (SELECT item_id, max(end_ms) AS duration_ms FROM cu GROUP BY 1 HAVING count(*) >= 10)"""
_LEX = "lx AS (SELECT * FROM (VALUES " + ", ".join(f"({_quote(p)}, '{r}', {w}, '{s}')" for p, r, w, s in DEFAULT_MARKERS) + ") v(p, r, w, s))"
_UNITS = "[" + ", ".join(map(_quote, MAGNITUDES)) + "]"
_MARKED = f"""{_CUES}, {_LEX},
nm AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ०१२३४५६७८९', 'abcdefghijklmnopqrstuvwxyz0123456789') AS norm FROM cu),
dg AS (SELECT item_id, cue_idx, norm, unnest(range(1, length(norm) + 1)) AS i FROM nm WHERE regexp_matches(norm, '[0-9]')),
nu AS (SELECT item_id, cue_idx, count(*) AS numeric FROM (SELECT *, length(regexp_extract(substr(norm, i), '^[0-9]+')) AS len FROM dg WHERE regexp_matches(substr(norm, i, 1), '[0-9]') AND (i = 1 OR NOT regexp_matches(substr(norm, i - 1, 1), '[0-9]')))
  WHERE len(list_filter({_UNITS}, lambda u: contains(substr(norm, greatest(1, i - 30), len + 30 + least(30, i - 1)), u))) > 0 GROUP BY 1, 2),
mk AS (SELECT nm.*, coalesce(pre, 0) AS pre, coalesce(payload, 0) AS payload, coalesce(trail, 0) AS trail, coalesce(negative, false) AS negative, signals, coalesce(numeric, 0) AS numeric FROM nm
  LEFT JOIN (SELECT item_id, cue_idx, sum(CASE WHEN r = 'pre' THEN w ELSE 0 END) AS pre, sum(CASE WHEN r = 'payload' THEN w ELSE 0 END) AS payload, sum(CASE WHEN r = 'trailing' THEN w ELSE 0 END) AS trail, bool_or(r = 'negative') AS negative, string_agg(DISTINCT s, ',' ORDER BY s) AS signals FROM nm JOIN lx ON contains(norm, p) GROUP BY 1, 2) h USING (item_id, cue_idx)
  LEFT JOIN nu USING (item_id, cue_idx))"""
_SHINGLES = """tk AS (SELECT item_id, cue_idx, start_ms, list_filter(string_split(norm, ' '), lambda x: x <> '') AS w FROM mk),
sh AS (SELECT DISTINCT item_id, cue_idx, start_ms, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tk WHERE len(w) >= 5)),
df AS (SELECT item_id, shingle, count(*) AS df, min(start_ms) AS first FROM sh GROUP BY 1, 2),
ec AS (SELECT DISTINCT sh.item_id, sh.cue_idx FROM sh JOIN df USING (item_id, shingle) JOIN it USING (item_id) WHERE duration_ms > 480000 AND df <= 3 AND first < 180000 AND start_ms >= 240000)"""
_WINDOWS = f"""{_MARKED}, {_SHINGLES},
c AS (SELECT mk.*, duration_ms, ec.cue_idx IS NOT NULL AS echo FROM mk JOIN it USING (item_id) LEFT JOIN ec USING (item_id, cue_idx)),
fr AS (SELECT a.item_id, a.cue_idx, a.start_ms, a.duration_ms, b.cue_idx AS j, b.start_ms AS t, b.end_ms AS e, b.start_ms - a.start_ms AS since, b.pre, b.payload, b.trail, b.numeric, b.echo FROM c a JOIN c b ON a.item_id = b.item_id AND b.start_ms >= a.start_ms AND b.start_ms < a.start_ms + 45000 AND (b.start_ms > a.start_ms OR b.cue_idx >= a.cue_idx) WHERE a.start_ms + 15000 <= a.duration_ms),
nt AS (SELECT item_id, cue_idx, bool_or(numeric > 1 OR t - before <= 15000) AS pair FROM (SELECT *, lag(t) OVER (PARTITION BY item_id, cue_idx ORDER BY t, j) AS before FROM fr WHERE numeric > 0) GROUP BY 1, 2),
w0 AS (SELECT item_id, cue_idx, any_value(start_ms) AS start_ms, any_value(duration_ms) AS duration_ms, sum(CASE WHEN since < 24750 THEN pre ELSE 0 END) AS pre, sum(2 * numeric + payload) AS payload, sum(CASE WHEN since > 24750 THEN trail ELSE 0 END) AS trail, bool_or(echo) AS cold,
  min(CASE WHEN pre > 0 AND since < 24750 THEN t END) AS fp, min(CASE WHEN numeric > 0 OR payload > 0 THEN t END) AS fy, min(CASE WHEN echo THEN t END) AS fe, max(CASE WHEN trail > 0 AND since > 24750 THEN t END) AS lt, arg_max(e, t * 100000 + j) AS last_end,
  arg_min(j, CASE WHEN pre > 0 AND since < 24750 THEN -pre * 1e15 + t * 1e5 + j END) AS hook_pre, arg_max(j, CASE WHEN numeric > 0 THEN t * 100000 + j END) AS hook_num FROM fr GROUP BY 1, 2),
ng AS (SELECT DISTINCT a.item_id, a.cue_idx FROM c a JOIN c b ON a.item_id = b.item_id AND b.negative AND a.start_ms < b.start_ms + 30000 AND a.start_ms + 45000 > b.start_ms - 5000),
w1 AS (SELECT w0.*, coalesce(pair, false) AS pair, ng.cue_idx IS NOT NULL AS masked, coalesce(fp <= fy AND lt > fy, false) AS four_beat, coalesce(hook_pre, hook_num, w0.cue_idx) AS hook_idx, greatest(start_ms, least(fp, fy, fe)) AS b, least(last_end, start_ms + 53000) AS e0 FROM w0 LEFT JOIN nt USING (item_id, cue_idx) LEFT JOIN ng USING (item_id, cue_idx)),
w2 AS (SELECT *, CASE WHEN e0 - b < 25000 THEN least(duration_ms, b + 30000) ELSE e0 END AS e FROM w1),
w3 AS (SELECT *, 100.0::DOUBLE * ((b + e) / 2.0::DOUBLE) / duration_ms AS pct, CASE WHEN masked THEN 0 ELSE (pre + payload + CASE WHEN pair THEN 3 ELSE 0 END + trail + CASE WHEN cold THEN 4 ELSE 0 END)::DOUBLE * CASE WHEN four_beat THEN 1.3::DOUBLE ELSE 1 END END AS raw FROM w2),
w AS (SELECT *, raw * CASE WHEN pct < 10 THEN 1.0::DOUBLE WHEN pct < 30 THEN 0.85::DOUBLE WHEN pct < 60 THEN 1.1::DOUBLE WHEN pct < 90 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS score, b / 1000.0::DOUBLE AS start_sec, e / 1000.0::DOUBLE AS end_sec FROM w3)"""
_ENVELOPE = f"""{_WINDOWS},
tp AS (SELECT item_id, max(score) AS top, any_value(duration_ms) / 1000.0::DOUBLE AS duration FROM w GROUP BY 1),
gb AS (SELECT item_id, bin, top, (bin + 0.5::DOUBLE) * (duration / 100) AS centre FROM tp CROSS JOIN (SELECT unnest(range(100))::INTEGER AS bin)),
en AS (SELECT gb.item_id, bin, CASE WHEN any_value(top) > 0 THEN coalesce(max(score), 0) / any_value(top) ELSE 0 END AS value FROM gb LEFT JOIN w ON w.item_id = gb.item_id AND score > 0 AND centre >= start_sec AND centre <= end_sec GROUP BY 1, 2)"""
_NMS = f"""{_WINDOWS},
rk AS (SELECT *, (start_sec + end_sec) / 2 AS mid, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, start_ms, cue_idx) AS rn FROM w WHERE score > 0),
gr AS (SELECT DISTINCT item_id, 0::BIGINT AS rn, []::DOUBLE[] AS kept, []::BIGINT[] AS rns FROM rk
  UNION ALL SELECT rk.item_id, rk.rn, CASE WHEN ok THEN list_append(kept, mid) ELSE kept END, CASE WHEN ok THEN list_append(rns, rk.rn) ELSE rns END FROM (
    SELECT rk.item_id, rk.rn, rk.mid, g.kept, g.rns, len(g.kept) < 12 AND len(list_filter(g.kept, lambda x: abs(x - rk.mid) < 45)) = 0 AS ok FROM gr g JOIN rk ON rk.item_id = g.item_id AND rk.rn = g.rn + 1) rk),
fin AS (SELECT item_id, arg_max(rns, rn) AS rns FROM gr GROUP BY 1),
cd AS (SELECT rk.*, CAST(list_position(rns, rn) AS INTEGER) AS rank FROM rk JOIN fin USING (item_id) WHERE list_contains(rns, rn))"""
_DURATIONS = f"WITH {_CUES}"

_HEAT = f"""{profiles._VALID},
hv AS (SELECT json_extract_string(body, '$.id') AS video_id, arg_min(record_id, record_id) AS record_id FROM j WHERE n = 100 AND json_extract_string(body, '$.id') <> '' GROUP BY 1),
hj AS (SELECT video_id, {profiles._NUM.format("body, '$.duration'")} AS dur, {profiles._NUM.format("body, '$.heatmap[0].end_time'")} - {profiles._NUM.format("body, '$.heatmap[0].start_time'")} AS width, CAST(json_extract(body, '$.heatmap') AS JSON[]) AS xs FROM j JOIN hv USING (record_id)),
hu AS (SELECT video_id, CASE WHEN width > 0 THEN width WHEN dur > 0 THEN dur / 100 ELSE width END AS bin_s, unnest(xs) AS x, (generate_subscripts(xs, 1) - 1)::INTEGER AS bin FROM hj),
ht AS (SELECT DISTINCT CAST(caption_id AS VARCHAR) AS item_id, bin, bin_s, {profiles._NUM.format("x, '$.value'")} AS value FROM caption_docs JOIN hu USING (video_id)),
du AS (SELECT item_id, max(end_ms) / 1000.0::DOUBLE AS duration FROM cu GROUP BY 1),
fu AS (SELECT du.item_id, duration, g.bin, coalesce(ht.bin_s, duration / 100) AS bin_s, CASE WHEN ht.value IS NOT NULL AND en.value IS NOT NULL THEN 0.6::DOUBLE * ht.value + 0.4::DOUBLE * en.value ELSE coalesce(ht.value, en.value) END AS value,
  CASE WHEN ht.value IS NOT NULL AND en.value IS NOT NULL THEN 'fused' WHEN ht.value IS NOT NULL THEN 'off' WHEN en.value IS NOT NULL THEN 'caption-only' ELSE 'rejected' END AS mode
  FROM du CROSS JOIN (SELECT unnest(range(100))::INTEGER AS bin) g LEFT JOIN ht ON ht.item_id = du.item_id AND ht.bin = g.bin LEFT JOIN en ON en.item_id = du.item_id AND en.bin = g.bin),
prof AS (SELECT item_id, bin, value, duration, bin_s FROM fu WHERE mode <> 'rejected')"""
_FUSED = f"{_ENVELOPE}, {_HEAT}"
# both chains name some steps alike
_CLIPS = re.sub(r"\b(mk|sm|st|sc|rk|gr|fin|w[0-3])\b", r"p_\1", profiles._CHAIN + profiles._GREEDY.format(**profiles._AUTO))
_ADOPTED = f"""{_NMS}, {_FUSED.removeprefix(_WINDOWS + ",")}{_CLIPS},
ov AS (SELECT cl.item_id, cl.clip_index, arg_min(cd.start_sec, cd.rank) AS cs, arg_min(cd.end_sec, cd.rank) AS ce FROM cl JOIN cd ON cd.item_id = cl.item_id AND cd.start_sec < cl.end_sec AND cd.end_sec > cl.start_sec GROUP BY 1, 2),
ad AS (SELECT item_id, clip_index, coalesce(cs, start_sec) AS start_sec, coalesce(greatest(ce, cs + 30), end_sec) AS end_sec FROM cl LEFT JOIN ov USING (item_id, clip_index))"""

ORACLES = {
    "profile_mode": f"WITH {_FUSED} SELECT DISTINCT item_id, mode FROM fu",
    "profile_fusion": f"WITH {_FUSED} SELECT item_id, bin, round(value, 6) AS value FROM fu WHERE mode = 'fused'",
    "clip_adoption": f"WITH RECURSIVE {_ADOPTED} SELECT item_id, clip_index, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec FROM ad",
    "clip_snap": f"""WITH RECURSIVE {_ADOPTED}, q AS (SELECT item_id, cue_idx, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e FROM cu),
a AS (SELECT ad.item_id, clip_index, min(s) AS s FROM ad JOIN q ON q.item_id = ad.item_id AND s <= start_sec AND start_sec - s <= 3 GROUP BY 1, 2),
z AS (SELECT ad.item_id, clip_index, arg_max(e, s * 1000000 + cue_idx) AS e FROM ad JOIN q ON q.item_id = ad.item_id AND s <= end_sec AND e >= end_sec AND e - end_sec <= 3 GROUP BY 1, 2)
SELECT item_id, clip_index, round(coalesce(s, start_sec), 6) AS start_sec, round(coalesce(e, end_sec), 6) AS end_sec FROM ad LEFT JOIN a USING (item_id, clip_index) LEFT JOIN z USING (item_id, clip_index)""",
    "cue_lines": "WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT item_id, w, unnest(range((len(w) + 7) // 8)) AS i FROM t WHERE len(w) > 0) SELECT item_id, CAST(i AS INTEGER) AS cue_idx, i * 4.0::DOUBLE AS start_sec, array_to_string(w[i * 8 + 1:i * 8 + 8], ' ') AS text FROM c",
    "cues_clean": f"WITH {_CUES} SELECT * FROM cu",
    "caption_usable": f"WITH {_CUES} SELECT * FROM it",
    "cue_normalised": f"WITH {_MARKED} SELECT item_id, cue_idx, norm FROM mk",
    "marker_hits": f"WITH {_MARKED} SELECT item_id, cue_idx, CAST(pre AS INTEGER) AS pre, CAST(payload AS INTEGER) AS payload, CAST(trail AS INTEGER) AS \"trailing\", negative, signals FROM mk WHERE signals IS NOT NULL",
    "numeric_payloads": f"WITH {_MARKED} SELECT item_id, cue_idx, CAST(numeric AS INTEGER) AS numeric FROM mk WHERE numeric > 0",
    "shingles": f"WITH {_MARKED}, {_SHINGLES} SELECT item_id, cue_idx, shingle FROM sh",
    "position_prior": f"WITH {_CUES}, p AS (SELECT item_id, cue_idx, 100.0::DOUBLE * ((start_ms + end_ms) / 2.0::DOUBLE) / duration_ms AS pct FROM cu JOIN it USING (item_id)) SELECT item_id, cue_idx, CASE WHEN pct < 10 THEN 1.0 WHEN pct < 30 THEN 0.85 WHEN pct < 60 THEN 1.1 WHEN pct < 90 THEN 1.15 ELSE 1.0 END::DOUBLE AS prior FROM p",
    "shingle_df": f"WITH {_MARKED}, {_SHINGLES} SELECT item_id, shingle, df FROM df",
    "cold_open_echo": f"WITH {_MARKED}, {_SHINGLES} SELECT item_id, cue_idx FROM ec",
    "forward_windows": f"WITH {_WINDOWS} SELECT item_id, cue_idx, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, round(score, 6) AS score, four_beat, masked, hook_idx FROM w",
    "four_beat": f"WITH {_WINDOWS} SELECT item_id, cue_idx FROM w WHERE four_beat",
    "promo_mask": f"WITH {_WINDOWS} SELECT item_id, cue_idx FROM w WHERE masked",
    "caption_envelope": f"WITH {_ENVELOPE} SELECT item_id, bin, round(value, 6) AS value FROM en",
    "caption_nms": f"WITH RECURSIVE {_NMS} SELECT item_id, rank, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, round(score, 6) AS score FROM cd",
    "subtitle_split": f"""WITH {_CUES}, t AS (SELECT item_id, cue_idx, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]'), lambda x: x <> '') AS w FROM cu),
n AS (SELECT *, len(w) AS n, CAST(ceil(len(w) / 4.0) AS BIGINT) AS parts FROM t WHERE len(w) > 0), p AS (SELECT *, unnest(range(parts)) AS i FROM n), q AS (SELECT *, n // parts AS base, n % parts AS extra FROM p)
SELECT item_id, cue_idx, CAST(i AS INTEGER) AS part, round(s + (e - s) * i / parts, 6) AS start_sec, round(s + (e - s) * (i + 1) / parts, 6) AS end_sec, array_to_string(w[i * base + least(i, extra) + 1: i * base + least(i, extra) + base + CASE WHEN i < extra THEN 1 ELSE 0 END], ' ') AS text FROM q""",
    "subtitle_chain": f"WITH {_CUES}, x AS (SELECT *, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY item_id ORDER BY start_ms, cue_idx), end_ms)) AS e FROM cu) SELECT item_id, cue_idx, round(start_ms / 1000.0::DOUBLE, 6) AS start_sec, round(e / 1000.0::DOUBLE, 6) AS end_sec FROM x WHERE e > start_ms",
    "caption_choice": """WITH v AS (SELECT video_id AS item_id, min(language) AS wanted FROM videos WHERE video_id IS NOT NULL GROUP BY 1),
o AS (SELECT item_id, CASE WHEN coalesce(wanted, '') <> '' AND NOT starts_with('en,hi', wanted) THEN [wanted, 'en', 'hi'] ELSE ['en', 'hi'] END AS langs FROM v),
a AS (SELECT DISTINCT video_id AS item_id, lang, CAST(caption_id AS VARCHAR) AS path FROM caption_docs),
r AS (SELECT a.*, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(list_position(langs, lang), 1000000), path, lang NULLS FIRST) AS n FROM a LEFT JOIN o USING (item_id)) SELECT item_id, lang, path FROM r WHERE n = 1""",
    "script_detect": f"WITH {_CUES}, n AS (SELECT item_id, cue_idx, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(text, '[؀-ۿݐ-ݿﭐ-﷿ﹰ-\\x{{FEFF}}]')) AS a FROM cu) SELECT item_id, cue_idx, CASE WHEN d = 0 AND a = 0 THEN 0 WHEN d >= a THEN 1 ELSE 2 END AS script FROM n",
}

# the longest start of a text that fits, without a multi-byte character that reaches the cut
_CUT = "left({0}, list_max(list_filter(range({1} + 1), lambda k: strlen(left({0}, k)) <= {1} AND NOT (strlen(left({0}, k)) = {1} AND k > 0 AND strlen(substr({0}, k, 1)) > 1)))::BIGINT)"
_SHORT = lambda text, most: f"CASE WHEN strlen({text}) <= {most} THEN {text} ELSE {_CUT.format(text, most)} END"
_HMS = profiles._HMS
_ENGLISH = f"""ew AS (SELECT english, CAST(row_number() OVER (ORDER BY n DESC, english) - 1 AS INTEGER) AS rank FROM (
  SELECT w AS english, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM (SELECT text FROM lang_samples WHERE lang = 'en' UNION ALL SELECT text FROM graded_samples WHERE lang = 'en'))
  WHERE regexp_full_match(w, '[a-z]{{4,16}}') AND w NOT IN ({', '.join(map(_quote, NO_ENGLISH))}) GROUP BY 1)),
en0 AS (SELECT english, left(english, 1) AS first, CAST(CASE WHEN length(english) < 4 THEN 0 ELSE least(4, (length(english) - 4) // 2) END AS INTEGER) AS bucket, rank FROM ew WHERE rank < 3000)"""
_WORDS = "wd AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM cu) WHERE w <> '')"
_NATIVE = f"(regexp_matches(word, '[aeiou]$') AND NOT regexp_matches(word, '{'|'.join(txt.CLUSTERS)}'))"
_OVERLAP = "len(list_filter(string_split(word, ''), lambda c: contains(english, c)))::DOUBLE / length(word)"
_BUCKET = "CASE WHEN length(word) < 4 THEN 0 ELSE least(4, (length(word) - 4) // 2) END"
_VTT = r"""v0 AS (SELECT CAST(caption_id AS VARCHAR) AS item_id, cue_idx, min({'s': start_sec, 'e': end_sec, 't': text}) AS c FROM caption_cues WHERE start_sec >= 0 AND end_sec > start_sec AND text IS NOT NULL AND caption_id IS NOT NULL AND cue_idx IS NOT NULL GROUP BY 1, 2),
v1 AS (SELECT item_id, cue_idx, floor(c.s) + CAST(round(c.s * 1000) AS BIGINT) % 1000 / 1000.0::DOUBLE AS start_sec, floor(c.e) + CAST(round(c.e * 1000) AS BIGINT) % 1000 / 1000.0::DOUBLE AS end_sec, string_split(replace(c.t, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM v0),
v2 AS (SELECT item_id, cue_idx, start_sec, end_sec, unnest(ls) AS raw, generate_subscripts(ls, 1) AS k FROM v1),
v3 AS (SELECT *, trim(regexp_replace(replace(regexp_replace(raw, '<[^>]*(>|$)', '', 'g'), '>', ''), '[ \t\r]+', ' ', 'g'), ' ') AS text FROM v2),
v4 AS (SELECT *, lag(text) OVER (PARTITION BY item_id ORDER BY cue_idx, k) AS before FROM v3 WHERE text <> '' AND NOT regexp_matches(text, '^(WEBVTT|Kind:|Language:|NOTE|STYLE|Style:|Region:)'))"""

ORACLES |= {
    "cue_dedupe": f"WITH {_VTT} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY cue_idx, k) - 1 AS INTEGER) AS cue_idx, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, text FROM v4 WHERE text IS DISTINCT FROM before",
    "clip_hooks": f"WITH RECURSIVE {_ADOPTED}, hk AS (SELECT cl.item_id, cl.clip_index, arg_min(cd.hook_idx, cd.rank) AS hook_idx FROM cl JOIN cd ON cd.item_id = cl.item_id AND cd.start_sec < cl.end_sec AND cd.end_sec > cl.start_sec GROUP BY 1, 2), tx AS (SELECT cl.item_id, cl.clip_index, coalesce(cu.text, '') AS t FROM cl LEFT JOIN hk USING (item_id, clip_index) LEFT JOIN cu ON cu.item_id = hk.item_id AND cu.cue_idx = hk.hook_idx) SELECT item_id, clip_index, {_SHORT('t', 80)} AS label FROM tx",
    "short_texts": f"WITH {_CUES} SELECT item_id, cue_idx, {_SHORT('text', 20)} AS short FROM cu",
    "english_words": f"WITH {_ENGLISH} SELECT english, first, bucket, rank FROM en0",
    "fuzzy_parts": f"WITH {_CUES}, {_ENGLISH}, {_WORDS}, hd AS (SELECT first, arg_min(english, rank) AS english FROM en0 GROUP BY 1) SELECT word, english, CAST({_BUCKET} AS INTEGER) AS bucket, {_NATIVE} AS native, round({_OVERLAP}, 6) AS overlap, CAST(CASE WHEN levenshtein(word, english) <= 3 THEN levenshtein(word, english) ELSE -1 END AS INTEGER) AS distance FROM wd JOIN hd ON left(word, 1) = first",
    "fuzzy_recover": f"""WITH {_CUES}, {_ENGLISH}, {_WORDS}, ok AS (SELECT word, {_BUCKET} AS b FROM wd WHERE length(word) >= 5 AND NOT {_NATIVE} AND word NOT IN ({', '.join(map(_quote, sorted(txt.NATIVE)))})),
p AS (SELECT word, english, first, bucket, rank, levenshtein(word, english) AS d FROM ok JOIN en0 ON abs(bucket - b) <= 1 AND (left(word, 1) = first OR (contains('aeiou', left(word, 1)) AND contains('aeiou', first))))
SELECT word, arg_min(english, d * 1e9 + ascii(first) * 1e6 + bucket * 1e5 + rank) AS english FROM p WHERE d <= CASE WHEN length(word) >= 8 THEN 3 ELSE 2 END AND {_OVERLAP} >= 0.65 GROUP BY 1""",
    "loanwords": f"WITH {_CUES}, lw AS (SELECT * FROM (VALUES {', '.join(f'({_quote(a)}, {_quote(b)})' for a, b in LOANWORDS)}) v(run, eng)), rn AS (SELECT item_id, cue_idx, regexp_extract_all(text, '[ऀ-ॿ]+') AS rs FROM cu), ex AS (SELECT item_id, cue_idx, unnest(rs) AS run, CAST(generate_subscripts(rs, 1) - 1 AS INTEGER) AS pos FROM rn) SELECT item_id, cue_idx, pos, run, eng FROM ex JOIN lw USING (run)",
    "script_route": f"WITH {_CUES}, lg AS (SELECT CAST(caption_id AS VARCHAR) AS item_id, coalesce(min(lang), '') AS lang FROM caption_docs GROUP BY 1), n AS (SELECT cu.*, coalesce(lang, '') AS lang, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(text, '[؀-ۿݐ-ݿﭐ-﷿ﹰ-\\x{{FEFF}}]')) AS a FROM cu LEFT JOIN lg USING (item_id)) SELECT item_id, cue_idx, CAST(CASE WHEN starts_with(lang, 'en') THEN 0 WHEN regexp_matches(lang, '^(hi|mr|ne)') THEN 1 WHEN regexp_matches(lang, '^(ur|ar|fa)') THEN 2 WHEN d = 0 AND a = 0 THEN 0 WHEN d >= a THEN 1 ELSE 2 END AS INTEGER) AS script FROM n",
    "subtitle_trim": f"WITH RECURSIVE {_ADOPTED}, q AS (SELECT item_id, cue_idx, text, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e FROM cu), x AS (SELECT cl.item_id, clip_index, cue_idx, greatest(s, start_sec) - start_sec AS a, least(e, end_sec) - start_sec AS b, text FROM cl JOIN q ON q.item_id = cl.item_id AND s < end_sec AND e > start_sec) SELECT item_id, clip_index, cue_idx, round(a, 6) AS start_sec, round(b, 6) AS end_sec, text FROM x WHERE b > a",
    "captions_json_fields": f"WITH RECURSIVE {_NMS}, {_FUSED.removeprefix(_WINDOWS + ',')}, md AS (SELECT DISTINCT item_id, mode FROM fu WHERE mode IN ('fused', 'caption-only')), lg AS (SELECT CAST(caption_id AS VARCHAR) AS item_id, min(lang) AS lang FROM caption_docs GROUP BY 1), ct AS (SELECT cd.item_id, count(*) AS n, arg_min(cu.text, cd.rank) AS hook FROM cd LEFT JOIN cu ON cu.item_id = cd.item_id AND cu.cue_idx = cd.hook_idx GROUP BY 1) SELECT md.item_id, coalesce(lang, '') AS lang, mode, 0.4::DOUBLE AS weight, CAST(coalesce(n, 0) AS INTEGER) AS n, hook FROM md LEFT JOIN lg USING (item_id) LEFT JOIN ct USING (item_id)",
    "profile_mode_heatmap": f"WITH {_CUES}, {_HEAT.split('fu AS (')[0].rstrip().rstrip(',')} SELECT DISTINCT du.item_id, CASE WHEN ht.item_id IS NULL THEN 'rejected' ELSE 'off' END AS mode FROM du LEFT JOIN ht USING (item_id)",
}

# at most 72 bytes; what is left of a character that was cut shows as one replacement
_HEAD = "CASE WHEN strlen(t) <= 72 THEN t ELSE left(t, k) || CASE WHEN strlen(left(t, k)) < 72 THEN '�' ELSE '' END END"
_DOC_CUES = """dw AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), dc AS (SELECT item_id, w, unnest(range((len(w) + 7) // 8)) AS i FROM dw WHERE len(w) > 0),
cu AS (SELECT item_id, CAST(i AS INTEGER) AS cue_idx, i * 4000 AS start_ms, i * 4000 + 3500 AS end_ms, array_to_string(w[i * 8 + 1:i * 8 + 8], ' ') AS text FROM dc),
it AS (SELECT item_id, max(end_ms) AS duration_ms FROM cu GROUP BY 1 HAVING count(*) >= 10),
mk AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ०१२३४५६७८९', 'abcdefghijklmnopqrstuvwxyz0123456789') AS norm FROM cu)"""

ORACLES |= {
    "candidate_lines": f"WITH RECURSIVE {_NMS}, x AS (SELECT cd.*, coalesce(cu.text, '') AS t FROM cd LEFT JOIN cu ON cu.item_id = cd.item_id AND cu.cue_idx = cd.hook_idx), y AS (SELECT *, list_max(list_filter(range(73), lambda i: strlen(left(t, i)) <= 72)) AS k FROM x) SELECT item_id, rank, printf('%-3d  %-10s  %-10s  %-7.1f  %-4s  %-4s  %s', rank, {_HMS.format('start_sec')}, {_HMS.format('end_sec')}, score, CASE WHEN four_beat THEN 'yes' ELSE '-' END, CASE WHEN cold THEN 'yes' ELSE '-' END, {_HEAD}) AS line FROM y",
    "cold_open_documents": f"WITH {_DOC_CUES}, {_SHINGLES} SELECT item_id, cue_idx FROM ec",
}
