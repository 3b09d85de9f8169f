"""Expected values of fixture profiles, caption documents and texts."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spanwise.config import DetectConfig, PlanConfig
from spanwise.functions import scalars, text
from spanwise.operators import captions, fuse, planning, profile, subtitles
from spanwise.sources import info_json, vtt

PROFILE = "item_id string, duration double, bin_seconds double, vals array<double>"


def base(value, over, bin_s, duration, name="x"):
    vals = [float(value)] * 100
    for k, v in over.items():
        vals[k] = float(v)
    return name, float(duration), float(bin_s), vals


# (case, base value, overrides, bin seconds, duration, regions, clips)
CASES = [
    ("zero", 0, {}, 12, 1200, [], []),
    ("all one", 1, {}, 12, 1200, [(1, 99, 1, 1, 606)], [(586, 626)]),
    # sums run in bin order, so the deviation is 1e-15 rather than 0 and lifts the threshold above the
    # constant value; with compensated sums there would be one region over all bins
    ("flat", 0.65, {}, 2.8, 280, [], []),
    ("spike", 0.02, {42: 1}, 12, 1200, [(41, 43, 0.51, 42, 510)], [(490, 530)]),
    ("tied", 0.05, {50: 0.9, 51: 0.9, 52: 0.9}, 12, 1200, [(49, 53, 0.9, 51, 618)], None),
    ("dip", 0.05, {40: 0.9, 41: 0.6, 42: 0.9}, 12, 1200, [(39, 43, 0.75, 41, 498)], None),
    ("coarse", 0.10, {45: 0.85}, 90, 9000, [(45, 45, 0.85, 45, 4095)], [(4050, 4140)]),
    ("end", 0.05, {98: 0.9, 99: 1}, 12, 1200, [(97, 99, 1, 99, 1186.481)], [(1160, 1200)]),
    ("clamp", 0.05, {98: 0.9, 99: 1}, 30, 3000, [(97, 99, 1, 99, 2966.2025)], [(2943.703, 2988.703)]),
    ("gap", 0.05, {20: 1, 22: 0.9, 60: 0.85}, 30, 3000, [(19, 23, 0.525, 20, 643.5366), (59, 61, 0.45, 60, 1815)], None),
    ("far", 0.05, {10: 0.9, 80: 0.85}, 108, 10800, [(10, 10, 0.9, 10, 1134), (80, 80, 0.85, 80, 8694)], None),
    ("short", 0.10, dict(zip(range(71, 79), (0.55, 0.7, 0.85, 0.95, 1, 0.9, 0.8, 0.7), strict=True)), 1.8, 180, [(71, 79, 0.9625, 75, 135.512)], [(0, 180)]),
    ("four minutes", 0.10, dict(zip(range(71, 79), (0.55, 0.7, 0.85, 0.95, 1, 0.9, 0.8, 0.7), strict=True)), 2.4, 240, [(71, 79, 0.9625, 75, 180.6827)], [(160.683, 200.683)]),
]


def test_profiles(spark):
    df = spark.createDataFrame([base(v, o, b, d, name) for name, v, o, b, d, _, _ in CASES], PROFILE)
    det = profile.detect(df).cache()
    got = {r["item_id"]: r for r in det.collect()}
    clips: dict = {}
    for r in planning.plan(det).orderBy("item_id", "clip_index").collect():
        clips.setdefault(r["item_id"], []).append((r["start_sec"], r["end_sec"]))
    for name, *_, regions, want in CASES:
        found = [(r["start_bin"], r["end_bin"], r["peak_score"], r["peak_bin"], r["centroid"]) for r in got[name]["regions"]]
        assert len(found) == len(regions), name
        for a, b in zip(found, regions, strict=True):
            assert a == pytest.approx(b, abs=1e-3), name
        if want is not None:
            assert [x for c in clips.get(name, []) for x in c] == pytest.approx([x for c in want for x in c], abs=1e-3), name
    assert got["flat"]["flat"] and got["all one"]["flat"] and got["zero"]["flat"] and not got["spike"]["flat"]
    assert planning.plan(det, PlanConfig(strict=True)).filter("item_id = 'all one'").count() == 0


def test_keep_intro_and_odd_profiles(spark):
    rows = [base(0.05, {0: 1, 1: 0.9, 2: 0.5}, 12, 1200), ("null", 10.0, 0.1, None), ("few", 10.0, 1.0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, PROFILE)
    got = {r["item_id"]: r["regions"] for r in profile.detect(df, DetectConfig(keep_intro=True)).collect()}
    r = got["x"][0]
    assert (r["start_bin"], r["end_bin"], r["peak_score"], r["peak_bin"]) == (0, 2, 1.0, 0)
    assert r["centroid"] == pytest.approx(15.3405, abs=1e-3)
    assert got["null"] == [] and got["few"] == []
    assert planning.plan(profile.detect(df.filter("false"))).collect() == []


def doc(over, n, name):
    return [(name, i, 4.0 * i, 4.0 * i + 3.5, over.get(4 * i, "this is filler speech about nothing much")) for i in range(n)]


def test_caption_scores(spark):
    rows = doc({300: "main aapko batata hoon ek baat", 312: "unhone 50 lakh rupees kamaye aur 2 crore gawaye", 336: "wow this is wild"}, 150, "beat")
    rows += doc({300: "मैं आपको बताता हूं", 312: "५० लाख"}, 150, "deva")
    rows += doc({300: "use code now for a discount from our sponsor", 308: "50 lakh 20 crore 10 percent"}, 150, "promo")
    line = "one two three four five six seven eight nine ten"
    rows += doc({20: line, 800: line}, 300, "cold")
    rows += [("few", 0, 0.0, 3.5, "wow")]
    cues = spark.createDataFrame(rows, "item_id string, cue_idx int, start_sec double, end_sec double, text string")
    dur = spark.createDataFrame([("beat", 600.0), ("deva", 600.0), ("promo", 600.0), ("cold", 1200.0), ("few", 600.0)], "item_id string, duration double")
    windows = captions.score_windows(cues, dur).cache()
    cands = captions.with_hooks(captions.candidates(windows), captions.clean_cues(cues)).orderBy("item_id", "rank").collect()
    top = {r["item_id"]: r for r in reversed(cands)}
    assert top["beat"]["score"] == pytest.approx(20.02) and top["beat"]["four_beat"]
    assert (top["beat"]["start_sec"], top["beat"]["end_sec"]) == (300.0, 339.5)
    assert top["beat"]["hook_text"].startswith("main aapko")
    assert top["deva"]["score"] == pytest.approx(5.5) and top["deva"]["start_sec"] == 300.0
    # the promo's span ends half a minute after it; no candidate opens within it
    assert not [r for r in cands if r["item_id"] == "promo" and r["start_sec"] < 310 and r["end_sec"] > 300]
    cold = [r for r in cands if r["item_id"] == "cold" and r["cold_open_match"]]
    assert cold and cold[0]["start_sec"] == 800.0 and cold[0]["end_sec"] == 830.0 and cold[0]["score"] == pytest.approx(4.6)
    assert "few" not in top
    bins = {r["bin"]: r["value"] for r in captions.envelope(windows).filter("item_id = 'beat'").collect()}
    assert len(bins) == 100 and bins[51] > 0.5 and bins[5] == 0


def test_snap_and_adopt(spark):
    cues = captions.clean_cues(spark.createDataFrame(doc({}, 150, "a"), "item_id string, cue_idx int, start_sec double, end_sec double, text string"))
    clip = "item_id string, clip_index int, start_sec double, end_sec double, centroid double, label string"
    clips = spark.createDataFrame([("a", 1, 301.5, 341.0, 320.0, "")], clip)
    r = fuse.snap(clips, cues).collect()[0]
    assert (r["start_sec"], r["end_sec"]) == (300.0, 343.5)
    cand = spark.createDataFrame([("a", 1, 310.0, 320.0, 2.0, "hook"), ("a", 2, 100.0, 200.0, 9.0, "far")], "item_id string, rank int, start_sec double, end_sec double, score double, hook_text string")
    r = fuse.adopt(clips, cand).collect()[0]
    assert (r["start_sec"], r["end_sec"], r["label"]) == (310.0, 340.0, "hook")


def test_modes(spark):
    heat = spark.createDataFrame([("both", 1.0, [1.0] * 100), ("heat", 1.0, [1.0] * 100)], "item_id string, bin_seconds double, vals array<double>")
    cap = spark.createDataFrame([("both", [0.0] * 100), ("cap", [0.5] * 100)], "item_id string, cap array<double>")
    dur = spark.createDataFrame([(x, 100.0) for x in ("both", "heat", "cap", "none")], "item_id string, duration double")
    mode = lambda d, w=0.4: {r["item_id"]: (r["mode"], r["vals"] and round(r["vals"][3], 6)) for r in fuse.choose_profile(heat, cap, dur, d, w).collect()}
    assert mode("fused") == {"both": ("fused", 0.6), "heat": ("off", 1.0), "cap": ("caption-only", 0.5), "none": ("rejected", None)}
    assert mode("fused", 0.0)["both"] == ("fused", 1.0)
    assert mode("heatmap") == {"both": ("off", 1.0), "heat": ("off", 1.0), "cap": ("rejected", None), "none": ("rejected", None)}
    assert mode("captions") == {"both": ("caption-only", 0.0), "heat": ("rejected", None), "cap": ("caption-only", 0.5), "none": ("rejected", None)}


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize("deva, latin", [("पर", "par"), ("दिन", "din"), ("राम", "ram"), ("नमस्ते", "namaste"), ("करेंगे", "karenge"), ("३०", "30"), ("पड़ी", "pari"), ("पड़ी", "pari"), ("मैंने dark web पर 30 दिन बिताए", "mainne dark web par 30 din bitae")])
def test_devanagari(spark, deva, latin):
    assert one(spark, deva, text.devanagari_to_latin) == latin


def test_scripts_and_routing(spark):
    assert [one(spark, t, text.detect_script) for t in ("abc", "राम", "دیکھ", "abc राम")] == [0, 1, 2, 1]
    assert one(spark, "۳۰", text.arabic_to_latin) == "30"
    assert "dikh" in one(spark, "دیکھا", text.arabic_to_latin)
    assert one(spark, "राम", lambda c: text.to_latin(c, F.lit("en-US"))) == "राम"
    assert one(spark, "plain", lambda c: text.to_latin(c, F.lit("hi"))) == "plain"
    assert one(spark, "राम", lambda c: text.to_latin(c, F.lit("xx"))) == "ram"


def english(spark):
    words = "percent parents people activity relevant relevance nation national hotel camera".split()
    return text.english_table(spark.createDataFrame([(w, 100 - i) for i, w in enumerate(words)], "word string, n long"))


@pytest.mark.parametrize("deva, latin", [("यूट्यूब पर", "YouTube par"), ("वीपीएन इस्तेमाल करो", "VPN istemal karo"), ("वीडियो में", "video men"), ("स्ट्रेट", "straight"), ("टेंशन", "tension"), ("इन्वेस्टिगेशन", "investigation")])
def test_loanwords(spark, deva, latin):
    df = spark.createDataFrame([("1", deva, "hi")], "id string, text string, lang string")
    assert text.romanise(df, english(spark), text.loanword_table(spark)).collect()[0]["latin"] == latin


def test_english_table(spark):
    rows = [("the", 50), ("Words", 9), ("words", 3), ("lekin", 99), ("camera", 12), ("abcdefghijklmnopq", 80), ("it's", 70), (None, 60), ("zebra", 1), ("apple", 1)]
    df = spark.createDataFrame(rows, "word string, n long")
    assert [tuple(r) for r in text.english_table(df, 3).orderBy("rank").collect()] == [("camera", "c", 1, 0), ("words", "w", 0, 1), ("apple", "a", 0, 2)]
    assert text.english_table(df.filter("false")).collect() == []


def test_romanise_recovers_english(spark):
    rows = [("1", "एक्टिविटी पेरेंट्स राम", "hi"), ("2", "plain", "hi"), ("3", None, "hi"), ("4", "", None), ("5", "रेलेवेंस", "hi"), ("6", "सीआईए", "hi")]
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    loans = spark.createDataFrame([("सीआईए", "CIA")], "deva string, eng string")
    got = {r["id"]: r["latin"] for r in text.romanise(df, english(spark), loans).collect()}
    assert got["1"] == "activity parents ram" and got["2"] == "plain" and got["3"] is None and got["4"] == ""
    assert got["5"] in ("relevant", "relevance") and got["6"] == "CIA"


def test_split_words(spark):
    from spanwise.config import SubtitleConfig

    def parts(n, cue, line):
        cfg = SubtitleConfig(words_per_cue=cue, words_per_line=line)
        return one(spark, " ".join(f"w{i}" for i in range(n)), lambda c: subtitles.split_words(c, F.lit(0.0), F.lit(4.0), cfg))

    lines = lambda n: [len(x.split()) for x in parts(n, 8, 4)[0]["text"].split("\\N")]
    assert lines(5) == [3, 2] and lines(7) == [4, 3] and lines(8) == [4, 4]
    assert [(p["start_sec"], p["end_sec"]) for p in parts(12, 8, 4)] == [(0.0, 2.0), (2.0, 4.0)]
    assert [len(p["text"].replace("\\N", " ").split()) for p in parts(9, 8, 4)] == [5, 4]
    assert [len(p["text"].split()) for p in parts(7, 4, 4)] == [4, 3]
    assert parts(0, 4, 4) == []


def test_strategy(spark):
    cases = [("a", 1, 60, 3600), ("b", 6, 40, 900), ("c", 6, 60, 6000), ("d", 6, 110, 6309), ("e", 4, 200, 1800), ("f", 4, 60, 0)]
    clips = spark.createDataFrame([(n, i, 0.0, float(s)) for n, k, s, _ in cases for i in range(k)], "item_id string, clip_index int, start_sec double, end_sec double")
    dur = spark.createDataFrame([(n, float(d)) for n, *_, d in cases], "item_id string, duration double")
    got = {r["item_id"]: r["strategy"] for r in planning.strategy(clips, dur).collect()}
    assert got == {"a": "full", "b": "full", "c": "per_clip", "d": "per_clip", "e": "full", "f": "full"}
    assert {r["strategy"] for r in planning.strategy(clips, dur, try_sections=False).collect()} == {"full"}


def test_info_json(spark):
    bins = ",".join('{"start_time":%d,"end_time":%d,"value":"0.5"}' % (i * 12, i * 12 + 12) for i in range(100))
    bodies = {
        "ok": '{"id":12345,"duration":"1201.5","heatmap":[%s],"chapters":[{"start_time":0,"end_time":"9.5","title":"Intro"},{}],"live_status":"was_live","uploader_url":null,"channel_url":"u"}' % bins,
        "none": '{"id":"x","heatmap":null,"duration":"abc","is_live":true}', "object": '{"id":"x","heatmap":{}}', "empty": '{"id":"","heatmap":[],"chapters":"text"}',
        "fifty": '{"id":"x","heatmap":[1,2,3]}', "foo": '{"id":"x","heatmap":["foo"]}', "noid": '{"title":"t"}', "nullid": '{"id":null}', "blank": "", "cut": "{", "list": "[]", "null": "null", "void": None,
    }
    df = spark.createDataFrame(list(bodies.items()), "k string, body string")
    got = {r["k"]: r for r in info_json.parse(df, "k", "body").collect()}
    reason = {k: got[k]["reason"] for k in bodies}
    assert reason == {"ok": None, "none": None, "object": None, "empty": None, "fifty": "profile size", "foo": "profile size", "noid": "no id", "nullid": "no id", **dict.fromkeys(("blank", "cut", "list", "null", "void"), "malformed")}
    ok = got["ok"]
    assert (ok["video_id"], ok["duration"], ok["bin_seconds"], ok["is_live"], ok["channel_url"]) == ("12345", 1201.5, 12.0, False, "")
    assert len(ok["vals"]) == 100 and set(ok["vals"]) == {0.5}
    assert [tuple(c) for c in ok["chapters"]] == [(0.0, 9.5, "Intro"), (0.0, 0.0, "")]
    assert got["none"]["duration"] == 0.0 and got["none"]["is_live"] and got["none"]["vals"] is None and got["empty"]["chapters"] == []


def test_vtt(spark):
    body = "WEBVTT\nKind: captions\n\n00:01.000 --> 00:03.000 align:start\n<c>hello</c>  world\nhello world\n\n00:03.000 --> 00:05.000\nhello world\nnext line here\n\n1:00:03.000 --> 1:00:05.500\nthird<unfinished\n\nbad --> worse\nlost\n"
    df = spark.createDataFrame([("a", body), ("b", ""), ("c", "WEBVTT\n"), ("d", None)], "id string, body string")
    got = [tuple(r) for r in vtt.parse(df, "id", "body").orderBy("cue_idx").collect()]
    assert got == [("a", 0, 1.0, 3.0, "hello world"), ("a", 1, 3.0, 5.0, "next line here"), ("a", 2, 3603.0, 3605.5, "third")]


def test_scalars(spark):
    assert one(spark, 3725.6, scalars.hms, "double") == "01:02:06"
    assert [one(spark, x, lambda c: scalars.fixed(c, 2), "double") for x in (7.625, 7.645, 7.635, 0.005, 1234.565, -1.25, 0.0)] == [f"{x:.2f}" for x in (7.625, 7.645, 7.635, 0.005, 1234.565, -1.25, 0.0)]
    assert one(spark, "a{b}\\c\r\n d ", scalars.escape_ass) == "a\\{b\\}\\\\c  d"
    assert one(spark, "C:\\x\\it's", scalars.escape_path) == "C\\:/x/it\\'s"
    assert one(spark, 2.0, scalars.compact, "double") == "2" and one(spark, 0.25, scalars.compact, "double") == "0.25"
    assert [one(spark, x, scalars.safe_id) for x in ("ok", "", "a..b", "a/b", None)] == [True, False, False, False, False]
    assert one(spark, "x/y.MP4", scalars.mime) == "video/mp4"
    assert one(spark, "abcé", lambda c: fuse.utf8_truncate(c, 4)) == "abc" and one(spark, "abcéd", lambda c: fuse.utf8_truncate(c, 5)) == "abc" and one(spark, "abc", lambda c: fuse.utf8_truncate(c, 3)) == "abc"
    assert str(one(spark, "web-20240131-235959-123", scalars.job_time)) == "2024-01-31 23:59:59.123000" and one(spark, "other", scalars.job_time) is None
    late, soon = F.timestamp_seconds(F.lit(2_000)), F.timestamp_seconds(F.lit(1_000))
    assert one(spark, "other", lambda c: F.unix_seconds(scalars.job_time(c, late, soon))) == 1_000
    assert [one(spark, x, scalars.compact, "double") for x in (1e7, 1234567.0, 0.00001, 100.0, 12.5)] == ["1e+07", "1.23457e+06", "1e-05", "100", "12.5"]
    assert one(spark, "a:b'c%d\\e\x01f", scalars.drawtext_escape) == "a\\:b\\'c\\%d\\\\ef"
    assert [one(spark, x, scalars.mime) for x in ("a.webm", "b.HTML", "c")] == ["video/webm", "text/html; charset=utf-8", "application/octet-stream"]
    assert [one(spark, x, scalars.format_name) for x in ("blur", "orig", None)] == ["916blur", "orig", "?"]
    assert tuple(one(spark, "añb", lambda c: scalars.log_chunk(c, F.lit(1)))) == (1, 4, "ñb") and tuple(one(spark, "añb", lambda c: scalars.log_chunk(c, F.lit(9)))) == (4, 4, "")
    args = lambda body: one(spark, body, lambda c: scalars.run_arguments(F.parse_json(c)))
    assert args("{}") == ["--dump-heatmap"]
    assert args('{"dump_heatmap": false, "max_clips": 4, "clip_len": 22.50, "min_gap": 0, "format": "orig", "cookies": "none", "source": "native", "detect": 3, "strict": true}') == ["-n", "4", "-l", "22.5", "--format", "orig", "--source", "native", "--strict"]
    assert one(spark, [0.0, 0.5, 1.0, 2.0, math.nan][:4], profile.sparkline, "array<double>") == " +@@"
