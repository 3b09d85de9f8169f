"""Sources, sinks, listings and the stream extension."""

from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from spanwise.operators import listing, planning, profile, subtitles
from spanwise.sources import datasource, fixtures, info_json, sinks
from spanwise.streaming import profile_stream


def test_folder_source_and_fixture_file(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": str(i), "duration": i}))
    datasource.register(spark)
    rows = spark.read.format("info_json_dir").option("perPartition", 2).load(str(tmp_path))
    assert sorted(r["video_id"] for r in info_json.parse(rows, "file_name", "body").collect()) == list("01234")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.json").write_text(json.dumps({"fixtures": [{"id": "a", "lenSec": 1200, "binMs": 12000, "scale": 10, "scores": [0] * 50 + [10] + [0] * 49}]}))
    found = profile.detect(fixtures.read_profiles(spark, str(tmp_path / "f" / "x.json"))).collect()[0]
    assert found["regions"][0]["peak_bin"] == 50 and found["bin_seconds"] == 12.0


def test_language_choice(spark):
    order = spark.createDataFrame([("hi", "en,hi"), ("en", "en-US,hi"), ("", ""), (None, " de , fr")], "w string, p string")
    assert [r[0] for r in order.select(info_json.language_order(F.col("w"), F.col("p"))).collect()] == [["hi", "en", "hi"], ["en-US", "hi"], ["en"], ["de", "fr"]]
    available = spark.createDataFrame([("a", "de", "1"), ("a", "en", "2"), ("b", "xx", "9"), ("b", "yy", "8")], "item_id string, lang string, path string")
    langs = spark.createDataFrame([("a", ["fr", "en", "de"]), ("b", ["en"])], "item_id string, langs array<string>")
    assert {tuple(r) for r in info_json.first_available(available, langs).collect()} == {("a", "en", "2"), ("b", "yy", "8")}
    assets = spark.createDataFrame([("a", "1", 100, 100, False, 0), ("a", "2", 400, 300, False, 1), ("a", "3", 50, 50, True, 2), ("a", "4", 0, 9, True, 3)], "item_id string, path string, w int, h int, hint boolean, ord int")
    assert info_json.pick_asset(assets, "avatar").collect()[0]["path"] == "3"


def test_small_rules(spark):
    cases = {"x: Failed to decrypt with DPAPI": "cookies unreadable", "app-bound age": "cookies unreadable", "could not find chrome cookies database": "browser missing", "could not find": "", "confirm you're not a bot": "bot check", "Sign in to confirm": "sign-in", "page": "sign-in", "ok": "", "": "", None: None}
    texts = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["y"] for r in texts.select("x", info_json.error_hint(F.col("x")).alias("y")).collect()} == cases
    limited = spark.createDataFrame([("HTTP Error 429",), ("Too Many Requests",), ("429",), (None,)], "x string")
    assert [r[0] for r in limited.select(info_json.rate_limited(F.col("x"))).collect()] == [True, True, False, False]
    files = spark.createDataFrame([(10, 1.0), (70_000, 1.0), (70_000, 10.0), (70_000, 0.0), (None, 1.0), (70_000, None)], "size long, sec double")
    assert [r[0] for r in files.select(planning.plausible(F.col("size"), F.col("sec"))).collect()] == [False, True, False, True, False, True]
    assert [[r[0] for r in files.select(planning.plausible(F.lit(n), F.lit(0.0), "card")).take(1)][0] for n in (4_095, 4_096)] == [False, True]
    thumbs = spark.createDataFrame([("a", "t.webp"), ("a", "t.png"), ("b", "t.gif"), ("c", "z.jpg"), ("c", "a.jpg"), (None, "x.jpg")], "item_id string, path string")
    assert {tuple(r) for r in info_json.pick_thumbnail(thumbs).collect()} == {("a", "t.png"), ("c", "a.jpg")}


def test_channel_assets(spark, tmp_path):
    header = lambda w, h, kind=0xC0: b"\xff\xd8\xff\xe0\x00\x04ab\xff" + bytes([kind]) + b"\x00\x0b\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00"
    (tmp_path / "c1").mkdir()
    for name, data in (("chan.1.jpg", header(900, 300)), ("chan.2.jpg", header(88, 88, 0xC2)), ("chan.3.jpg", b"no image"), ("other.jpg", header(1, 1)), ("chan.4.jpg", b"")):
        (tmp_path / "c1" / name).write_bytes(data)
    got = info_json.channel_assets(spark, str(tmp_path)).withColumn("hint", F.lit(False))
    assert {(r["item_id"], r["w"], r["h"], r["ord"]) for r in got.collect()} == {("c1", 900, 300, 1), ("c1", 88, 88, 2)}
    assert info_json.pick_asset(got, "banner").collect()[0]["path"].endswith("chan.1.jpg")


def test_manifests_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1200.0, 12.0, [1.0 if i == 42 else 0.02 for i in range(100)]), ("none", 1200.0, 12.0, [0.0] * 100)], "item_id string, duration double, bin_seconds double, vals array<double>")
    det = profile.detect(df)
    clips = planning.plan(det).withColumn("label", F.lit("L"))
    videos = spark.createDataFrame([("a", "T", "C", "u"), ("none", "T2", "C", "u2")], "item_id string, title string, channel string, url string")
    docs = {r["item_id"]: json.loads(r["json"]) for r in sinks.manifest(videos, det, clips).collect()}
    assert docs["a"]["clips"][0]["file"] == "clip_01_000810.mp4" and docs["a"]["clips"][0]["peakBin"] == 42 and not docs["a"]["quality"]["flat"]
    assert docs["none"]["clips"] == [] and docs["none"]["params"]["max_clips"] == 6
    heat = json.loads(sinks.heatmap_json(df).filter("item_id = 'a'").collect()[0]["json"])
    assert len(heat["bins"]) == 100 and heat["binSeconds"] == 12.0 and heat["bins"][42]["value"] == 1.0
    for k, d in docs.items():
        (tmp_path / k).mkdir()
        (tmp_path / k / "manifest.json").write_text(json.dumps(d))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manifest.json").write_text("{")
    assert {(r["title"], r["clips"]) for r in listing.manifests(spark, str(tmp_path)).collect()} == {("T", 1), ("T2", 0)}
    sinks.write_documents(sinks.heatmap_json(df), str(tmp_path / "out"))
    assert {r["item_id"]: len(json.loads(r["document"])["bins"]) for r in sinks.read_documents(spark, str(tmp_path / "out")).collect()} == {"a": 100, "none": 100}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_documents(sinks.heatmap_json(df), str(tmp_path / "out"))


def test_documents_have_own_mode_and_all_params(spark):
    none = "array<string>"
    cand = spark.createDataFrame([("a", 2, 5.0, 9.0, 1.0, "h", False, False, []), ("a", 1, 1.0, 4.0, 2.0, "g", True, False, ["x"])], f"item_id string, rank int, start_sec double, end_sec double, score double, hook_text string, four_beat boolean, cold_open_match boolean, signals {none}")
    items = spark.createDataFrame([("a", "hi", "caption-only"), ("b", None, "fused")], "item_id string, lang string, mode string")
    docs = {r["item_id"]: json.loads(r["json"]) for r in sinks.captions_json(cand, items, 0.4).collect()}
    assert [c["hook"] for c in docs["a"].pop("candidates")] == ["g", "h"] and docs["a"] == {"lang": "hi", "mode": "caption-only", "weight": 0.4}
    assert docs["b"] == {"lang": "", "mode": "fused", "weight": 0.4, "candidates": []}
    df = spark.createDataFrame([("a", 1200.0, 12.0, [1.0 if i == 42 else 0.02 for i in range(100)])], "item_id string, duration double, bin_seconds double, vals array<double>")
    det = profile.detect(df)
    videos = spark.createDataFrame([("a", "T", "C", "u")], "item_id string, title string, channel string, url string")
    params = json.loads(sinks.manifest(videos, det, planning.plan(det).withColumn("label", F.lit(""))).collect()[0]["json"])["params"]
    assert params == {"max_clips": 6, "format": "916blur", "keep_intro": False, "strict": False, "clip_len": 0.0, "min_gap": 0.0, "source": "ytdlp", "dry_run": False, "full_download": False, "try_sections": False}


def test_listing(spark):
    jobs = spark.createDataFrame([("web-1", 5), ("2", 6)], "id string, modified int")
    disk = spark.createDataFrame([("1", 1), ("web-2", 2), ("3", 3)], "id string, modified int")
    assert sorted(map(tuple, listing.run_listing(jobs, disk).collect())) == [("2", "memory", 6), ("3", "disk", 3), ("web-1", "memory", 5)]


def test_subtitle_file(spark):
    seg = spark.createDataFrame([("a", 0, 0.0, 2.0, "b {x}"), ("a", 1, 1.0, 3.0, "c\\Nd"), ("b", 0, 2.0, 2.0, "gone")], "item_id string, k int, start_sec double, end_sec double, text string")
    out = {r["item_id"]: r["ass"] for r in subtitles.ass_text(subtitles.chain(seg, ["item_id"], ["k"]), ["item_id"]).collect()}
    assert set(out) == {"a"}
    assert [x for x in out["a"].splitlines() if x.startswith("Dialogue")] == ["Dialogue: 0,0:00:00.00,0:00:01.00,Default,b \\{x\\}", "Dialogue: 0,0:00:01.00,0:00:03.00,Default,c\\Nd"]


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in range(0, 60, 2)] + [(2, "2024-01-02 00:00:00"), (2, "2024-01-02 01:00:00"), (None, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    spans = events.filter("user_id IS NOT NULL").groupBy(F.col("user_id").cast("string").alias("item_id")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = profile_stream.bin_counts(stream, spans, late="30 days").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["item_id"], r["bin"], r["n"]) for r in spark.table("counts").collect()}
    assert got == {(r["item_id"], r["bin"], r["n"]) for r in profile_stream.bin_counts(events, spans).collect()} and len(got) > 10
