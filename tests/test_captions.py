"""Caption plans: markers both ways, windows and candidates against brute force, hot items, plan shape."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanwise.functions.lexicon import DEFAULT_MARKERS, parse_markers
from spanwise.operators import captions, subtitles

CUES = "item_id string, cue_idx int, start_sec double, end_sec double, text string"


def test_markers():
    assert len(DEFAULT_MARKERS) > 100 and all(1 <= w <= 3 and p and s for p, _, w, s in DEFAULT_MARKERS)
    assert {r for _, r, _, _ in DEFAULT_MARKERS} == {"pre", "payload", "trailing", "negative"}
    assert parse_markers("pre 2 a b: x | y: z") == (("x", "pre", 2, "a b"), ("y: z", "pre", 2, "a b"))


def test_marking_with_and_without_automaton(spark):
    rnd = random.Random(2)
    parts = [p for p, *_ in DEFAULT_MARKERS] + ["abe", "१२ लाख", "50 crore", "7", "no", "%"]
    rows = [("a", i, 0.0, 1.0, " ".join(rnd.choices(parts, k=rnd.randrange(5)))) for i in range(400)] + [("a", 900, 0.0, 1.0, None), ("a", 901, 0.0, 1.0, "x" * 50_000 + " wow")]
    cues = captions.clean_cues(spark.createDataFrame(rows, CUES))
    with_it, without = (sorted(map(str, captions.mark(cues, automaton=a).collect())) for a in (True, False))
    assert with_it == without and len(with_it) == 402


def test_one_of_several_texts_of_a_cue(spark):
    rows = [("a", 1, 0.0, 1.0, "b"), ("a", 1, 0.0, 1.0, "a"), ("a", 1, 0.0, 2.0, "0"), ("a", 1, 0.0, 1.0, "b"), ("a", None, 0.0, 1.0, "x"), (None, 1, 0.0, 1.0, "x"), ("a", 2, 3.0, 3.0, "x"), ("a", 3, -1.0, 3.0, "x"), ("a", 4, 1.0, 2.0, None)]
    for order in (rows, rows[::-1]):
        got = captions.clean_cues(spark.createDataFrame(order, CUES).repartition(3))
        assert sorted(map(tuple, got.collect())) == [("a", 1, 0, 1000, "a"), ("a", 4, 1000, 2000, "")]


def windows(spark, rows):
    kind = "item_id string, bucket long, cue_idx int, from_ms long, start_sec double, end_sec double, score double, hook_idx int, four_beat boolean, cold_open_match boolean, signals array<string>"
    return spark.createDataFrame([(i, s // captions.BUCKET_MS, n, s, s / 1000, s / 1000 + 30 + rnd, score, n, False, False, []) for i, n, s, score, rnd in rows], kind)


def test_candidates_against_greedy(spark):
    """Items with fewer and with many more than 36 time buckets, ties, scores that rise along the item."""
    rnd = random.Random(9)
    rows = [(item, n, rnd.randrange(0, hours * 3_600_000), rnd.choice([0.0, 1.0, 2.0, rnd.random() * 9]), rnd.choice([0.0, 4.0])) for item, hours in (("short", 1), ("long", 40), ("few", 200)) for n in range(700 if item != "few" else 20)]
    rows += [("rising", n, n * 11_000, float(n), 0.0) for n in range(3_000)]
    want = set()
    for item in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == item and r[3] > 0), key=lambda r: (-r[3], r[2], r[1])):
            mid = (r[2] / 1000 + r[2] / 1000 + 30 + r[4]) / 2
            if len(kept) < 12 and all(abs(mid - k) >= 45 for k in kept):
                kept.append(mid)
                want.add((item, len(kept), r[1]))
    got = captions.candidates(windows(spark, rows))
    assert {(r["item_id"], r["rank"], r["hook_idx"]) for r in got.collect()} == want


def test_hot_item_and_plan(spark, tmp_path):
    """One item of 60,000 cues among small ones: spread over its time buckets, one read of what is kept."""
    n = 60_000
    hot = spark.range(n).select(F.lit("hot").alias("item_id"), F.col("id").cast("int").alias("cue_idx"), (F.col("id") * 2.0).alias("start_sec"), (F.col("id") * 2.0 + 1.5).alias("end_sec"), F.when(F.col("id") % 50 == 0, "wow 5 million").otherwise("filler words of a talk").alias("text"))
    prepared = captions.prepare(hot.unionByName(spark.createDataFrame([("s", i, 4.0 * i, 4.0 * i + 3, "wow") for i in range(20)] + [("few", 0, 0.0, 9.0, "wow")], CUES)))
    out = captions.windows_of(prepared)
    per = {r["item_id"]: r["count"] for r in out.groupBy("item_id").count().collect()}
    assert per == {"hot": n - 7, "s": 17} and out.groupBy("item_id", "bucket").count().agg(F.max("count")).collect()[0][0] <= captions.BUCKET_MS / 2_000
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert captions.candidates(out).filter("item_id = 'hot'").count() == 12


def test_trim_and_chain_against_brute_force(spark):
    rnd = random.Random(6)
    cues = [(rnd.choice("ab"), i, round(rnd.random() * 4000, 2), 0.0, f"t{i}") for i in range(600)]
    cues = [(i, n, s, s + rnd.choice([0.5, 3.0, 59.0, 61.0, 500.0, 3900.0]), t) for i, n, s, _, t in cues]
    clips = [(i, k, s, s + rnd.choice([15.0, 40.0, 180.0])) for i in "ab" for k, s in enumerate(rnd.randrange(0, 3900) + rnd.choice([0.0, 0.5]) for _ in range(10))]
    clean = captions.clean_cues(spark.createDataFrame(cues, CUES))
    cut = subtitles.trim_to_clips(clean, spark.createDataFrame(clips, "item_id string, clip_index int, start_sec double, end_sec double"))
    got = sorted((r["item_id"], r["clip_index"], r["cue_idx"], round(r["start_sec"], 6), round(r["end_sec"], 6)) for r in cut.collect())
    want = sorted((i, k, n, round(max(cs, s) - s, 6), round(min(ce, e) - s, 6)) for i, k, s, e in clips for j, n, cs, ce, _ in cues if i == j and cs < e and ce > s)
    assert got == want and len(got) > 500

    segments = clean.select("item_id", "cue_idx", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"))
    got = sorted((r["item_id"], r["cue_idx"], r["start_sec"], r["end_sec"]) for r in subtitles.chain(segments, ["item_id"], ["cue_idx"]).collect())
    want = []
    for item in "ab":
        own = sorted((c for c in cues if c[0] == item), key=lambda c: (c[2], c[1]))
        for c, after in zip(own, [*own[1:], None], strict=True):
            end = min(c[3], after[2]) if after else c[3]
            if round(end, 3) > c[2]:
                want.append((item, c[1], c[2], round(end, 3)))
    assert [(i, n, s, round(e, 3)) for i, n, s, e in got] == sorted(want)
