"""Scores of timed text: markers, magnitudes, echoes of the opening, and windows over them.

Cues are rows (item_id, cue_idx, start_sec, end_sec, text). They are cleaned and marked once and kept
(:func:`prepare`), with one short row per item. Windows look 45 seconds ahead of every cue; they are
taken within time buckets of an item, each holding the cues a window may reach, so that an item's
cues need not meet in one task. What else a window must know (the item's duration, echoes of the
opening) comes to the buckets as rows of its own, so that no cue is joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from importlib.util import find_spec
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanwise.config import N_BINS, ScoreConfig
from spanwise.functions.lexicon import DEFAULT_MARKERS, MAGNITUDES
from spanwise.operators.arrays import let
from spanwise.operators.greedy import greedy_top_k
from spanwise.session import materialize

CFG = ScoreConfig()
#: Width of a time bucket; windows reach at most one bucket further.
BUCKET_MS = 450_000
CONTEXT_BYTES = 30


def clean_cues(cues: DataFrame) -> DataFrame:
    """(item_id, cue_idx, start_ms, end_ms, text) of usable cues, one per item and cue_idx.

    Left out: null ids or bounds, negative starts, ends not after the start. Null texts become "".
    Of rows with one cue_idx the smallest by start, end and text is taken, whatever their order. Order
    is by start, then cue_idx. One shuffle, by (item_id, cue_idx).
    """
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    rows = cues.select("item_id", "cue_idx", ms("start_sec").alias("start_ms"), ms("end_sec").alias("end_ms"), F.coalesce("text", F.lit("")).alias("text"))
    usable = rows.filter("item_id IS NOT NULL AND cue_idx IS NOT NULL AND start_ms >= 0 AND end_ms > start_ms")
    first = F.row_number().over(W.Window.partitionBy("item_id", "cue_idx").orderBy("start_ms", "end_ms", "text"))
    # a fixed number of partitions: adaptive execution would size them by what is read, not by the
    # work that follows
    wide = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return usable.repartition(wide, "item_id", "cue_idx").withColumn("n", first).filter("n = 1").drop("n")


def usable_items(cues: DataFrame, durations: DataFrame, cfg: ScoreConfig = CFG) -> DataFrame:
    """(item_id, duration_ms) of items with enough cues and a positive duration."""
    n = cues.groupBy("item_id").agg(F.count("*").alias("n")).filter(F.col("n") >= cfg.least_cues)
    return n.join(durations.select("item_id", F.round(F.col("duration") * 1000).cast("long").alias("duration_ms")), "item_id").filter("duration_ms > 0").drop("n")


def normalise(text: Column) -> Column:
    """ASCII letters to lower case, Devanagari digits to ASCII; all else stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ०१२३४५६७८९", "abcdefghijklmnopqrstuvwxyz0123456789")


def _magnitude_near(units: Sequence[str]) -> Callable[[str], int]:
    any_unit = re.compile(b"|".join(re.escape(u.encode()) for u in units)).search
    runs = re.compile(rb"[0-9]+").finditer

    def count(text: str) -> int:
        view = text.encode()
        if not any_unit(view):
            return 0
        # what is cut at the edge of the context is no unit, and no unit reaches across the number
        return sum(any_unit(view[max(0, m.start() - CONTEXT_BYTES) : m.end() + CONTEXT_BYTES]) is not None for m in runs(view))

    return count


def numeric_payloads(norm: Column, units: Sequence[str] = MAGNITUDES) -> Column:
    """Numbers that have a magnitude within 30 bytes before or after them; null for a null text.

    In Arrow batches: what the context of a number holds is a matter of bytes, for which the JVM
    has only expressions with a look-behind for every unit, some fifty times slower.
    """
    units = tuple(units)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        near = _magnitude_near(units)
        return texts.map(lambda t: 0 if t is None else near(t)).astype("int32")

    return F.coalesce(count(F.when(norm.rlike("[0-9]"), norm)), F.lit(0))


@lru_cache(8)
def _automaton(patterns: tuple[str, ...]):  # noqa: ANN202
    import ahocorasick

    machine = ahocorasick.Automaton()
    for p in patterns:
        machine.add_word(p, tuple(i for i, q in enumerate(patterns) if q == p))
    machine.make_automaton()
    return machine


def pattern_hits(norm: Column, patterns: Sequence[str], automaton: bool | None = None) -> Column:
    """Which ``patterns`` (by number, ascending) a text holds as substrings.

    All are looked for at once by one automaton over the text, in Arrow batches: its cost does not
    grow with their number, where comparing each of some two hundred takes the JVM twenty times as
    long. Where the automaton's library is missing (or with ``automaton`` false) they are compared.
    """
    patterns = tuple(patterns)
    if automaton is None:
        automaton = find_spec("ahocorasick") is not None
    if not automaton or not all(patterns):
        return F.filter(F.sequence(F.lit(0), F.lit(len(patterns) - 1)), lambda i: F.contains(norm, F.get(F.array(*map(F.lit, patterns)), i)))

    @F.pandas_udf("array<int>")
    def hits(texts: pd.Series) -> pd.Series:
        found = _automaton(patterns).iter
        return texts.map(lambda t: sorted({i for _, own in found(t) for i in own}) if t else [])

    return hits(norm)


def mark(cues: DataFrame, markers: Sequence[tuple[str, str, int, str]] = DEFAULT_MARKERS, automaton: bool | None = None) -> DataFrame:
    """Adds norm, pre, payload, trailing (summed weights), negative, numeric and signals to cues.

    ``markers`` is a list of (pattern, role, weight, signal); a marker counts once in a cue.
    """
    each = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(w).alias("w"), F.lit(s).alias("s")) for _, r, w, s in markers])
    hit = cues.withColumn("norm", normalise(F.col("text"))).withColumn("_at", pattern_hits(F.col("norm"), [m[0] for m in markers], automaton))
    hit = hit.withColumn("hits", F.transform("_at", lambda i: F.get(each, i)))
    weight = lambda role: F.aggregate("hits", F.lit(0), lambda a, m: a + F.when(m["r"] == role, m["w"]).otherwise(0))
    hit = hit.withColumns({r: weight(r) for r in ("pre", "payload", "trailing")})
    hit = hit.withColumn("negative", F.exists("hits", lambda m: m["r"] == "negative")).withColumn("signals", F.array_sort(F.array_distinct(F.transform("hits", lambda m: m["s"]))))
    return hit.withColumn("numeric", numeric_payloads(F.col("norm"))).drop("hits", "_at")


class Prepared(NamedTuple):
    """Clean, marked cues, and (item_id, cues, duration_ms, buckets) of every item; both kept."""

    marked: DataFrame
    items: DataFrame


def prepare(cues: DataFrame, durations: DataFrame | None = None, markers: Sequence[tuple[str, str, int, str]] = DEFAULT_MARKERS) -> Prepared:
    """Reads, cleans and marks cues once. ``durations`` (item_id, duration in seconds) are those of the
    cues' last ends if not given; items without one then have a null duration.

    ``buckets`` are the time buckets in which an item has cues: as many as its length holds, however
    many cues it has.
    """
    marked = materialize(mark(clean_cues(cues), markers))
    items = marked.groupBy("item_id").agg(F.count("*").alias("cues"), F.max("end_ms").alias("duration_ms"), F.collect_set(F.floor(F.col("start_ms") / BUCKET_MS)).alias("buckets"))
    if durations is not None:
        given = durations.groupBy("item_id").agg(F.round(F.max("duration") * 1000).cast("long").alias("duration_ms"))
        items = items.drop("duration_ms").join(given, "item_id", "left").select("item_id", "cues", "duration_ms", "buckets")
    return Prepared(marked, materialize(items))


def shingles(norm: Column, k: int = CFG.shingle) -> Column:
    """Distinct runs of k words; none where there are fewer."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - k + 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
    none = F.array().cast("array<string>")
    return let(F.filter(F.split(norm, " "), lambda w: w != ""), lambda w: F.when(F.size(w) >= k, F.array_distinct(runs(w))).otherwise(none))


def shingle_df(marked: DataFrame) -> DataFrame:
    """(item_id, shingle, df, ...): in how many cues of an item each shingle occurs."""
    rows = marked.select("item_id", "cue_idx", "start_ms", F.explode(shingles(F.col("norm"))).alias("shingle"))
    at = F.struct("start_ms", "cue_idx")
    return rows.groupBy("item_id", "shingle").agg(F.count("*").alias("df"), F.min(at).alias("first"), F.max(at).alias("last"), F.sum("start_ms").alias("starts"), F.sum("cue_idx").alias("idxs"))


def opening_echoes(marked: DataFrame, items: DataFrame, cfg: ScoreConfig = CFG) -> DataFrame:
    """(item_id, cue_idx, start_ms): cues of the body that repeat a rare shingle of the opening, once for
    each shingle they repeat.

    Only items with room for an opening and a body. A rare shingle has at most three cues, which its
    first, last and sums determine, so no list of cues is gathered.
    """
    long = items.filter(F.col("duration_ms") > 2 * cfg.body_start_ms).select("item_id")
    df = shingle_df(marked.join(long, "item_id", "left_semi"))
    rare = df.filter((F.col("df") <= cfg.rare_df) & (F.col("first.start_ms") < cfg.cold_open_end_ms))
    mid = F.struct((F.col("starts") - F.col("first.start_ms") - F.col("last.start_ms")).alias("start_ms"), (F.col("idxs") - F.col("first.cue_idx") - F.col("last.cue_idx")).cast("int").alias("cue_idx"))
    third = F.when(F.col("df") == 3, mid)
    cues = rare.select("item_id", F.explode(F.array(F.col("first"), F.col("last"), third)).alias("c"))
    return cues.filter(F.col("c.start_ms") >= cfg.body_start_ms).select("item_id", "c.cue_idx", "c.start_ms")


def cold_open_echoes(marked: DataFrame, items: DataFrame, cfg: ScoreConfig = CFG) -> DataFrame:
    """(item_id, cue_idx) of :func:`opening_echoes`, each cue once."""
    return opening_echoes(marked, items, cfg).select("item_id", "cue_idx").distinct()


def _sum(frame: str, f) -> Column:  # noqa: ANN001
    return F.aggregate(frame, F.lit(0.0), lambda a, x: a + f(x))


def _first(frame: str, test) -> Column:  # noqa: ANN001
    return F.get(F.filter(frame, test), 0)["start_ms"]


def prior(mid: Column, duration: Column) -> Column:
    """Factor for where in the item a window's middle lies."""
    pct = 100.0 * mid / duration
    return F.when(pct < 10, 1.0).when(pct < 30, 0.85).when(pct < 60, 1.1).when(pct < 90, 1.15).otherwise(1.0)


def frames(prepared: Prepared, cfg: ScoreConfig = CFG) -> DataFrame:
    """(item_id, bucket, cue_idx, start_ms, duration_ms, masked, last_end, first_echo, frame): every window start.

    ``frame`` holds the cues with any hit that begin within the window, in order; of cues that begin
    together those before the first one are not in it. Cues without hits add nothing to a score, so
    they are not gathered; ``last_end`` is the end of the window's last cue, hit or not, and
    ``first_echo`` the start of the first that echoes the opening. Items with too few cues or without
    a positive duration, and windows with less than 15 seconds left, are left out.
    """
    ahead, back = cfg.window_ms + cfg.promo_before_ms, cfg.promo_after_ms
    own = F.floor(F.col("start_ms") / BUCKET_MS)
    left, right = F.col("start_ms") - own * BUCKET_MS < ahead, (own + 1) * BUCKET_MS - F.col("start_ms") <= back
    buckets = lambda *more: F.explode(F.array_compact(F.array(own, *more))).alias("bucket")
    cue = F.struct("start_ms", "cue_idx", "end_ms", "pre", "payload", "trailing", "numeric", "negative", "signals")
    spread = prepared.marked.select("item_id", buckets(F.when(left, own - 1), F.when(right, own + 1)), F.col("start_ms").alias("at"), cue.alias("cue"))
    # what a bucket must know beside its cues: echoes that its windows may reach, and the item's duration
    echoes = opening_echoes(prepared.marked, prepared.items, cfg).select("item_id", buckets(F.when(left, own - 1)), F.col("start_ms").alias("at"), F.col("cue_idx").alias("echo_idx"))
    usable = prepared.items.filter((F.col("cues") >= cfg.least_cues) & (F.col("duration_ms") > 0))
    known = usable.select("item_id", "duration_ms", F.explode("buckets").alias("bucket")).withColumn("at", F.col("bucket") * BUCKET_MS)
    rows = spread.unionByName(echoes, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)

    whole = W.Window.partitionBy("item_id", "bucket")
    w = whole.orderBy("at")
    span = w.rangeBetween(0, cfg.window_ms - 1)
    hit = (F.size("cue.signals") > 0) | (F.col("cue.numeric") > 0)
    framed = rows.withColumns(
        {
            "frame": F.collect_list(F.when(hit, F.col("cue"))).over(span),
            "last": F.max(F.when(F.col("cue").isNotNull(), F.struct("cue.start_ms", "cue.cue_idx", "cue.end_ms"))).over(span),
            # an echo that begins with the window counts from the window's own cue on
            "echo_now": F.max("echo_idx").over(w.rangeBetween(0, 0)),
            "echo_later": F.min(F.when(F.col("echo_idx").isNotNull(), F.col("at"))).over(w.rangeBetween(1, cfg.window_ms - 1)),
            # a promo's span is open at both ends: it begins 5 s before its cue and ends 30 s after it
            "masked": F.max("cue.negative").over(w.rangeBetween(1 - back, ahead - 1)),
            "duration_ms": F.max("duration_ms").over(whole),
        }
    ).filter(F.col("cue").isNotNull() & (F.floor(F.col("at") / BUCKET_MS) == F.col("bucket")) & (F.col("at") + cfg.least_window_ms <= F.col("duration_ms")))
    mine = F.array_sort(F.filter("frame", lambda x: (x["start_ms"] > F.col("cue.start_ms")) | (x["cue_idx"] >= F.col("cue.cue_idx"))))
    first_echo = F.when(F.col("echo_now") >= F.col("cue.cue_idx"), F.col("at")).otherwise(F.col("echo_later"))
    return framed.select("item_id", "bucket", "cue.cue_idx", "cue.start_ms", "duration_ms", "masked", F.col("last.end_ms").alias("last_end"), first_echo.alias("first_echo"), mine.alias("frame"))


def window_scores(framed: DataFrame, cfg: ScoreConfig = CFG) -> DataFrame:
    """One row per window: item_id, bucket, cue_idx, start, end (seconds), score and how it came about."""
    since = lambda x: x["start_ms"] - F.col("start_ms")
    early = lambda x: (x["pre"] > 0) & (since(x) < cfg.turn_ms)
    late = lambda x: (x["trailing"] > 0) & (since(x) > cfg.turn_ms)
    paid = lambda x: (x["numeric"] > 0) | (x["payload"] > 0)
    f = "frame"
    w = framed.withColumn("numbers", F.flatten(F.transform(f, lambda x: F.array_repeat(x["start_ms"], x["numeric"].cast("int")))))
    close = let(F.col("numbers"), lambda ns: F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ns) - 1)), lambda k: F.get(ns, k) - F.get(ns, k - 1) <= cfg.pair_ms))
    w = w.withColumns(
        {
            "pre": _sum(f, lambda x: F.when(early(x), x["pre"]).otherwise(0)),
            "payload": _sum(f, lambda x: cfg.w_numeric * x["numeric"] + x["payload"]),
            "pair": F.coalesce(close, F.lit(False)) & (F.size("numbers") > 1),
            "trailing": _sum(f, lambda x: F.when(late(x), x["trailing"]).otherwise(0)),
            "cold_open": F.col("first_echo").isNotNull(),
            "first_pre": _first(f, early),
            "first_payload": _first(f, paid),
            "last_trailing": F.element_at(F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.filter(f, late), lambda x: x["start_ms"])), -1),
            "signals": F.array_sort(F.array_distinct(F.flatten(F.transform(f, lambda x: x["signals"])))),
        }
    )
    four = F.coalesce((F.col("first_payload") >= F.col("first_pre")) & (F.col("last_trailing") > F.col("first_payload")), F.lit(False))
    # the hook: the first of the strongest early markers, else the last number, else the first cue
    best = F.aggregate(F.filter(f, early), F.lit(0), lambda a, x: F.greatest(a, x["pre"]))
    strongest = let(best, lambda b: F.get(F.filter(f, lambda x: early(x) & (x["pre"] == b)), 0)["cue_idx"])
    number = F.filter(f, lambda x: x["numeric"] > 0)
    hook = F.coalesce(strongest, F.get(number, F.size(number) - 1)["cue_idx"], F.col("cue_idx"))
    base = F.col("pre") + F.col("payload") + F.when(F.col("pair"), cfg.w_pair).otherwise(0.0) + F.col("trailing") + F.when(F.col("cold_open"), cfg.w_cold_open).otherwise(0.0)
    w = w.withColumns({"four_beat": four, "hook_idx": hook, "base": base})
    begin = F.greatest("start_ms", F.least("first_pre", "first_payload", "first_echo"))
    w = w.withColumn("end_ms", F.least(F.col("last_end"), F.col("start_ms") + cfg.window_ms + 8_000)).withColumn("begin_ms", begin)
    w = w.withColumn("end_ms", F.when(F.col("end_ms") - F.col("begin_ms") < 25_000, F.least(F.col("duration_ms"), F.col("begin_ms") + 30_000)).otherwise(F.col("end_ms")))
    raw = F.when(F.col("masked"), 0.0).otherwise(F.col("base") * F.when(F.col("four_beat"), cfg.four_beat).otherwise(1.0))
    score = raw * prior((F.col("begin_ms") + F.col("end_ms")) / 2.0, F.col("duration_ms"))
    return w.select("item_id", "bucket", "cue_idx", F.col("start_ms").alias("from_ms"), (F.col("begin_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"), score.alias("score"), "four_beat", F.col("cold_open").alias("cold_open_match"), "masked", "hook_idx", "signals", (F.col("duration_ms") / 1000).alias("duration"))


def envelope(windows: DataFrame) -> DataFrame:
    """(item_id, bin, value): the best score over each of 100 bin centres, as a share of the item's best.

    All zero where no window scores. Windows are spread over the bins they may cover, and the exact
    test follows, so rounding cannot add or lose one. Bin -1 stands for the whole item, so that one
    pre-aggregated pass gives the item's best too.
    """
    width = F.col("duration") / N_BINS
    first = F.greatest(F.lit(0), F.ceil(F.col("start_sec") / width - 0.5).cast("int") - 1)
    last = F.least(F.lit(N_BINS - 1), F.floor(F.col("end_sec") / width - 0.5).cast("int") + 1)
    bins = F.when((F.col("score") > 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    hits = windows.select("item_id", "start_sec", "end_sec", "score", width.alias("width"), F.explode(F.concat(F.array(F.lit(-1)), bins)).alias("bin"))
    centre = (F.col("bin") + 0.5) * F.col("width")
    best = hits.filter((F.col("bin") < 0) | ((centre >= F.col("start_sec")) & (centre <= F.col("end_sec")))).groupBy("item_id", "bin").agg(F.max("score").alias("score"))
    by_bin = best.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "score"))).alias("m"))
    by_bin = by_bin.withColumn("top", F.try_element_at("m", F.lit(-1)))
    share = lambda i: F.when(F.col("top") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("top")).otherwise(0.0)
    return by_bin.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(N_BINS - 1)), share)).alias("bin", "value"))


def candidates(windows: DataFrame, cfg: ScoreConfig = CFG) -> DataFrame:
    """(item_id, rank, start_sec, end_sec, score, hook_idx, four_beat, cold_open_match, signals).

    Windows by score (ties: earlier start, then cue), each kept unless its middle is within 45 s of
    one kept before, at most twelve.

    Windows of an item are not brought together but for its best 36 time buckets, which is exact: a
    kept window rules out windows of its own bucket and the two beside it alone (a window's middle is
    less than BUCKET_MS / 2 from its start). Before the twelfth is kept, fewer than 36 buckets are
    thus touched, so one of the best 36 has its best window still free, and whatever is kept next is
    at least as good. Within a bucket, of windows with one middle only the best can be kept, so a
    bucket has at most one for each half millisecond.
    """
    rank = F.struct(F.negative("score").alias("order"), "from_ms", "cue_idx", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("mid"), "start_sec", "end_sec", "score", "hook_idx", "four_beat", "cold_open_match", "signals")
    kind = "struct<order: double, from_ms: bigint, cue_idx: int, mid: double, start_sec: double, end_sec: double, score: double, hook_idx: int, four_beat: boolean, cold_open_match: boolean, signals: array<string>>"
    one = windows.filter("score > 0").select("item_id", "bucket", rank.cast(kind).alias("w")).groupBy("item_id", "bucket", "w.mid").agg(F.min("w").alias("w"))
    per = one.groupBy("item_id", "bucket").agg(F.collect_list("w").alias("ws"), F.min(F.struct("w.order", "w.from_ms", "w.cue_idx")).alias("best"))
    place = F.row_number().over(W.Window.partitionBy("item_id").orderBy("best"))
    top = per.withColumn("place", place).filter(F.col("place") <= 3 * cfg.max_candidates)
    ranked = top.groupBy("item_id").agg(F.array_sort(F.flatten(F.collect_list("ws"))).alias("ws"))
    kept = ranked.select("item_id", F.posexplode(greedy_top_k(F.col("ws"), "mid", F.lit(cfg.nms_gap), cfg.max_candidates, f"array<{kind}>")).alias("rank", "w"))
    return kept.select("item_id", (F.col("rank") + 1).alias("rank"), "w.start_sec", "w.end_sec", "w.score", "w.hook_idx", "w.four_beat", "w.cold_open_match", "w.signals")


def windows_of(prepared: Prepared, cfg: ScoreConfig = CFG) -> DataFrame:
    """All windows of all usable items, scored. See the steps for what is left out."""
    return window_scores(frames(prepared, cfg), cfg)


def score_windows(cues: DataFrame, durations: DataFrame | None = None, markers: Sequence[tuple[str, str, int, str]] = DEFAULT_MARKERS, cfg: ScoreConfig = CFG) -> DataFrame:
    """:func:`windows_of` cues that serve nothing else."""
    return windows_of(prepare(cues, durations, markers), cfg)


def with_hooks(cands: DataFrame, clean: DataFrame) -> DataFrame:
    """Adds ``hook_text``, the text of each candidate's hook cue, from clean (or prepared) cues."""
    text = clean.select("item_id", F.col("cue_idx").alias("hook_idx"), F.col("text").alias("hook_text"))
    return cands.join(text, ["item_id", "hook_idx"], "left")
