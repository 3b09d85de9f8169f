"""Hot regions of intensity profiles.

A profile is one row: item_id, duration, bin_seconds and ``vals``, its 100 values. Everything from
smoothing to scored regions works on that array inside the row, so once profiles are assembled no
step shuffles, and sums run in bin order, as threshold comparisons need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.config import N_BINS, DetectConfig
from spanwise.operators.arrays import let

REGION = "struct<start_bin: int, end_bin: int, peak_score: double, peak_bin: int, centroid: double>"


#: Rows per key of the spans that events are joined with, so that a hot key's events part over tasks.
SALTS = 16


def event_profiles(events: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Profiles of a point stream: ``key``'s events between its first and last, in 100 equal bins.

    A bin's value is its count (or sum of ``value``) as a share of the fullest bin's. Rows with a
    null key or time are left out; a key whose events share one moment has a duration of 0 and its
    events in bin 0. A key's first and last moment come from one pre-aggregated pass and meet its
    events in SALTS parts, by a hash of the event's time; counts are pre-aggregated per key and bin.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("string").alias("item_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *([F.col(value).alias("v")] if value else []))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    span = rows.groupBy("item_id").agg(F.min("us").alias("t0"), F.max("us").alias("t1")).select("*", salts)
    at = F.when(F.col("t1") > F.col("t0"), F.least(F.lit(N_BINS - 1), F.floor(F.lit(float(N_BINS)) * (F.col("us") - F.col("t0")) / (F.col("t1") - F.col("t0"))))).otherwise(0).cast("int")
    weight = F.coalesce(F.sum("v"), F.lit(0.0)) if value else F.count("*").cast("double")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("us"), F.lit(SALTS)).cast("int"))
    bins = rows.join(span, ["item_id", "salt"]).groupBy("item_id", "t0", "t1", at.alias("bin")).agg(weight.alias("w"))
    per = bins.groupBy("item_id", "t0", "t1").agg(F.map_from_entries(F.collect_list(F.struct("bin", "w"))).alias("by_bin"), F.max("w").alias("top"))
    duration = (F.col("t1") - F.col("t0")) / 1e6
    bins = F.sequence(F.lit(0), F.lit(N_BINS - 1))
    vals = let(F.struct("by_bin", "top"), lambda p: F.transform(bins, lambda i: F.coalesce(F.when(p["top"] > 0, F.try_element_at(p["by_bin"], i) / p["top"]), F.lit(0.0))))
    return per.select("item_id", duration.alias("duration"), (duration / N_BINS).alias("bin_seconds"), vals.alias("vals"))


def to_bins(profiles: DataFrame, values: str = "vals", out: str = "value") -> DataFrame:
    """Long form: (item_id, bin, value)."""
    return profiles.select("item_id", F.posexplode(values).alias("bin", out))


def candidate_mask(profiles: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Adds ``cand``: all bins but 0, and but 1 where the profile only falls over bins 1 to 3."""
    falls = lambda v: (F.get(v, 1) > F.get(v, 2)) & (F.get(v, 2) > F.get(v, 3))
    mask = lambda p: F.transform(p["v"], lambda _, i: F.lit(True) if cfg.keep_intro else (i > 0) & ~((i == 1) & p["falls"]))
    return profiles.withColumn("cand", let(F.col("vals"), lambda v: let(F.struct(v.alias("v"), falls(v).alias("falls")), mask)))


def smooth(profiles: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Adds ``hs``: weights 1-2-1 over neighbours, where bins are finer than a minute; ends stay."""
    def weigh(p: Column) -> Column:
        v, fine = p["v"], p["w"] < cfg.smooth_below_sec
        return F.transform(v, lambda x, i: F.when(fine & (i > 0) & (i < N_BINS - 1), (F.get(v, i - 1) + 2.0 * x + F.get(v, i + 1)) / 4.0).otherwise(x))

    return profiles.withColumn("hs", let(F.struct(F.col("vals").alias("v"), F.col("bin_seconds").alias("w")), weigh))


def robust_stats(profiles: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Adds median, mean, sd (population) and top of the candidate bins, the gate and the thresholds.

    ``ratio`` is top over median (or 1000 times the top where the median is not positive), ``flat``
    whether it is below 2; t and t_low are null where the top is no peak at all.
    """
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    in_order = lambda p: F.filter(p["hs"], lambda _, i: F.get(p["cand"], i))

    def figures(c: Column) -> Column:
        n = F.size(c)
        half = F.floor(n / 2).cast("int")
        middle = lambda s: F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2.0)
        mean = total(c, lambda x: x) / n
        sd = let(mean, lambda m: F.sqrt(total(c, lambda x: (x - m) * (x - m)) / n))
        return F.struct(let(F.array_sort(c), middle).alias("median"), mean.alias("mean"), sd.alias("sd"), F.array_max(c).alias("top"))

    stats = let(F.struct("hs", "cand"), lambda p: let(in_order(p), lambda c: F.when(F.size(c) > 0, figures(c))))
    kept = profiles.withColumn("stats", stats).withColumns({k: F.col(f"stats.{k}") for k in ("median", "mean", "sd", "top")}).drop("stats")
    kept = kept.withColumn("ratio", F.when(F.col("median") > 0, F.col("top") / F.col("median")).otherwise(F.col("top") * 1000.0))
    t = F.when(F.col("top") >= cfg.least_peak, F.greatest(F.col("median") + cfg.sd_factor * F.col("sd"), cfg.max_share * F.col("top")))
    return kept.withColumn("flat", F.col("ratio") < cfg.flat_ratio).withColumn("t", t).withColumn("t_low", cfg.low_share * F.col("t"))


def raw_regions(profiles: DataFrame) -> DataFrame:
    """Adds ``runs``: maximal runs (lo, hi) of candidate bins at t_low or above that reach t somewhere."""
    def runs(p: Column) -> Column:
        lows = F.filter(p["bins"], lambda i: F.get(p["on"], i) & ((i == 0) | ~F.get(p["on"], i - 1)))
        highs = F.filter(p["bins"], lambda i: F.get(p["on"], i) & ((i == N_BINS - 1) | ~F.get(p["on"], i + 1)))
        reaches = lambda r: F.exists(F.slice(p["hs"], r["lo"] + 1, r["hi"] - r["lo"] + 1), lambda v: v >= p["t"])
        return F.filter(F.zip_with(lows, highs, lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))), reaches)

    on = let(F.struct("hs", "cand", "t_low"), lambda p: F.zip_with(p["hs"], p["cand"], lambda v, c: F.coalesce(c & (v >= p["t_low"]), F.lit(False))))
    bins = F.sequence(F.lit(0), F.lit(N_BINS - 1))
    return profiles.withColumn("runs", let(F.struct("hs", "t", on.alias("on"), bins.alias("bins")), runs))


def merge_runs(profiles: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Joins runs with at most ``merge_gap`` bins between them."""
    apart = lambda a, b: b["lo"] - a["hi"] - 1 > cfg.merge_gap

    def joined(r: Column) -> Column:
        first = F.filter(r, lambda x, i: (i == 0) | apart(F.get(r, i - 1), x))
        last = F.filter(r, lambda x, i: (i == F.size(r) - 1) | apart(x, F.get(r, i + 1)))
        return F.zip_with(first, last, lambda a, b: F.struct(a["lo"].alias("lo"), b["hi"].alias("hi")))

    return profiles.withColumn("runs", let(F.col("runs"), joined))


def score_runs(profiles: DataFrame) -> DataFrame:
    """Adds ``regions``: each run's peak, the first bin that has it, and its weighted centre in time."""

    def region(p: Column, r: Column) -> Column:
        value = F.slice(p["hs"], r["lo"] + 1, r["hi"] - r["lo"] + 1)
        peak = F.array_max(value)
        weight = F.aggregate(value, F.lit(0.0), lambda a, v: a + v)
        moment = F.aggregate(F.sequence(r["lo"], r["hi"]), F.lit(0.0), lambda a, k: a + (k + 0.5) * p["bin_seconds"] * F.get(p["hs"], k))
        centroid = F.when(weight > 0, moment / weight).otherwise((r["lo"] + 0.5) * p["bin_seconds"])
        return F.struct(
            r["lo"].alias("start_bin"),
            r["hi"].alias("end_bin"),
            peak.alias("peak_score"),
            (r["lo"] + F.array_position(value, peak) - 1).cast("int").alias("peak_bin"),
            F.least(centroid, p["duration"]).alias("centroid"),
        )

    found = let(F.struct("hs", "runs", "bin_seconds", "duration"), lambda p: F.transform(p["runs"], lambda r: region(p, r)))
    return profiles.withColumn("regions", found.cast(f"array<{REGION}>"))


def detect(profiles: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Profiles with quality, thresholds and ``regions``.

    A profile that is null or has not 100 values has no regions (an empty array) and null figures.
    A flat profile still has its regions; one without any peak has none. Repeated rows are judged
    as often as they occur; other columns stay, those named like an added one are replaced.
    """
    ok = profiles.withColumn("vals", F.when(F.size("vals") == N_BINS, F.col("vals")))
    found = score_runs(merge_runs(raw_regions(robust_stats(smooth(candidate_mask(ok, cfg), cfg), cfg)), cfg))
    return found.withColumn("regions", F.coalesce("regions", F.array().cast(f"array<{REGION}>"))).drop("runs")


def regions(detected: DataFrame) -> DataFrame:
    """One row per region, with its item."""
    return detected.select("item_id", F.inline("regions"))


def sparkline(values: Column) -> Column:
    """A profile as text, one of ten shades per bin."""
    ramp = F.lit(" .,-=+*#%@")
    shade = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 9 + 0.5).cast("int")
    return F.array_join(F.transform(values, lambda v: F.substr(ramp, shade(v) + 1, F.lit(1))), "")
