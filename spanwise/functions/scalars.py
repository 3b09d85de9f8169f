"""Formatting and escaping of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwise.operators.arrays import let
from spanwise.operators.fuse import utf8_truncate

__all__ = ["utf8_truncate", "hms", "fixed", "clip_filename", "ass_timestamp", "escape_ass", "escape_path", "words", "followers", "time_range", "zero_pad", "safe_id", "mime", "format_name", "drawtext_escape", "compact", "subline", "job_id", "job_time", "run_arguments", "pad", "log_chunk"]


def hms(sec: Column) -> Column:
    s = F.floor(sec + 0.5).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def fixed(x: Column, digits: int = 3) -> Column:
    """Fixed decimals, rounded by the number's exact binary value (ties to even), as C's printf does.

    A double is N / 2^k with whole N and k, so quotient and remainder are whole numbers too. For
    magnitudes from 2^-9 up to 2^52; smaller ones are 0.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    exponent = lambda size: F.least(F.lit(62), F.greatest(F.lit(1), 53 - F.floor(F.log2(F.greatest(size, F.lit(1e-3)))))).cast("int")

    def divide(v: Column) -> Column:
        power = F.pow(F.lit(2.0), v["k"])
        return F.struct((whole((v["size"] * power).cast("bigint")) * F.lit(10**digits).cast("decimal(6,0)")).cast("decimal(38,0)").alias("n"), whole(power.cast("bigint")).alias("p"))

    def nearest(v: Column) -> Column:
        twice = (v["n"] - whole(v["down"]) * v["p"]) * 2
        return v["down"] + F.when((twice > v["p"]) | ((twice == v["p"]) & (v["down"] % 2 == 1)), 1).otherwise(0)

    quotient = let(let(F.abs(x.cast("double")), lambda s: F.struct(s.alias("size"), exponent(s).alias("k"))), lambda v: let(divide(v), lambda d: let(F.struct(d["n"].alias("n"), d["p"].alias("p"), F.floor(d["n"] / d["p"]).cast("bigint").alias("down")), nearest)))
    text = let(quotient, lambda q: F.concat(F.floor(q / 10**digits).cast("bigint").cast("string"), F.lit("."), F.lpad((q % 10**digits).cast("string"), digits, "0")))
    return F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)


def clip_filename(index: Column, start: Column) -> Column:
    return F.concat(F.format_string("clip_%02d_", index.cast("int")), F.replace(hms(start), F.lit(":"), F.lit("")), F.lit(".mp4"))


def ass_timestamp(sec: Column) -> Column:
    """h:mm:ss.cc, half up; negative times are 0."""
    c = F.floor(F.greatest(sec, F.lit(0.0)) * 100 + 0.5).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360_000), F.floor(c % 360_000 / 6_000), F.floor(c % 6_000 / 100), c % 100)


def escape_ass(text: Column) -> Column:
    t = F.regexp_replace(text, r"([\\{}])", r"\\$1")
    return F.trim(F.translate(t, "\n\r", " "))


def escape_path(path: Column) -> Column:
    t = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.replace(F.replace(t, F.lit(":"), F.lit("\\:")), F.lit("'"), F.lit("\\'"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t\r\n]"), lambda w: w != "")


def followers(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(fixed(n / 1e6, 2), F.lit("M"))).when(n >= 1_000, F.concat(fixed(n / 1e3, 2), F.lit("K"))).otherwise(n.cast("string"))


def subline(handle: Column, n: Column) -> Column:
    """A channel's handle and size, either of which may be missing."""
    some = F.when(n > 0, F.concat(followers(n), F.lit(" subscribers")))
    return F.concat_ws("  ·  ", F.when(handle != "", handle), some)


def time_range(start: Column, end: Column) -> Column:
    return F.concat(F.lit("*"), fixed(start, 2), F.lit("-"), fixed(end, 2))


def zero_pad(n: Column, width: int) -> Column:
    return F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, "0"))


def zero_pad_to(n: Column, width: Column) -> Column:
    """:func:`zero_pad` to a width that differs from row to row."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))


def safe_id(name: Column) -> Column:
    return F.coalesce((name != "") & ~name.contains("..") & ~name.rlike(r"[/\\]"), F.lit(False))


#: Media types by file extension.
MIME = {"html": "text/html; charset=utf-8", "css": "text/css", "js": "application/javascript", "json": "application/json", "mp4": "video/mp4", "webm": "video/webm", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml", "txt": "text/plain; charset=utf-8", "log": "text/plain; charset=utf-8"}
#: Names of output formats.
FORMATS = {"blur": "916blur", "crop": "916crop", "orig": "orig"}


def mime(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def format_name(kind: Column) -> Column:
    """The name of an output format, "?" for any other."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), kind), F.lit("?"))


def drawtext_escape(text: Column) -> Column:
    """Text for a drawing filter's argument: backslash, colon, quote and percent escaped, controls dropped."""
    return F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x1f]", ""), r"([\\:'%])", r"\\$1")


def compact(x: Column) -> Column:
    """Six significant digits without trailing zeros."""
    g = F.format_string("%.6g", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(g, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def job_id(moment: Column) -> Column:
    """A job's name from the moment it began."""
    return F.date_format(moment, "yyyyMMdd-HHmmss-SSS")


def job_time(name: Column, *files: Column) -> Column:
    """When a run began: what its name ``web-20240131-235959-123`` says, else the earliest of ``files``' times."""
    digits = F.regexp_extract(name, r"^web-([0-9]{8}-[0-9]{6}-[0-9]{3})$", 1)
    named = F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMdd-HHmmss-SSS"))
    first = files[0] if len(files) == 1 else F.least(*files) if files else F.lit(None).cast("timestamp")
    return F.coalesce(named, first)


#: Parameters of a run as arguments. Numbers: the least value that counts is above the
#: second; texts: the second is the default, which is not passed; flags: the second is the default.
NUMBER_ARGUMENTS = (("max_clips", None, "-n"), ("clip_len", 0, "-l"), ("min_gap", 0, "--min-gap"))
TEXT_ARGUMENTS = (("format", None, "--format"), ("cookies", "none", "--cookies-from-browser"), ("source", "ytdlp", "--source"), ("detect", "fused", "--detect"), ("ytdlp", None, "--ytdlp"), ("ffmpeg", None, "--ffmpeg"))
FLAG_ARGUMENTS = (("dry_run", False, "--dry-run"), ("dump_heatmap", True, "--dump-heatmap"), ("keep_intro", False, "--keep-intro"), ("strict", False, "--strict"), ("full_download", False, "--full-download"), ("try_sections", False, "--try-sections"), ("verbose", False, "--verbose"))


def run_arguments(params: Column) -> Column:
    """The arguments of a run whose parameters are a VARIANT object, in a fixed order; others are ignored.

    Numbers, texts and flags of another JSON type count as absent.
    """
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(params, f"$.{name}", "variant")), F.lit(""))
    is_number = lambda name: kind(name).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
    none = F.array().cast("array<string>")
    parts = []
    for name, least, flag in NUMBER_ARGUMENTS:
        x = F.try_variant_get(params, f"$.{name}", "double")
        shown = compact(x) if least is not None else x.cast("bigint").cast("string")
        parts.append(F.when(is_number(name) & (F.lit(True) if least is None else x > least), F.array(F.lit(flag), shown)).otherwise(none))
    for name, default, flag in TEXT_ARGUMENTS:
        x = F.try_variant_get(params, f"$.{name}", "string")
        ok = (kind(name) == "STRING") & (x != "") & (F.lit(True) if default is None else x != default)
        parts.append(F.when(ok, F.array(F.lit(flag), x)).otherwise(none))
    for name, default, flag in FLAG_ARGUMENTS:
        x = F.when(kind(name) == "BOOLEAN", F.try_variant_get(params, f"$.{name}", "boolean"))
        parts.append(F.when(F.coalesce(x, F.lit(default)), F.array(F.lit(flag))).otherwise(none))
    return F.concat(*parts)


def pad(text: Column, width: int) -> Column:
    """Text filled with blanks up to a width; longer text stays."""
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def log_chunk(log: Column, offset: Column) -> Column:
    """What a log has from a byte on: (from, next, chunk). An offset beyond its end is its end."""
    view = F.encode(log, "UTF-8")
    at = F.least(F.greatest(offset, F.lit(0)), F.octet_length(log)).cast("long")
    return F.struct(at.alias("from"), F.octet_length(log).cast("long").alias("next"), F.make_valid_utf8(F.substring(view, (at + 1).cast("int"), F.octet_length(log)).cast("string")).alias("chunk"))
