"""Caption files (WebVTT) as cues, one per text line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that are no text.
METADATA = "^(WEBVTT|Kind:|Language:|NOTE|STYLE|Style:|Region:)"


def timestamp(text: Column) -> Column:
    """Seconds of h:m:s.ms or m:s.ms; -1 for anything else. The part after the point counts thousandths."""
    part = lambda i: F.regexp_extract(text, r"^\s*(?:([0-9]+):)?([0-9]+):([0-9]+)\.([0-9]+)", i)
    number = lambda i: F.coalesce(part(i).try_cast("double"), F.lit(0.0))
    return F.when(part(3) != "", number(1) * 3600 + number(2) * 60 + number(3) + number(4) / 1000.0).otherwise(-1.0)


def strip_tags(line: Column) -> Column:
    """Text without tags; an unfinished tag takes the rest. Blanks collapse."""
    text = F.regexp_replace(line, "<[^>]*(>|$)", "")
    return F.trim(F.regexp_replace(F.replace(text, F.lit(">"), F.lit("")), "[ \\t\\r]+", " "))


def cue_lines(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, line_no, start_sec, end_sec, text): text lines under the last timing line before them.

    A timing line that does not parse has start -1; its lines, like those before any timing line,
    are dropped. Null and empty files give no rows. A file is one row, so its lines are carried
    forward inside the row.
    """
    line = lambda x: F.regexp_replace(x, r"^\s+", "")
    rows = files.select(F.col(id_col).alias("item_id"), F.split(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), "\n").alias("ls"))
    # line numbers of timing lines; a text line belongs to the last one before it
    at = F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.contains(F.get("ls", i), F.lit("-->")))
    rows = rows.withColumn("at", at).withColumn("to", F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("ls"))))
    blocks = rows.filter(F.size("at") > 0).select("item_id", "ls", F.explode(F.arrays_zip("at", "to")).alias("b"))
    head = F.get("ls", F.col("b.at"))
    timed = blocks.select("item_id", timestamp(F.substring_index(head, "-->", 1)).alias("start_sec"), timestamp(line(F.regexp_extract(head, "-->(.*)$", 1))).alias("end_sec"), F.col("b.at").alias("first"), F.slice("ls", F.col("b.at") + 2, F.col("b.to") - F.col("b.at") - 1).alias("texts"))
    lines = timed.filter("start_sec >= 0").select("item_id", "start_sec", "end_sec", "first", F.posexplode("texts").alias("k", "raw"))
    text = lines.withColumn("text", strip_tags(F.col("raw"))).filter((F.col("text") != "") & ~F.col("text").rlike(METADATA))
    return text.select("item_id", (F.col("first") + 1 + F.col("k")).alias("line_no"), "start_sec", "end_sec", "text")


def drop_repeats(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Cues without those that repeat the text before them; cue_idx counts what is left."""
    from pyspark.sql import Window

    w = Window.partitionBy("item_id").orderBy(order)
    kept = lines.withColumn("before", F.lag("text").over(w)).filter("NOT (text <=> before)")
    return kept.withColumn("cue_idx", (F.row_number().over(w) - 1).cast("int")).select("item_id", "cue_idx", "start_sec", "end_sec", "text")


def parse(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cues (item_id, cue_idx, start_sec, end_sec, text) of caption files."""
    return drop_repeats(cue_lines(files, id_col, text_col))
