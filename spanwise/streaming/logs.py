"""Logs of runs as a stream of lines.

Each file is a log of one worker. Lines are read by Spark's file source, which takes a file up once it
is complete; what has been read is tracked in the query's checkpoint. :func:`spanwise.functions.scalars.log_chunk`
reads a growing log from a byte on instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow_logs(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """(worker, line) of the ``*.log`` files that appear in ``folder``; empty lines are left out.

    ``worker`` is the file's name without its ending, ``line`` begins with it in brackets. A stream;
    the order of a worker's lines is that of its file, that of workers is open.
    """
    rows = spark.readStream.option("pathGlobFilter", "*.log").option("maxFilesPerTrigger", files_per_batch).text(folder).select("value", F.col("_metadata.file_name").alias("file"))
    worker = F.regexp_replace("file", r"\.log$", "")
    line = F.regexp_replace("value", r"\r$", "")
    return rows.select(worker.alias("worker"), F.concat(F.lit("["), worker, F.lit("] "), line).alias("line")).filter(line != "")
