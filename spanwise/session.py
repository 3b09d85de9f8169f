"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table (a Parquet file or a folder of Parquet files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder in which intermediate tables may be kept.

    The cluster names it in ``spark.checkpoint.dir``. Only a session that runs in one process
    (master ``local`` or ``local[...]``, as in tests) may leave it unset and gets a temporary folder
    of this machine; on any other master an unset folder is an error, as executors would each write
    to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset; on {master} it must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spanwise-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that several consumers share one computation, and survives the loss of
    executors, unlike a local checkpoint. It stays until :func:`release` or the end of the driver.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _KEPT.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None) -> int:
    """Removes the tables kept by ``spark`` (by any session if None); how many there were.

    DataFrames that read them can no longer be run. Runs by itself when the driver ends.
    """
    mine = [(s, p) for s, p in _KEPT if spark is None or s is spark]
    for s, path in mine:
        _KEPT.remove((s, path))
        try:
            target = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001, S112 - the session has ended; its folder's owner clears what is left
            continue
    return len(mine)


atexit.register(release)
