"""A folder of Info JSON files as a Spark data source: ``spark.read.format("info_json_dir")``."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class InfoJsonDir(DataSource):
    """One row per ``*.json`` file: its name and whole text. Options: ``path`` (a folder on shared
    storage) and ``perPartition``, the files a task reads (default 64)."""

    @classmethod
    def name(cls) -> str:
        return "info_json_dir"

    def schema(self) -> str:
        return "file_name string, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        if not self.options.get("path"):
            raise ValueError("info_json_dir needs a path")
        return _Reader(self.options["path"], int(self.options.get("perPartition", 64)))


class _Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(files[0] if files else None)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str, per: int) -> None:
        self.path, self.per = path, max(1, per)

    def partitions(self) -> list[InputPartition]:
        files = sorted(str(p) for p in Path(self.path).glob("*.json"))
        return [_Files(files[i : i + self.per]) for i in range(0, len(files), self.per)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for f in partition.files:
            yield Path(f).name, Path(f).read_text(encoding="utf-8", errors="replace")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(InfoJsonDir)
