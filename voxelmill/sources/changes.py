"""A streaming source of small CSV files that are rewritten in place: a file that changed is read again, a file that went is reported.

The offset is the list of files with their time and size, so a restart knows what it has read. Paths are any that Arrow's file systems open
(local folders, s3, gs, hdfs); list and read happen in Python, a file is one partition.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, place long, values map<string,string>"


def open_folder(folder: str):
    """(file system, path in it) of a URI or a local path; Hadoop writes file:/ where Arrow takes a plain path."""
    from pyarrow import fs

    local = "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder
    return fs.FileSystem.from_uri(folder) if "://" in local else (fs.LocalFileSystem(), local)


class _File(InputPartition):
    def __init__(self, path: str, modified: int):
        self.path, self.modified = path, modified


class _Folder:
    """What both readers share."""

    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*.csv")

    def listed(self) -> dict[str, list[int]]:
        from pyarrow import fs

        system, root = open_folder(self.folder)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return {f.path: [f.mtime_ns, f.size] for f in sorted(found, key=lambda f: f.path) if f.is_file and fnmatch(f.base_name, self.pattern)}

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """A row of place -1 for the file itself, then its rows; a file that is no longer there has the first only."""
        at = datetime.fromtimestamp(partition.modified / 1e9, timezone.utc)
        yield partition.path, at, -1, None
        try:
            with open_folder(self.folder)[0].open_input_stream(partition.path) as f:
                text = f.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return
        for place, row in enumerate(csv.DictReader(io.StringIO(text))):
            yield partition.path, at, place, {k: v for k, v in row.items() if k is not None and isinstance(v, str)}


class _Reader(_Folder, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [_File(path, modified) for path, (modified, _) in self.listed().items()]


class _Changes(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": self.listed()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = start["files"], end["files"]
        changed = [_File(path, stat[0]) for path, stat in new.items() if old.get(path) != stat]
        return changed + [_File(path, old[path][0]) for path in old if path not in new]


class MetricFiles(DataSource):
    """``spark.read`` and ``spark.readStream`` with format metric_files; options path and pattern."""

    @classmethod
    def name(cls) -> str:
        return "metric_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options)


def changed_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """A stream of (path, modified, place, values): the rows of new and changed files."""
    spark.dataSource.register(MetricFiles)
    return spark.readStream.format("metric_files").option("path", folder).option("pattern", pattern).load()


def keep_current(stream: DataFrame, table: str, checkpoint: str):
    """A running query that keeps the rows of each file's newest version in a Parquet table: the partition of a file is replaced as a whole."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("source", F.col("path")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()


def current_rows(spark: SparkSession, table: str) -> DataFrame:
    """(path, modified, place, values) of the files as they are now."""
    return spark.read.schema(f"{SCHEMA}, source string").parquet(table).where("place >= 0").drop("source")
