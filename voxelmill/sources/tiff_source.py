"""TIFF images as a data source: ``spark.read.format("tiff_images")`` and ``df.write.format("tiff_images")``, after ``register(spark)``.

Reading gives (name, path, rows, cols, data); name is the path below the folder. Options: path, recursive, bins ("2,2"), crop
("top,bottom,left,right" in binned pixels), pixels (false: sizes only), pattern (names that match, as "set1/*"), names (a JSON list of those
wanted), files (the most images a partition reads), bytes (the most that they hold). No other file is opened. Spark's own push-down of filters
is not used: it keeps the filters of one query for the next one of the same DataFrame.

Writing takes (name, rows, cols, data), or view_idx in place of the name, which the option prefix completes. A task writes below a
temporary folder of its own; the driver moves the files of the tasks that ended well, when all have, and an aborted job leaves none. Mode
overwrite removes the images that were there, at the commit.

Paths are those that Arrow's file systems open (local folders, s3, gs, hdfs). For stores that only Spark reads, ``tiff.read_images`` goes through binaryFile.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxelmill.sources.changes import open_folder

FILES, BYTES, SUFFIXES = 64, 128 << 20, (".tif", ".tiff")


def _numbers(text: str, n: int, name: str) -> tuple[int, ...]:
    out = tuple(int(x) for x in text.split(","))
    if len(out) != n:
        raise ValueError(f"{name} takes {n} numbers")
    return out


def _listed(folder: str, recursive: bool) -> list[tuple[str, str, int]]:
    """(name, path, size) of the images below a folder; what is under way below a name that begins with an underscore is none."""
    from pyarrow import fs

    system, root = open_folder(folder)
    found = [(posixpath.relpath(f.path, root), f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=recursive)) if f.is_file]
    return sorted(x for x in found if x[0].lower().endswith(SUFFIXES) and not any(part.startswith(("_", ".")) for part in x[0].split("/")))


class _Run(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.bins, self.crop = _numbers(options.get("bins", "1,1"), 2, "bins"), _numbers(options.get("crop", "0,0,0,0"), 4, "crop")
        self.pixels, self.pattern = options.get("pixels", "true").lower() == "true", options.get("pattern", "*")
        self.names = set(json.loads(options["names"])) if "names" in options else None

    def partitions(self) -> list[InputPartition]:
        files, most = int(self.options.get("files", FILES)), int(self.options.get("bytes", BYTES))
        runs, size = [], 0
        for name, path, n in _listed(self.options["path"], self.options.get("recursive", "false").lower() == "true"):
            if not fnmatch(name, self.pattern) or (self.names is not None and name not in self.names):
                continue
            if not runs or len(runs[-1]) >= files or size + n > most:
                runs.append([])
                size = 0
            runs[-1].append((name, path))
            size += n
        return [_Run(r) for r in runs] or [_Run([])]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        from voxelmill.operators import kernels
        from voxelmill.sources.tiff import decode, image_2d

        system, _ = open_folder(self.options["path"])
        for name, path in partition.files:  # an image a batch, as frames are large
            with system.open_input_stream(path) as f:
                image = kernels.crop(kernels.block_mean(image_2d(decode(f.read())), self.bins), *self.crop)
            rows, cols = image.shape
            data = pa.array([image.reshape(-1) if self.pixels else None], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([rows], pa.int32()), pa.array([cols], pa.int32()), data], names=["name", "path", "rows", "cols", "data"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary path, name)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.prefix, self.overwrite = options["path"].rstrip("/"), options.get("prefix", "view"), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from voxelmill.sources.tiff import encode

        system, root = open_folder(self.folder)
        own, files = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=True)
        for batch in iterator:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                name = columns["name"][k].as_py() if "name" in columns else f"{self.prefix}_{columns['view_idx'][k].as_py():06d}.tif"
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} is no name below the folder")
                image = np.asarray(columns["data"][k].values.to_numpy(zero_copy_only=False), np.float32).reshape(columns["rows"][k].as_py(), columns["cols"][k].as_py())
                path = f"{own}/{len(files):08d}"
                with system.open_output_stream(path) as f:
                    f.write(encode(image))
                files.append((path, name))
        return _Written(files)

    def _clear(self) -> None:
        system, root = open_folder(self.folder)
        from pyarrow import fs

        try:
            system.delete_dir(f"{root}/_temporary/{self.job}")
        except FileNotFoundError:  # no task has begun
            return
        if not system.get_file_info(fs.FileSelector(f"{root}/_temporary")):
            system.delete_dir(f"{root}/_temporary")

    def commit(self, messages: list) -> None:
        system, root = open_folder(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        old = _listed(self.folder, True) if self.overwrite else []
        for folder in {posixpath.dirname(n) for n in names} - {""}:
            system.create_dir(f"{root}/{folder}", recursive=True)
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(lambda f: system.move(f[0], f"{root}/{f[1]}"), files))
        kept = set(names)
        for name, path, _ in old:
            if name not in kept:
                system.delete_file(path)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


class TiffImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_images"

    def schema(self) -> str:
        return "name string, path string, rows int, cols int, data array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not {"rows", "cols", "data"} <= set(schema.names) or not {"name", "view_idx"} & set(schema.names):
            raise ValueError("an image has rows, cols, data and a name or view_idx")
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiffImages)
