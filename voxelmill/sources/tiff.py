"""TIFF images without a library: baseline grey images in strips, uncompressed, deflated or packed; a writer for float images."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators import kernels
from voxelmill.operators.joins import resolve_files
from voxelmill.session import checkpoint_folder
from voxelmill.sources.tables import hadoop_path

GLOB = "*.{[tT][iI][fF],[tT][iI][fF][fF]}"
SCHEMA = "path string, rows int, cols int, data array<float>"
#: What a task reads: files, or bytes of them; and pixels of decoded images in a batch.
FILES, BYTES, PIXELS = 4096, 128 << 20, 1 << 20
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


def _unpack_bits(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        k += 1
        if n < 128:
            out += data[k : k + n + 1]
            k += n + 1
        elif n > 128:
            out += data[k : k + 1] * (257 - n)
            k += 1
    return bytes(out)


def decode(blob: bytes) -> np.ndarray:
    """The pages of a file as float32: one page gives rows x cols, several give pages x rows x cols."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or struct.unpack_from(order + "H", blob, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages = struct.unpack_from(order + "I", blob, 4)[0], []
    while at:
        n = struct.unpack_from(order + "H", blob, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * k)
            if kind in _CODE:
                place = at + 10 + 12 * k
                if _SIZE[kind] * count > 4:
                    place = struct.unpack_from(order + "I", blob, place)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{_CODE[kind]}", blob, place)
        at = struct.unpack_from(order + "I", blob, at + 2 + 12 * n)[0]
        one = lambda tag, default, t=tags: t.get(tag, (default,))[0]
        cols, rows, bits, packed = one(256, 0), one(257, 0), one(258, 1), one(259, 1)
        if one(277, 1) != 1 or bits not in (8, 16, 32, 64):
            raise ValueError("grey images of 8 to 64 bits only")
        kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)] }{bits // 8}")
        strips = [blob[a : a + b] for a, b in zip(tags[273], tags[279], strict=True)]
        if packed in (8, 32946):
            strips = [zlib.decompress(s) for s in strips]
        elif packed == 32773:
            strips = [_unpack_bits(s) for s in strips]
        elif packed != 1:
            raise ValueError(f"compression {packed} is not supported")
        page = np.frombuffer(b"".join(strips), kind, rows * cols).reshape(rows, cols)
        if one(317, 1) == 2:
            page = np.cumsum(page, axis=1, dtype=kind)
        pages.append(page.astype(np.float32))
    return pages[0] if len(pages) == 1 else np.stack(pages)


def encode(image: np.ndarray) -> bytes:
    """One page of little-endian float32."""
    rows, cols = image.shape
    data = np.ascontiguousarray(image, "<f4").tobytes()
    tags = [(256, 4, cols), (257, 4, rows), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, rows), (279, 4, len(data)), (339, 3, 3)]
    table = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return b"II*\x00" + struct.pack("<I", 8 + len(data)) + data + table


def image_2d(a: np.ndarray) -> np.ndarray:
    a = np.squeeze(a)
    if a.ndim != 2:
        raise ValueError(f"an image has two axes, not {a.ndim}")
    return a.astype(np.float32)


def _decoded(files: DataFrame, binning: tuple[int, int], margins: tuple[int, int, int, int]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lambda held: pd.DataFrame({"path": [p for p, _ in held], "rows": [i.shape[0] for _, i in held], "cols": [i.shape[1] for _, i in held], "data": [i.reshape(-1) for _, i in held]})
        for pdf in batches:
            held, size = [], 0
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                held.append((path, kernels.crop(kernels.block_mean(image_2d(decode(content)), binning), *margins)))
                size += held[-1][1].size
                if size >= PIXELS:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)

    # one file a row; a few rows a batch, as frames are large
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_images(spark: SparkSession, folder: str, binning: tuple[int, int] = (1, 1), margins: tuple[int, int, int, int] = (0, 0, 0, 0), recursive: bool = False) -> DataFrame:
    """(path, rows, cols, data) of the images of a folder (recursive: and of those below it), binned and cropped as they are decoded, so that full frames never leave a task."""

    files = _files(spark, folder, recursive)
    return spark.createDataFrame([], SCHEMA) if files is None else _decoded(files, binning, margins)


def _below(spark: SparkSession, folder: str) -> Column:
    """The path of a file below the folder."""
    root = F.lit(hadoop_path(spark, folder)[1].toUri().getPath().rstrip("/") + "/")
    return F.expr("path").substr(F.instr(F.col("path"), root) + F.length(root), F.length("path"))


def _files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame | None:
    """(path, content, length) of the images of a folder, None if there are none. Spark lists the folder itself, and is not handed each path.

    When Spark deals files out, each counts as 4 MB at least, so that small ones would be a task for a few; its partitions are put together to FILES files
    or BYTES, as long as every core has some.
    """
    fs, p = hadoop_path(spark, folder)
    if not fs.exists(p):
        return None
    # without the look into subfolders their names could be taken for columns
    found = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(folder)
    found = found if recursive else found.where(~F.contains(_below(spark, folder), F.lit("/")))
    least = 4 * spark.sparkContext.defaultParallelism
    size = found.coalesce(least).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    return found.coalesce(max(-(-size["n"] // FILES), -(-size["bytes"] // BYTES), least)) if size["n"] else None


def read_stack(spark: SparkSession, views: DataFrame, folder: str, binning: tuple[int, int] = (1, 1), margins: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """views (view_idx, filename, ...) with rows, cols and data; names may have folders; a missing file or a differing shape is an error. Rows keep the views' index."""
    nested = not views.where(F.contains(F.trim("filename"), F.lit("/"))).isEmpty()
    own = F.element_at(F.split("path", "/"), -1) if not nested else _below(spark, folder)
    files = _files(spark, folder, nested)
    paths = spark.createDataFrame([], "path string") if files is None else files.select(own.alias("path"))
    known = resolve_files(views.drop("path", "exists"), paths)
    lost = known.agg(F.count_if(~F.col("exists")).alias("missing")).first()["missing"]
    if lost:
        raise FileNotFoundError(f"{lost} images of {folder} are missing")
    images = (spark.createDataFrame([], SCHEMA) if files is None else _decoded(files, binning, margins)).withColumn("path", own)
    kept = f"{checkpoint_folder(spark)}/stack-{uuid.uuid4().hex}"
    joined = known.drop("exists").join(images, "path", "left").withColumn("exists", F.col("data").isNotNull())
    joined.write.parquet(kept)  # files are decoded once, for the shapes and for what comes after
    found = spark.read.schema(joined.schema).parquet(kept)
    if found.agg(F.count_distinct("rows", "cols").alias("shapes")).first()["shapes"] > 1:
        raise ValueError("the images differ in shape")
    return found


def write_images(df: DataFrame, folder: str, prefix: str = "view", index: str = "view_idx") -> DataFrame:
    """(path) of one TIFF per row, ``prefix_000012.tif``, each written by its task through a temporary name.

    folder must be a path that every executor mounts; on other stores write Parquet.
    """
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            out = []
            for k, rows, cols, data in zip(pdf[index], pdf["rows"], pdf["cols"], pdf["data"], strict=True):
                path = f"{folder}/{prefix}_{int(k):06d}.tif"
                with open(f"{path}.{os.getpid()}.part", "wb") as f:
                    f.write(encode(np.asarray(data, np.float32).reshape(rows, cols)))
                os.replace(f.name, path)
                out.append(path)
            yield pd.DataFrame({"path": out})

    return df.select(index, "rows", "cols", "data").mapInPandas(run, "path string")
