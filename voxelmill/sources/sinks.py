"""Sinks: metric, score and split tables, volumes and stacks, run folders, reports, and the data of previews."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.operators.arrays import clip, percentile
from voxelmill.sources.tables import hadoop_path


def iteration_times(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """df (iteration, elapsed_s, data_fidelity) with iteration_time_s, never negative, and data_residual."""
    w = Window.partitionBy(*keys).orderBy("iteration")
    before = F.lag("elapsed_s", 1, 0.0).over(w)
    return df.withColumns({"iteration_time_s": F.greatest(F.col("elapsed_s") - before, F.lit(0.0)), "data_residual": F.sqrt(F.greatest(2.0 * F.col("data_fidelity"), F.lit(0.0)))})


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A folder of CSV files with a header; with an order, one sorted file (for the few rows of metrics and scores)."""
    (df.orderBy(*order).coalesce(1) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_rows(spark: SparkSession, rows: Sequence[dict], path: str) -> DataFrame | None:
    """Dictionaries as CSV under the union of their keys, in first-seen order; nothing but an empty file without rows."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        write_text(spark, path, "")
        return None
    df = spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return df


def write_shifts(views: DataFrame, path: str, position: str = "view_idx") -> None:
    """x_shift_px and y_shift_px in view order, as ``tables.read_shifts`` reads them."""
    df = views.select(F.col(position).alias("__at"), F.col("x_shift_px").cast("double"), F.col("y_shift_px").cast("double"))
    df.orderBy("__at").drop("__at").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def union_rows(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_volume(df: DataFrame, path: str) -> None:
    """Slices as Parquet; the commit protocol replaces what was there as a whole."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


write_stack = write_volume


def split_table(views: DataFrame) -> DataFrame:
    """(index, angle_rad, angle_deg, split) of views (view_idx, angle_rad, split)."""
    return views.select(F.col("view_idx").alias("index"), F.col("angle_rad").cast("double").alias("angle_rad"), F.degrees(F.col("angle_rad").cast("double")).alias("angle_deg"), F.coalesce("split", F.lit("unused")).alias("split"))


def drift_manifest(views: DataFrame, prefix: str, x_sign: int = 1, y_sign: int = 1) -> DataFrame:
    """(index, source, output_name, angle_deg, angle_rad, x_shift_px, y_shift_px): what was exported under which name, with the shifts that were applied."""
    name = F.format_string(f"{prefix}_%06d.tif", F.col("view_idx").cast("int"))
    return views.select(F.col("view_idx").alias("index"), F.col("filename").alias("source"), name.alias("output_name"), "angle_deg", "angle_rad", (F.col("x_shift_px") * x_sign).alias("x_shift_px"), (F.col("y_shift_px") * y_sign).alias("y_shift_px"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any store, through a temporary name."""
    fs, p = hadoop_path(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{os.getpid()}.part")
    stream = fs.create(temporary, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if fs.exists(p):
        fs.delete(p, True)
    fs.rename(temporary, p)


def read_small(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode("utf-8")


def append_log(spark: SparkSession, path: str, message: str, now: float | None = None) -> None:
    """A line with the local time added to a log on any store (by rewriting it: object stores cannot append)."""
    fs, p = hadoop_path(spark, path)
    old = read_small(spark, path) if fs.exists(p) else ""
    write_text(spark, path, old + f"{time.strftime('%Y-%m-%d %H:%M:%S', time.localtime(now))} {message}\n")


def write_winner(spark: SparkSession, path: str, best: DataFrame) -> dict:
    """The one selected row as ``key: value`` lines, which ``sources.tables.key_values`` reads."""
    row = best.first().asDict()
    write_text(spark, path, "".join(f"{k}: {'' if v is None else v}\n" for k, v in row.items()))
    return row


@dataclass(frozen=True)
class RunFolders:
    """Where a run keeps what."""

    root: str

    def __getattr__(self, name: str) -> str:
        # The folders of a run.
        known = {"preprocessing": "preprocessing", "alignment": "alignment", "fdk": "fdk", "mbir": "mbir", "snapshots": "mbir/iteration_snapshots", "metrics": "metrics", "fast_recon": "fast_recon", "fast_anchors": "fast_recon/anchors", "fast_fdk_sweep": "fast_recon/fdk_sweep", "fast_prior": "fast_recon/prior", "fast_mbir_lite": "fast_recon/mbir_lite", "fast_qc": "fast_recon/qc"}
        if name in known:
            return f"{self.root}/{known[name]}"
        raise AttributeError(name)


def create_run(spark: SparkSession, output: str, now: float | None = None) -> RunFolders:
    """``run_YYYYmmdd_HHMMSS`` below output, numbered if it is there already."""
    base = f"{output}/run_{time.strftime('%Y%m%d_%H%M%S', time.localtime(now))}"
    root, n = base, 1
    while not hadoop_path(spark, root)[0].mkdirs(hadoop_path(spark, root)[1]) or n and hadoop_path(spark, f"{root}/.run")[0].exists(hadoop_path(spark, f"{root}/.run")[1]):
        root, n = f"{base}_{n}", n + 1
    write_text(spark, f"{root}/.run", "")
    return RunFolders(root)


def run_root(path: str) -> str:
    """A run's folder from any of the folders that may be given for it."""
    parts = path.rstrip("/").split("/")
    if len(parts) > 1 and parts[-2] == "fast_recon":
        parts = parts[:-1]
    while parts[-1:] == ["fast_recon"]:
        parts = parts[:-1]
    return "/".join(parts)


def fast_folder(spark: SparkSession, root: str, child: str) -> str:
    """A folder of the fast run, or its nested place in runs of old, if only that is there."""
    new, old = f"{run_root(root)}/fast_recon/{child}", f"{run_root(root)}/fast_recon/fast_recon/{child}"
    there = lambda p: hadoop_path(spark, p)[0].exists(hadoop_path(spark, p)[1])
    return old if there(old) and not there(new) else new


def report(title: str, sections: dict[str, dict | Sequence[str]]) -> str:
    """A Markdown report."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", ""]
        out += [f"- {k}: {v}" for k, v in body.items()] if isinstance(body, dict) else [f"- {line}" for line in body]
        out.append("")
    return "\n".join(out)


def preview(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with ``gray``: the image between its percentiles as 0 to 255."""
    # the ends are bound once, as a one-element array, so that the sort is not repeated per pixel
    ends = F.array(F.struct(percentile(F.col("data"), low).alias("a"), percentile(F.col("data"), high).alias("b")))
    scaled = F.transform(ends, lambda e: F.transform("data", lambda v: F.round(clip((v - e["a"]) / F.greatest(e["b"] - e["a"], F.lit(1e-12)), 0.0, 1.0) * 255).cast("int")))
    return df.withColumn("gray", F.get(scaled, 0))


def config_hash(config: dict) -> str:
    """Key of a cached intermediate: it is used again only under the same configuration."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached_stack(spark: SparkSession, folder: str, name: str, config: dict, make) -> DataFrame:
    """The intermediate of this name and configuration: read if it is there, else made and written."""
    path = f"{folder}/{name}-{config_hash(config)}"
    done = hadoop_path(spark, f"{path}/_SUCCESS")
    if not done[0].exists(done[1]):
        write_stack(make(), path)
    return spark.read.parquet(path)
