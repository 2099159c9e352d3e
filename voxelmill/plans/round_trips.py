"""What sinks write and sources read back, below the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.scalars import to_number
from voxelmill.plans.cubes import cubes
from voxelmill.plans.images import PIXELS, SIDE, images, long_form, rounded
from voxelmill.session import checkpoint_folder
from voxelmill.sources import resume, sinks, tables, tiff


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as views with angles, shifts and, for two in three, a split."""
    s = _supplier(spark, sf_dir)
    key = F.col("s_suppkey")
    return s.select(key.alias("view_idx"), F.concat(F.lit("p"), key.cast("string"), F.lit(".tif")).alias("filename"), (key * 0.01).alias("angle_rad"), F.degrees(key * 0.01).alias("angle_deg"), (F.col("s_acctbal") / 1000).alias("x_shift_px"), F.col("s_nationkey").cast("double").alias("y_shift_px"), F.when(key % 3 == 0, "tune").when(key % 3 == 1, "qc").alias("split"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as one sorted CSV, found in its folder and read with row numbers."""
    path = _folder(spark, "csv")
    sinks.write_csv(_supplier(spark, sf_dir).select("s_suppkey", "s_name", "s_acctbal"), path, ["s_suppkey"])
    got = tables.read_csv(spark, tables.find_csv(spark, path))
    return got.select(F.col("row_index").cast("long").alias("row_index"), F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", rounded(to_number(F.col("s_acctbal"), float("nan")), 2).alias("s_acctbal"))


def shift_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "shifts")
    sinks.write_shifts(_views(spark, sf_dir), path)
    got = tables.read_shifts(spark, tables.find_csv(spark, path))
    return got.select(F.col("row_index").cast("long").alias("row_index"), *[rounded(F.col(c).cast("double"), 4).alias(c) for c in ("x_shift_px", "y_shift_px")])


def volume_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "volume")
    sinks.write_volume(cubes(spark, sf_dir), path)
    back = resume.required_volume(spark, path)
    return back.select("volume_id", F.posexplode("data").alias("k", "v"), "z").select("volume_id", (F.col("z") * 16 + F.col("k")).cast("long").alias("i"), rounded(F.col("v")).alias("value"))


def cached_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second request reads what the first one wrote."""
    folder, config = _folder(spark, "stacks"), {"binning": [1, 1]}
    sinks.cached_stack(spark, folder, "views", config, lambda: images(spark, sf_dir))
    back = sinks.cached_stack(spark, folder, "views", config, lambda: images(spark, sf_dir).limit(0))
    return long_form(back, F.col("data"))


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TIFF per image, read back by name as a stack with bins of 2 x 2."""
    folder = _folder(spark, "images").removeprefix("file:")
    df = images(spark, sf_dir).select(F.col("vec_id").alias("view_idx"), F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), F.col("data").cast("array<float>").alias("data"))
    df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "view_idx")  # rows are small, their files are work
    sinks.write_volume(tiff.write_images(df, folder), f"{folder}-names")  # each task writes its files, and their names here
    names = spark.read.parquet(f"{folder}-names").select(F.element_at(F.split("path", "/"), -1).alias("filename"))
    views = names.select(F.regexp_extract("filename", r"(\d+)\.tif$", 1).cast("long").alias("view_idx"), "filename")
    stack = tiff.read_stack(spark, views, folder, (2, 2))
    return stack.select(F.col("view_idx").alias("vec_id"), F.posexplode("data").alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), rounded(F.col("value").cast("double")).alias("value"))


def winner_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier by name as key: value lines, read back."""
    from voxelmill.operators.select import select_min

    path = _folder(spark, "winner") + ".yaml"
    s = _supplier(spark, sf_dir).select("s_suppkey", "s_name", "s_nationkey")
    sinks.write_winner(spark, path, select_min(s.withColumn("score", F.col("s_suppkey").cast("double")), "score", "s_suppkey").drop("score"))
    return tables.key_values(spark, path)


def angle_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees in a text file, one a line, as radians in the file's order."""
    path = _folder(spark, "angles")
    s = _supplier(spark, sf_dir).orderBy("s_suppkey").select((F.col("s_suppkey") * 0.25).cast("string").alias("value"))
    s.coalesce(1).write.text(path)
    return tables.angles(spark, path=path).select("view_idx", rounded(F.col("angle_rad"), 8).alias("angle_rad"))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.split_table(_views(spark, sf_dir)).select("index", rounded(F.col("angle_rad"), 6).alias("angle_rad"), rounded(F.col("angle_deg"), 6).alias("angle_deg"), "split")


def drift_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sinks.drift_manifest(_views(spark, sf_dir), "view", x_sign=-1)
    return got.select("index", "source", "output_name", rounded(F.col("angle_deg"), 6).alias("angle_deg"), rounded(F.col("x_shift_px"), 6).alias("x_shift_px"), rounded(F.col("y_shift_px"), 6).alias("y_shift_px"))


def preview_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sinks.preview(images(spark, sf_dir))
    return got.select("vec_id", F.posexplode("gray").alias("i", "gray")).select("vec_id", F.col("i").cast("long").alias("i"), "gray")


def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory lines made of parts, some without a reading; the totals of those that have all."""
    from voxelmill.operators.stats import gpu_totals

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    free = F.when(F.col("p_partkey") % 10 == 0, F.lit("[N/A]")).otherwise((F.col("p_size") * 100).cast("string"))
    got = gpu_totals(tables.parse_inventory(p.select(F.concat_ws(", ", F.col("p_partkey").cast("string"), F.lit("gpu"), F.lit("8192"), free).alias("line"))))
    return got.select("n", *[rounded(F.col(c), 6).alias(c) for c in ("min_free", "min_total", "sum_free", "sum_total")])


_VIEWS = "v AS (SELECT s_suppkey AS k, 'p' || s_suppkey || '.tif' AS f, s_suppkey * CAST(0.01 AS DOUBLE) AS a, s_acctbal / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)"
_PIXEL = f"WITH {PIXELS} "

QUERIES = {
    "csv_round_trip": (csv_round_trip, "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_index, s_suppkey, s_name, round(s_acctbal, 2) + 0.0 AS s_acctbal FROM supplier"),
    "shift_round_trip": (shift_round_trip, f"WITH {_VIEWS} SELECT row_number() OVER (ORDER BY k) - 1 AS row_index, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 4) + 0.0 AS x_shift_px, round(y, 4) + 0.0 AS y_shift_px FROM v"),
    "volume_round_trip": (volume_round_trip, _PIXEL + "SELECT vec_id AS volume_id, i, round(v, 5) + 0.0 AS value FROM px"),
    "cached_stack": (cached_stack, _PIXEL + "SELECT vec_id, i, round(v, 5) + 0.0 AS value FROM px"),
    "image_files": (image_files, f"WITH {PIXELS}, p AS (SELECT vec_id, i // 16 * 4 + i % 8 // 2 AS i, v FROM px) SELECT vec_id, i, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM p GROUP BY 1, 2"),
    "winner_round_trip": (winner_round_trip, "WITH s AS (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 1) SELECT 's_suppkey' AS key, CAST(s_suppkey AS VARCHAR) AS value FROM s UNION ALL SELECT 's_name', s_name FROM s UNION ALL SELECT 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM s"),
    "angle_file": (angle_file, "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS view_idx, round(radians(s_suppkey * 0.25), 8) + 0.0 AS angle_rad FROM supplier"),
    "split_rows": (split_rows, f"WITH {_VIEWS} SELECT k AS index, round(a, 6) + 0.0 AS angle_rad, round(degrees(a), 6) + 0.0 AS angle_deg, CASE k % 3 WHEN 0 THEN 'tune' WHEN 1 THEN 'qc' ELSE 'unused' END AS split FROM v"),
    "drift_manifest": (drift_manifest, f"WITH {_VIEWS} SELECT k AS index, f AS source, 'view_' || lpad(CAST(k AS VARCHAR), 6, '0') || '.tif' AS output_name, round(degrees(a), 6) + 0.0 AS angle_deg, round(-x, 6) + 0.0 AS x_shift_px, round(y, 6) + 0.0 AS y_shift_px FROM v"),
    "preview_gray": (preview_gray, _PIXEL + "SELECT vec_id, i, CAST(round(least(greatest((v - a) / greatest(b - a, 1e-12), 0.0), 1.0) * 255) AS INTEGER) AS gray FROM px JOIN (SELECT vec_id, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b FROM px GROUP BY 1) USING (vec_id)"),
    "inventory_totals": (inventory_totals, "SELECT count(*) AS n, round(min(p_size * 100 / 1024.0), 6) + 0.0 AS min_free, 8.0::DOUBLE AS min_total, round(sum(p_size * 100 / 1024.0), 6) + 0.0 AS sum_free, CAST(8.0 * count(*) AS DOUBLE) AS sum_total FROM part WHERE p_partkey % 10 <> 0"),
}
