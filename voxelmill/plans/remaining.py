"""Queries of operators that the other modules leave out: projections back, normal equations, smoothing, slabs, orders, numbers, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions import scalars
from voxelmill.operators import arrays, linear, select, stats, volumes
from voxelmill.plans.cubes import cubes
from voxelmill.plans.images import PIXELS, SIDE, images, long_form, rounded
from voxelmill.streaming import monitors


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a sparse matrix: supplier is the view's pixel, part the voxel, quantity the weight."""
    return _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("view_idx"), F.col("l_suppkey").alias("pixel"), F.col("l_partkey").alias("voxel"), (F.col("l_quantity") / 50).alias("w"))


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"), (F.col("p_size") / 10.0).alias("value"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per view and supplier."""
    return _relation(spark, sf_dir).select("view_idx", "pixel").distinct().withColumn("value", ((F.col("view_idx") + F.col("pixel")) % 7).cast("double"))


def backproject_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linear.backproject(_relation(spark, sf_dir), _measured(spark, sf_dir))
    return got.select("voxel", rounded(F.col("value"), 4).alias("value"))


def normal_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.normal(_relation(spark, sf_dir), _voxels(spark, sf_dir)).select("voxel", rounded(F.col("value"), 3).alias("value"))


def batch_gradient_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of every fifth view, scaled to stand for all."""
    got = linear.batch_gradient(_relation(spark, sf_dir), _voxels(spark, sf_dir), _measured(spark, sf_dir), F.col("view_idx") % 5 == 0, linear.subset_scale(50, 50, 10))
    return got.select("voxel", rounded(F.col("value"), 3).alias("value"))


def smooth_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian of 0.6 voxels, in slabs of two slices."""
    return _cells(volumes.smooth(cubes(spark, sf_dir), 4, 0.6, slab=2))


def slab_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slabs of three slices without their mean; the slices that slabs share are averaged."""
    return _cells(volumes.overlap_average(cubes(spark, sf_dir), 4, 3, 2, lambda cube: cube - cube.mean()))


def _cells(df: DataFrame) -> DataFrame:
    return df.select("volume_id", "z", F.posexplode("data").alias("k", "v")).select("volume_id", (F.col("z") * 16 + F.col("k")).cast("long").alias("i"), rounded(F.col("v").cast("double"), 4).alias("value"))


def _with_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = images(spark, sf_dir)
    return df.join(stats.mean_field(df, keys=["label"]).select("label", F.col("data").cast("array<double>").alias("mean")), "label")


def ssim_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity of each image to its data set's mean image."""
    return _with_means(spark, sf_dir).select("vec_id", rounded(stats.ssim(F.col("data"), F.col("mean"), SIDE, SIDE), 5).alias("ssim"))


def confidence_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole confidence map of each volume: its distance to the mean volume as correction, a tenth of its values as lost gradient."""
    from voxelmill.operators import quality

    z = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z")
    df = _with_means(spark, sf_dir).select(F.col("vec_id").alias("volume_id"), "data", "mean", z)
    part = lambda c: F.slice(c, F.col("z") * 16 + 1, 16)
    cut = df.select("volume_id", "z", F.lit(4).alias("ny"), F.lit(4).alias("nx"), F.zip_with(part("data"), part("mean"), lambda x, m: F.abs(x - m)).alias("delta"), F.transform(part("data"), lambda x: F.abs(x) / 10).alias("loss"))
    return _cells(quality.confidence(cut, 4, 0.35, 0.6, 0.05, 1.0)).withColumnRenamed("volume_id", "vec_id")


def support_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The support mask of each volume, and its own closing and dilation of what exceeds 0.5, in slabs of two slices."""
    from voxelmill.operators import masks

    df = cubes(spark, sf_dir)
    marked = masks.pack(df, lambda v: v > 0.5)
    found = {"support": masks.support(df, 4, 0.6, 1, slab=2), "closed": masks.close(marked, slab=2), "dilated": masks.dilate(marked, 2, slab=2)}
    parts = [m.select("volume_id", "z", F.lit(name).alias("kind"), masks.unpack(F.col("bits"), F.col("ny"), F.col("nx")).alias("mask")) for name, m in found.items()]
    slices = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("volume_id", "z").agg(*[F.max(F.when(F.col("kind") == name, F.col("mask"))).alias(name) for name in found])
    got = slices.select("volume_id", "z", F.posexplode(F.arrays_zip(*found)).alias("k", "m"))
    return got.select(F.col("volume_id").alias("vec_id"), (F.col("z") * 16 + F.col("k")).cast("long").alias("i"), "m.support", "m.closed", "m.dilated")


def denoise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each volume: the noise above a Gaussian of 0.6, and what that smoothing changes and keeps of the strongest edges."""
    from voxelmill.operators import quality

    df = cubes(spark, sf_dir)
    got = quality.denoise_quality(df, volumes.gaussian(df, 4, 0.6))
    return got.select(F.col("volume_id").alias("vec_id"), *[rounded(F.col(c), 5).alias(c) for c in ("noise", "correction", "edges")])


def _pixels(expr) -> callable:
    return lambda spark, sf_dir: long_form(images(spark, sf_dir), expr(F.col("data")))


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("view_idx"), (F.col("s_suppkey") * 7.7 % 50 - 25).alias("angle"))


def shifted_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images moved by a quarter row down and half a column left, edges repeated."""
    moved = arrays.shift(F.col("data"), F.lit(SIDE), F.lit(SIDE), F.lit(0.25), F.lit(-0.5), 1, "nearest")
    return long_form(images(spark, sf_dir), moved)


def low_resolution_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and geometry coarser by two."""
    from voxelmill.functions.geometry import Geometry
    from voxelmill.plans.fast import low_resolution

    views = images(spark, sf_dir).select(F.col("vec_id").alias("view_idx"), F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), "data")
    got, g = low_resolution(views, Geometry(200.0, 100.0, (SIDE, SIDE), (0.1, 0.1), (SIDE, SIDE, SIDE), (0.05, 0.05, 0.05)), 2)
    return got.select("view_idx", "rows", "cols", F.lit(g.detector_pixel[0]).alias("pixel_mm"), F.posexplode("data").alias("i", "v")).select("view_idx", F.col("i").cast("long").alias("i"), "rows", "cols", "pixel_mm", rounded(F.col("v").cast("double")).alias("value"))


def stacked_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main views and the anchors of the splits in use as one stack in the order of their angles."""
    from voxelmill.plans.fast import build_stack

    views = images(spark, sf_dir).select(F.col("vec_id").alias("view_idx"), (F.col("vec_id") * 7.7 % 50 - 25).alias("angle_rad"), F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), "data", "label")
    anchors = views.where("label >= 5").withColumn("split", F.when(F.col("view_idx") % 3 == 0, "tune").when(F.col("view_idx") % 3 == 1, "qc").otherwise("recon"))
    got = build_stack(views.where("label < 5").drop("label"), anchors.drop("label"), combine=False)
    return got.select(F.col("view_idx").cast("long").alias("view_idx"), rounded(F.col("angle_rad"), 6).alias("angle_rad"), rounded(F.col("data")[0].cast("double"), 5).alias("first"))


def raw_angle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.by_angle(_angles(spark, sf_dir), "angle", "view_idx", wrapped=False).select("view_idx", F.col("rank").cast("long").alias("rank"))


def reversed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten views from the end on, with the indexes that they had."""
    return select.reverse(_angles(spark, sf_dir), "view_idx").limit(10).select("view_idx")


def named_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice by name wins over the scores."""
    n = _t(spark, sf_dir, "nation")
    return select.select_named(n, "n_name", f" {n.agg(F.max('n_name')).first()[0].lower()} ").select("n_nationkey", "n_name")


def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders the one of least priority text and key."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderpriority", "o_orderkey").alias("rank"))
    return select.pick_available(o, "o_custkey", "rank").select("o_custkey", "o_orderkey")


def median_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_step(_angles(spark, sf_dir), "angle", "view_idx").select(rounded(F.col("step"), 6).alias("step"))


def mode_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.substring("c_mktsegment", 1, 1).alias("mode"))
    s = scalars.shift_signs(F.translate("mode", "BMFH", "bcdx"))
    return c.select("c_custkey", s["x"].alias("x"), s["y"].alias("y"))


def numbers_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return o.select("o_orderkey", scalars.general_number(F.col("o_totalprice"), 10).alias("written"), scalars.general_number(F.col("o_totalprice") / 1e9, 12).alias("small"), rounded(scalars.to_number(text, -1.0), 2).alias("read"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return monitors.event_stream(spark, sf_dir, "events.parquet", schema)


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type in each quarter of an hour, from a stream."""
    df = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    got = monitors.run_once(monitors.throttle(df, "ts", ["event_type"], 900, "3650 days"), f"t{uuid.uuid4().hex}", "complete")
    return got.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first"))


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, from a stream."""
    got = monitors.run_once(monitors.latest_only(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), "event_id", "user_id"), f"l{uuid.uuid4().hex}", "complete")
    return got.select("user_id", "event_id", "event_type")


_OUT = "round(v, 5) + 0.0 AS value"
_PX = f"WITH {PIXELS} "
_REL = "a AS (SELECT l_orderkey % 50 AS view_idx, l_suppkey AS pixel, l_partkey AS voxel, l_quantity / 50 AS w FROM lineitem), x AS (SELECT p_partkey AS voxel, p_size / 10.0 AS value FROM part), b AS (SELECT DISTINCT view_idx, pixel, CAST((view_idx + pixel) % 7 AS DOUBLE) AS value FROM a)"
_FWD = "f AS (SELECT view_idx, pixel, sum(w * value) AS p FROM a JOIN x USING (voxel) GROUP BY 1, 2)"
_CELLS = f"{PIXELS}, c AS (SELECT vec_id, i // 16 AS z, i // 4 % 4 AS y, i % 4 AS x, v FROM px)"
_ANGLES = "a AS (SELECT s_suppkey AS view_idx, s_suppkey * CAST(7.7 AS DOUBLE) % 50 - 25 AS angle FROM supplier)"
_KERNEL = """g AS (SELECT k, exp(-k * k / (2 * 0.6 * 0.6)) AS w FROM (SELECT unnest(range(-2, 3)) AS k)),
m AS (SELECT c, CASE WHEN c + k < 0 THEN -c - k - 1 WHEN c + k > 3 THEN 7 - c - k ELSE c + k END AS s, sum(w / (SELECT sum(w) FROM g)) AS w
      FROM g, (SELECT unnest(range(4)) AS c) GROUP BY 1, 2)"""

_MEAN = "mf AS (SELECT label, i, CAST(CAST(avg(v) AS FLOAT) AS DOUBLE) AS m FROM px GROUP BY 1, 2)"
#: Three passes of the kernel over the table c (vec_id, z, y, x, v).
_BLUR = "p AS (SELECT vec_id, z, y, m.c AS x, sum(w * v) AS v FROM c JOIN m ON m.s = c.x GROUP BY 1, 2, 3, 4), q AS (SELECT vec_id, z, m.c AS y, x, sum(w * v) AS v FROM p JOIN m ON m.s = p.y GROUP BY 1, 2, 3, 4), r AS (SELECT vec_id, m.c AS z, y, x, sum(w * v) AS v FROM q JOIN m ON m.s = q.z GROUP BY 1, 2, 3, 4)"

#: Steps to a voxel itself and its six neighbours.
_STEPS = "o AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS t(dz, dy, dx))"


def _morph(to: str, source: str, column: str, what: str) -> str:
    """A table ``to`` of ``source`` (vec_id, z, y, x, column): grown to face neighbours, or kept where all six are there and set."""
    value = f"max(n.{column})" if what == "grow" else f"CAST(sum(n.{column}) = 7 AS INTEGER)"
    return f"{to} AS (SELECT a.vec_id, a.z, a.y, a.x, {value} AS {column} FROM {source} a, o JOIN {source} n ON n.vec_id = a.vec_id AND n.z = a.z + dz AND n.y = a.y + dy AND n.x = a.x + dx GROUP BY 1, 2, 3, 4)"


QUERIES = {
    "shifted_pixels": (
        shifted_pixels,
        f"""WITH {PIXELS}, p AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, v FROM px), k AS (SELECT unnest(range(8)) AS k),
            a AS (SELECT p.vec_id, k.k AS r, p.c, sum(CASE WHEN p.r = k.k THEN 0.75 ELSE 0 END * v + CASE WHEN p.r = greatest(k.k - 1, 0) THEN 0.25 ELSE 0 END * v) AS v FROM p, k WHERE p.r IN (k.k, greatest(k.k - 1, 0)) GROUP BY 1, 2, 3),
            b AS (SELECT a.vec_id, a.r, k.k AS c, sum(CASE WHEN a.c = k.k THEN 0.5 ELSE 0 END * v + CASE WHEN a.c = least(k.k + 1, 7) THEN 0.5 ELSE 0 END * v) AS v FROM a, k WHERE a.c IN (k.k, least(k.k + 1, 7)) GROUP BY 1, 2, 3)
            SELECT vec_id, r * 8 + c AS i, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM b""",
    ),
    "low_resolution_views": (low_resolution_views, f"WITH {PIXELS} SELECT vec_id AS view_idx, i // 16 * 4 + i % 8 // 2 AS i, 4 AS rows, 4 AS cols, CAST(0.2 AS DOUBLE) AS pixel_mm, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM px GROUP BY 1, 2"),
    "stacked_views": (
        stacked_views,
        f"""WITH e AS (SELECT vec_id, vec_id * CAST(7.7 AS DOUBLE) % 50 - 25 AS a, CAST(label >= 5 AS INTEGER) AS part, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings WHERE label < 5 OR vec_id % 3 <> 1),
            n AS (SELECT *, row_number() OVER (ORDER BY part, vec_id) AS place FROM e)
            SELECT row_number() OVER (ORDER BY a, place) - 1 AS view_idx, round(a, 6) + 0.0 AS angle_rad, round(v, 5) + 0.0 AS first FROM n""",
    ),
    "support_volumes": (
        support_volumes,
        f"""WITH {_CELLS}, {_KERNEL}, {_BLUR}, {_STEPS},
            t AS (SELECT vec_id, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM px GROUP BY 1),
            s AS (SELECT vec_id, z, y, x, CAST(v > a + 0.02 * greatest(b - a, 1e-6) AS INTEGER) AS u FROM r JOIN t USING (vec_id)),
            {_morph("s1", "s", "u", "grow")}, {_morph("s2", "s1", "u", "shrink")}, {_morph("s3", "s2", "u", "grow")},
            e AS (SELECT vec_id, z, y, x, CAST(v > 0.5 AS INTEGER) AS u FROM c),
            {_morph("e1", "e", "u", "grow")}, {_morph("e2", "e1", "u", "shrink")}, {_morph("e3", "e1", "u", "grow")}
            SELECT vec_id, z * 16 + y * 4 + x AS i, CASE WHEN (max(s.u) OVER (PARTITION BY vec_id)) = 0 THEN 1 ELSE s3.u END AS support, e2.u AS closed, e3.u AS dilated
            FROM s JOIN s3 USING (vec_id, z, y, x) JOIN e2 USING (vec_id, z, y, x) JOIN e3 USING (vec_id, z, y, x)""",
    ),
    "denoise_quality": (
        denoise_quality,
        f"""WITH {_CELLS}, {_KERNEL}, {_BLUR},
            d AS (SELECT vec_id, z, y, x, c.v AS v, r.v AS s FROM c JOIN r USING (vec_id, z, y, x)),
            e AS (SELECT vec_id, v, s, sqrt(pow(coalesce(lead(v) OVER wx - v, 0), 2) + pow(coalesce(lead(v) OVER wy - v, 0), 2) + pow(coalesce(lead(v) OVER wz - v, 0), 2)) AS gv,
                         sqrt(pow(coalesce(lead(s) OVER wx - s, 0), 2) + pow(coalesce(lead(s) OVER wy - s, 0), 2) + pow(coalesce(lead(s) OVER wz - s, 0), 2)) AS gs FROM d
                  WINDOW wx AS (PARTITION BY vec_id, z, y ORDER BY x), wy AS (PARTITION BY vec_id, z, x ORDER BY y), wz AS (PARTITION BY vec_id, y, x ORDER BY z)),
            t AS (SELECT vec_id, quantile_cont(gv, 0.95) AS p, quantile_cont(v - s, 0.5) AS h FROM e GROUP BY 1)
            SELECT vec_id, round(1.4826 * quantile_cont(abs(v - s - h), 0.5), 5) + 0.0 AS noise, round(sum(abs(s - v)) / sum(abs(v)), 5) + 0.0 AS correction,
                   round((quantile_cont(gs, 0.5) FILTER (WHERE gv >= p)) / (quantile_cont(gv, 0.5) FILTER (WHERE gv >= p)), 5) + 0.0 AS edges
            FROM e JOIN t USING (vec_id) GROUP BY vec_id""",
    ),
    "ssim_to_mean": (
        ssim_to_mean,
        f"""WITH {PIXELS}, {_MEAN}, d AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, v AS x, m AS y, max(v) OVER (PARTITION BY vec_id) - min(v) OVER (PARTITION BY vec_id) AS span FROM px JOIN mf USING (label, i)),
            w AS (SELECT vec_id, a.r AS r0, b.c AS c0, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cv, any_value(span) AS s
                  FROM d JOIN (SELECT unnest([0, 1]) AS r) a ON d.r BETWEEN a.r AND a.r + 6 JOIN (SELECT unnest([0, 1]) AS c) b ON d.c BETWEEN b.c AND b.c + 6 GROUP BY 1, 2, 3)
            SELECT vec_id, round(avg((2 * mx * my + pow(0.01 * s, 2)) * (2 * cv + pow(0.03 * s, 2)) / ((mx * mx + my * my + pow(0.01 * s, 2)) * (vx + vy + pow(0.03 * s, 2)))), 5) + 0.0 AS ssim FROM w GROUP BY 1""",
    ),
    "confidence_volumes": (
        confidence_volumes,
        f"""WITH {PIXELS}, {_MEAN}, d AS (SELECT vec_id, i, v, abs(v - m) AS d FROM px JOIN mf USING (label, i)),
            t AS (SELECT vec_id, 2 * quantile_cont(d, 0.5) + 1e-12 AS tau FROM d GROUP BY 1),
            c AS (SELECT vec_id, i // 16 AS z, i // 4 % 4 AS y, i % 4 AS x, exp(-pow(d / tau, 2)) * exp(-pow(abs(v) / 10 / 0.35, 2)) AS v FROM d JOIN t USING (vec_id)),
            {_KERNEL}, {_BLUR} SELECT vec_id, z * 16 + y * 4 + x AS i, round(CAST(CAST(least(greatest(v, 0.05), 1.0) AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM r""",
    ),
    "backproject_sparse": (backproject_sparse, f"WITH {_REL} SELECT voxel, round(sum(w * value), 4) + 0.0 AS value FROM a JOIN b USING (view_idx, pixel) GROUP BY 1"),
    "normal_sparse": (normal_sparse, f"WITH {_REL}, {_FWD} SELECT voxel, round(sum(w * p), 3) + 0.0 AS value FROM a JOIN f USING (view_idx, pixel) GROUP BY 1"),
    "batch_gradient_sparse": (batch_gradient_sparse, f"WITH {_REL}, {_FWD} SELECT voxel, round(5 * sum(w * (p - value)), 3) + 0.0 AS value FROM a JOIN f USING (view_idx, pixel) JOIN b USING (view_idx, pixel) WHERE view_idx % 5 = 0 GROUP BY 1"),
    "smooth_volumes": (
        smooth_volumes,
        f"WITH {_CELLS}, {_KERNEL}, {_BLUR} SELECT vec_id AS volume_id, z * 16 + y * 4 + x AS i, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM r",
    ),
    "slab_average": (
        slab_average,
        f"WITH {_CELLS}, s AS (SELECT vec_id, avg(v) FILTER (WHERE z < 3) AS lo, avg(v) FILTER (WHERE z > 0) AS hi FROM c GROUP BY 1) SELECT vec_id AS volume_id, z * 16 + y * 4 + x AS i, round(CAST(CAST(CASE WHEN z = 0 THEN v - lo WHEN z = 3 THEN v - hi ELSE (v - lo + (v - hi)) / 2 END AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM c JOIN s USING (vec_id)",
    ),
    "without_log": (_pixels(lambda d: arrays.without_log(d)), _PX + "SELECT vec_id, i, round(greatest(v, 0), 5) + 0.0 AS value FROM px"),
    "weighted_pixels": (lambda spark, sf_dir: long_form(images(spark, sf_dir), arrays.scale(F.col("data"), F.col("label") + 0.5, squared=True)), _PX + "SELECT vec_id, i, round(v * (label + 0.5) * (label + 0.5), 5) + 0.0 AS value FROM px"),
    "finite_pixels": (_pixels(lambda d: arrays.replace_non_finite(F.transform(d, lambda v, i: F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(float("inf"))).otherwise(v)), 0.25)), _PX + "SELECT vec_id, i, CASE WHEN i % 7 = 0 OR i % 11 = 0 THEN 0.25 ELSE round(v, 5) + 0.0 END AS value FROM px"),
    "stretch_and_back": (lambda spark, sf_dir: long_form(images(spark, sf_dir).withColumns({"a": F.array_min("data"), "b": F.array_max("data")}), arrays.denormalise(arrays.normalise(F.col("data"), F.col("a"), F.col("b")), F.col("a"), F.col("b"))), _PX + f"SELECT vec_id, i, {_OUT} FROM px"),
    "metric_images": (
        _pixels(lambda d: arrays.metric_image(d, SIDE, SIDE, 0.2)),
        f"WITH {PIXELS}, p AS (SELECT vec_id, (i // 8 - 1) * 6 + i % 8 - 1 AS i, v FROM px WHERE i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6) SELECT vec_id, i, round((least(greatest(v, a), b) - a) / (b - a), 5) + 0.0 AS value FROM p JOIN (SELECT vec_id, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b FROM p GROUP BY 1) USING (vec_id)",
    ),
    "raw_angle_order": (raw_angle_order, f"WITH {_ANGLES} SELECT view_idx, row_number() OVER (ORDER BY angle, view_idx) - 1 AS rank FROM a"),
    "reversed_views": (reversed_views, "SELECT s_suppkey AS view_idx FROM supplier ORDER BY 1 DESC LIMIT 10"),
    "named_candidate": (named_candidate, "SELECT n_nationkey, n_name FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)"),
    "first_available": (first_available, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1"),
    "median_step": (median_step, f"WITH {_ANGLES} SELECT round(quantile_cont(d, 0.5), 6) + 0.0 AS step FROM (SELECT abs(angle - lag(angle) OVER (ORDER BY view_idx)) AS d FROM a)"),
    "mode_signs": (mode_signs, "SELECT c_custkey, CASE m WHEN 'A' THEN 1 WHEN 'B' THEN 1 WHEN 'M' THEN -1 WHEN 'F' THEN -1 END AS x, CASE m WHEN 'A' THEN 1 WHEN 'B' THEN -1 WHEN 'M' THEN 1 WHEN 'F' THEN -1 END AS y FROM (SELECT c_custkey, substr(c_mktsegment, 1, 1) AS m FROM customer)"),
    "numbers_as_text": (numbers_as_text, "SELECT o_orderkey, printf('%.10g', o_totalprice) AS written, printf('%.12g', o_totalprice / 1e9) AS small, CASE WHEN o_orderkey % 9 = 0 THEN -1.0 ELSE round(o_totalprice, 2) + 0.0 END AS read FROM orders"),
    "stream_throttle": (stream_throttle, "SELECT event_type, strftime(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM events GROUP BY 1, 2"),
    "stream_latest": (stream_latest, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
}
