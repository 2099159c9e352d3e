"""Queries of resampled volumes, spline shifts, recovered drift, image data sources, table functions and throttled streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators import arrays, table_functions, volumes
from voxelmill.plans.cubes import _GRAD, _adjoint, cubes
from voxelmill.plans.images import PIXELS, SIDE, images, long_form, rounded
from voxelmill.session import checkpoint_folder
from voxelmill.sources import tiff_source
from voxelmill.streaming import monitors


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(df: DataFrame) -> DataFrame:
    i = (F.col("z") * F.col("ny") * F.col("nx") + F.col("k")).cast("long")
    return df.select("volume_id", "z", "ny", "nx", F.posexplode("data").alias("k", "v")).select("volume_id", i.alias("i"), rounded(F.col("v")).alias("value"))


def resampled_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 4 to 3 x 5 x 2, linearly."""
    return _cells(volumes.resample(cubes(spark, sf_dir), (3, 5, 2)))


def averaged_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 4 to 2 x 1 x 4, whose sizes all divide: means of blocks."""
    return _cells(volumes.resample(cubes(spark, sf_dir), (2, 1, 4)))


def _spline_shift(order: int, mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long_form(images(spark, sf_dir), arrays.shift(F.col("data"), F.lit(SIDE), F.lit(SIDE), F.lit(0.25), F.lit(-0.5), order, mode))

    return query


def recovered_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image rolled by a few rows and columns, and the drift that is found between the two."""
    from voxelmill.plans.preprocess import pair_shifts

    r, c = F.col("vec_id") % 3 - 1, F.col("vec_id") % 5 - 2
    moved = arrays.gather(F.col("data"), F.lit(SIDE * SIDE), lambda k: F.pmod(F.floor(k / SIDE) - r, F.lit(SIDE)) * SIDE + F.pmod(k % SIDE - c, F.lit(SIDE)))
    pairs = images(spark, sf_dir).select("vec_id", F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), moved.alias("reference"), "data")
    return pair_shifts(pairs, "vec_id").select("vec_id", rounded(F.col("y_shift_px"), 4).alias("rows"), rounded(F.col("x_shift_px"), 4).alias("cols"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The images as TIFF files, a folder per data set."""
    tiff_source.register(spark)
    folder = f"{checkpoint_folder(spark)}/tiff-{uuid.uuid4().hex}"
    name = F.format_string("set%d/p%06d.tif", "label", "vec_id")
    images(spark, sf_dir).select(name.alias("name"), F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), F.col("data").cast("array<float>").alias("data")).write.format("tiff_images").mode("append").save(folder)
    return folder


def image_source_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written and read by the data source: bins of 2 x 2, then the first row and the last column are cropped."""
    back = spark.read.format("tiff_images").option("recursive", True).option("bins", "2,2").option("crop", "1,0,0,1").load(_written(spark, sf_dir))
    key = F.regexp_extract("name", r"p(\d+)\.tif$", 1).cast("long")
    return back.select(key.alias("vec_id"), "rows", "cols", F.posexplode("data").alias("i", "v")).select("vec_id", "rows", "cols", F.col("i").cast("long").alias("i"), rounded(F.col("v").cast("double")).alias("value"))


def image_source_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and folders of all images, without their pixels."""
    back = spark.read.format("tiff_images").option("recursive", True).option("pixels", False).load(_written(spark, sf_dir))
    return back.select(F.substring_index("name", "/", 1).alias("folder"), F.col("rows").cast("long").alias("rows"), F.size("data").alias("s")).groupBy("folder", "rows").agg(F.count(F.lit(1)).alias("n"))


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of candidates for each part, from minus to plus half its size."""
    table_functions.register(spark)
    s = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / -2.0).alias("a"), (F.col("p_size") / 2.0).alias("b"), (0.5 + F.col("p_partkey") % 4 * 0.25).alias("step"))
    return spark.sql("SELECT s.p_partkey, g.place, round(g.value, 8) + 0.0 AS value FROM {s} s, LATERAL candidate_grid(s.a, s.b, s.step) g", s=s)


def fine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine grid round each supplier's balance in thousands, for coarse steps of 1 to 3."""
    table_functions.register(spark)
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 1000, 1).alias("best"), (1.0 + F.col("s_suppkey") % 3).alias("step"))
    return spark.sql("SELECT s.s_suppkey, g.place, round(g.value, 8) + 0.0 AS value FROM {s} s, LATERAL fine_grid(s.best, s.step) g", s=s)


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in batches of four and in three shards: the places of each."""
    table_functions.register(spark)
    s = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return spark.sql("SELECT s.o_custkey, 'batch' AS kind, b.batch AS place, b.first, b.last FROM {s} s, LATERAL batch_list(s.n, 4L) b UNION ALL SELECT s.o_custkey, 'shard', b.shard, b.first, b.last FROM {s} s, LATERAL shard_list(s.n, 3L) b", s=s)


def stream_throttle_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each type the events that come a quarter of an hour or more after the last that passed, from a stream."""
    schema = _t(spark, sf_dir, "events").schema
    df = monitors.event_stream(spark, sf_dir, "events.parquet", schema).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    got = monitors.run_once(monitors.throttle_since(df, "ts", ["event_type"], 900, ["event_id"]), f"s{uuid.uuid4().hex}", "append")
    return got.select("event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a geometry table under names that have to be found: a full turn whose last angle is the first one again, shifts in two columns."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal", "s_nationkey")
    ends = s.agg(F.min("k").alias("a"), F.max("k").alias("b"))
    turn = s.crossJoin(F.broadcast(ends))  # one row
    return turn.select("k", F.concat(F.lit(" p"), F.col("k").cast("string"), F.lit(".tif ")).alias("Projection Image"), (360.0 * (F.col("k") - F.col("a")) / (F.col("b") - F.col("a"))).alias("Theta_Deg (stage)"), (F.col("s_acctbal") / 100).alias("u_shift_px"), F.col("s_nationkey").cast("double").alias("row_shift_px"))


def _validated(spark: SparkSession, sf_dir: str):
    from voxelmill.plans.metadata import validate
    from voxelmill.sources import sinks, tables

    path = _new_folder(spark, "geometry")
    sinks.write_csv(_geometry(spark, sf_dir), path, ["k"])
    return validate(spark, tables.read_csv(spark, tables.find_csv(spark, path)), path, x_shift="u_shift_px", y_shift="row_shift_px")


def _view_rows(views: DataFrame) -> DataFrame:
    return views.select(F.col("view_idx").cast("long").alias("view_idx"), "filename", *[rounded(F.col(c).cast("double"), 3).alias(c) for c in ("angle_deg", "angle_rad", "x_shift_px", "y_shift_px")], "exists")


def validated_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of a geometry table whose columns are found by hints; the last row, which repeats the first angle, is dropped; no file is there."""
    return _view_rows(_validated(spark, sf_dir).views)


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the summary and the warnings say, a row each."""
    v = _validated(spark, sf_dir)
    facts = {k: v.summary[k] for k in ("views", "direction", "has_x", "has_y", "endpoint_detected", "endpoint_removed", "angle_source")} | {"warnings": len(v.warnings), "missing": v.missing.count(), "duplicates": v.duplicates.count()}
    return spark.createDataFrame([(k, str(x).lower()) for k, x in facts.items()], "fact string, value string")


def coarser_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third view, with shifts in pixels of 2 x 4."""
    from voxelmill.plans.metadata import coarser_views

    return _view_rows(coarser_views(_validated(spark, sf_dir), (2, 4), 3).views)


def aliased_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts under other names than their own, found by their aliases."""
    from voxelmill.sources import sinks, tables

    path = _new_folder(spark, "aliases")
    sinks.write_csv(_geometry(spark, sf_dir).select("k", "u_shift_px", F.col("row_shift_px").alias(" Row_Shift_Px ")), path, ["k"])
    got = tables.read_shifts(spark, tables.find_csv(spark, path))
    return got.select(F.col("row_index").cast("long").alias("row_index"), *[rounded(F.col(c).cast("double"), 3).alias(c) for c in ("x_shift_px", "y_shift_px")])


def resumed_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's saved prior, its confidence and, as none was saved, a support of ones."""
    from voxelmill.sources import resume, sinks

    run, df = _new_folder(spark, "run"), cubes(spark, sf_dir)
    folder = sinks.fast_folder(spark, run, "prior")
    sinks.write_volume(df, f"{folder}/{resume.PRIOR}")
    sinks.write_volume(df.withColumn("data", F.transform("data", lambda v: v / 2)), f"{folder}/{resume.CONFIDENCE}")
    got = resume.saved_prior(spark, run, required=True)
    named = lambda d, c: d.select("volume_id", "z", F.col("data").alias(c))
    both = named(got.volume, "prior").join(named(got.confidence, "confidence"), ["volume_id", "z"]).join(named(got.support, "support"), ["volume_id", "z"])
    cells = both.select("volume_id", "z", F.posexplode(F.arrays_zip("prior", "confidence", "support")).alias("k", "c"))
    return cells.select("volume_id", (F.col("z") * 16 + F.col("k")).cast("long").alias("i"), *[rounded(F.col(f"c.{c}").cast("double")).alias(c) for c in ("prior", "confidence", "support")])


def dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as dictionaries, those of odd keys without a region, as one CSV under the union of their keys, read back."""
    from voxelmill.sources import sinks, tables

    path = _new_folder(spark, "rows")
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
    sinks.write_rows(spark, [r.asDict() if r["n_nationkey"] % 2 == 0 else {"n_nationkey": r["n_nationkey"], "n_name": r["n_name"]} for r in rows], path)
    return tables.read_csv(spark, tables.find_csv(spark, path)).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def denoised_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of total-variation denoising."""
    return _cells(volumes.tv_denoise(cubes(spark, sf_dir), 4, 0.1, 0.01, iterations=1).withColumn("data", F.transform("data", lambda v: v.cast("double"))))


#: Places and weights of an axis of four resampled to n, ends on ends.
_AXIS = "{a} AS (SELECT k, low + d AS s, CASE d WHEN 0 THEN 1 - (p - low) ELSE p - low END AS w FROM (SELECT k, p, least(floor(p), 2) AS low FROM (SELECT k, k * 3.0 / ({n} - 1) AS p FROM (SELECT unnest(range({n})) AS k))), (SELECT unnest([0, 1]) AS d))"
_VOX = f"{PIXELS}, c AS (SELECT vec_id, i // 16 AS z, i // 4 % 4 AS y, i % 4 AS x, v FROM px)"


def _spline_sql(order: int, mode: str) -> str:
    """Two passes with the B-spline as a function of the distance; places are drawn to the ends, or folded."""
    b = {2: "CASE WHEN d < 0.5 THEN 0.75 - d * d WHEN d < 1.5 THEN pow(1.5 - d, 2) / 2 ELSE 0 END", 3: "CASE WHEN d < 1 THEN 2.0 / 3 - d * d + d * d * d / 2 WHEN d < 2 THEN pow(2 - d, 3) / 6 ELSE 0 END"}[order]
    at = "least(greatest(k - ({by}), 0), 7)" if mode == "nearest" else "k - ({by})"
    source = "least(greatest(t, 0), 7)" if mode == "nearest" else "CASE WHEN t < 0 THEN -t - 1 WHEN t > 7 THEN 15 - t ELSE t END"
    axis = lambda name, by: f"{name} AS (SELECT k, {source} AS s, sum({b}) AS w FROM (SELECT k, t, abs({at.format(by=by)} - t) AS d FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(-4, 12)) AS t)) GROUP BY 1, 2)"
    return f"""WITH {PIXELS}, p AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, v FROM px), {axis("wr", "CAST(0.25 AS DOUBLE)")}, {axis("wc", "CAST(-0.5 AS DOUBLE)")},
        a AS (SELECT vec_id, k AS r, c, sum(w * v) AS v FROM p JOIN wr ON s = r GROUP BY 1, 2, 3), b AS (SELECT vec_id, r, k AS c, sum(w * v) AS v FROM a JOIN wc ON s = c GROUP BY 1, 2, 3)
        SELECT vec_id, r * 8 + c AS i, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM b"""


def _grid_sql(key: str, source: str) -> str:
    return f"""WITH s AS ({source}), n AS (SELECT *, greatest(step * 1e-7, 1e-9) AS hair FROM s),
        g AS (SELECT {key}, a, b, step, hair, floor((b - a + hair) / step) AS last, unnest(range(CAST(floor((b - a + hair) / step) AS BIGINT) + 1)) AS place FROM n)
        SELECT {key}, CAST(place AS INTEGER) AS place, round(CASE WHEN place = last AND abs(round(a + step * place, 10) - b) <= hair THEN b ELSE a + step * place END, 8) + 0.0 AS value FROM g"""


_GEOMETRY = """g AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row, 'p' || s_suppkey || '.tif' AS f,
                CAST(CAST(360.0 * (s_suppkey - min(s_suppkey) OVER ()) / (max(s_suppkey) OVER () - min(s_suppkey) OVER ()) AS FLOAT) AS DOUBLE) AS a, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)"""
_VIEW = "row AS view_idx, f AS filename, round(a, 3) + 0.0 AS angle_deg, round(CAST(CAST(radians(a) AS FLOAT) AS DOUBLE), 3) + 0.0 AS angle_rad, round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 3) + 0.0 AS x_shift_px, round(CAST(CAST({y} AS FLOAT) AS DOUBLE), 3) + 0.0 AS y_shift_px, false AS exists"

QUERIES = {
    "resampled_volumes": (
        resampled_volumes,
        f"WITH {_VOX}, {_AXIS.format(a='az', n=3)}, {_AXIS.format(a='ay', n=5)}, {_AXIS.format(a='ax', n=2)} SELECT vec_id AS volume_id, CAST((az.k * 5 + ay.k) * 2 + ax.k AS BIGINT) AS i, round(sum(az.w * ay.w * ax.w * v), 5) + 0.0 AS value FROM c JOIN az ON az.s = z JOIN ay ON ay.s = y JOIN ax ON ax.s = x GROUP BY 1, 2",
    ),
    "averaged_volumes": (averaged_volumes, f"WITH {_VOX} SELECT vec_id AS volume_id, CAST(z // 2 * 4 + x AS BIGINT) AS i, round(avg(v), 5) + 0.0 AS value FROM c GROUP BY 1, 2"),
    **{f"spline_shift_{order}_{mode}": (_spline_shift(order, mode), _spline_sql(order, mode)) for order in (2, 3) for mode in ("nearest", "reflect")},
    "recovered_shifts": (recovered_shifts, "SELECT vec_id, CAST(vec_id % 3 - 1 AS DOUBLE) AS rows, CAST(vec_id % 5 - 2 AS DOUBLE) AS cols FROM embeddings"),
    "image_source_crop": (
        image_source_crop,
        f"WITH {PIXELS}, p AS (SELECT vec_id, i // 16 - 1 AS r, i % 8 // 2 AS c, v FROM px) SELECT vec_id, CAST(3 AS INTEGER) AS rows, CAST(3 AS INTEGER) AS cols, r * 3 + c AS i, round(CAST(CAST(avg(CAST(v AS FLOAT)) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM p WHERE r >= 0 AND c < 3 GROUP BY 1, 2, 3, 4",
    ),
    "image_source_folders": (image_source_folders, "SELECT 'set' || label AS folder, CAST(8 AS BIGINT) AS rows, count(*) AS n FROM embeddings GROUP BY 1"),
    "grid_rows": (grid_rows, _grid_sql("p_partkey", "SELECT p_partkey, p_size / -2.0 AS a, p_size / 2.0 AS b, CAST(0.5 + p_partkey % 4 * 0.25 AS DOUBLE) AS step FROM part")),
    "fine_rows": (fine_rows, _grid_sql("s_suppkey", "SELECT s_suppkey, best - greatest(1.0, 2 * w) AS a, best + greatest(1.0, 2 * w) AS b, w / 5 AS step FROM (SELECT s_suppkey, round(s_acctbal / 1000, 1) AS best, CAST(1 + s_suppkey % 3 AS DOUBLE) AS w FROM supplier)")),
    "batch_rows": (
        batch_rows,
        "WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_custkey, n, unnest(range(n)) AS k FROM s), h AS (SELECT o_custkey, k, ntile(3) OVER (PARTITION BY o_custkey ORDER BY k) - 1 AS j FROM p) SELECT o_custkey, 'batch' AS kind, CAST(k // 4 AS INTEGER) AS place, min(k) AS first, max(k) AS last FROM p GROUP BY 1, 2, 3 UNION ALL SELECT o_custkey, 'shard', CAST(j AS INTEGER), min(k), max(k) FROM h GROUP BY 1, 2, 3",
    ),
    "stream_throttle_since": (
        stream_throttle_since,
        """WITH RECURSIVE t AS (SELECT event_type, min(ts) AS ts FROM events GROUP BY 1
             UNION ALL SELECT t.event_type, min(e.ts) FROM t JOIN events e ON e.event_type = t.event_type AND e.ts >= t.ts + INTERVAL 900 SECOND GROUP BY 1)
           SELECT event_type, min(event_id) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM t JOIN events USING (event_type, ts) GROUP BY event_type, ts""",
    ),
    "validated_views": (validated_views, f"WITH {_GEOMETRY} SELECT {_VIEW.format(x='x', y='y')} FROM g WHERE row <> (SELECT max(row) FROM g)"),
    "validation_summary": (
        validation_summary,
        "WITH n AS (SELECT CAST(count(*) - 1 AS VARCHAR) AS n FROM supplier) SELECT unnest(['views', 'direction', 'has_x', 'has_y', 'endpoint_detected', 'endpoint_removed', 'angle_source', 'warnings', 'missing', 'duplicates']) AS fact, unnest([n, 'ascending', 'true', 'true', 'true', 'true', 'degrees of theta_deg (stage)', '2', n, '0']) AS value FROM n",
    ),
    "coarser_run": (coarser_run, f"WITH {_GEOMETRY} SELECT {_VIEW.format(x='x / 4', y='y / 2')} FROM g WHERE row <> (SELECT max(row) FROM g) AND row % 3 = 0"),
    "aliased_shifts": (aliased_shifts, f"WITH {_GEOMETRY} SELECT row AS row_index, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 3) + 0.0 AS x_shift_px, round(y, 3) + 0.0 AS y_shift_px FROM g"),
    "resumed_prior": (resumed_prior, f"WITH {PIXELS} SELECT vec_id AS volume_id, i, round(v, 5) + 0.0 AS prior, round(v / 2, 5) + 0.0 AS confidence, CAST(1.0 AS DOUBLE) AS support FROM px"),
    "dictionary_rows": (dictionary_rows, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS BIGINT) END AS n_regionkey FROM nation"),
    "denoised_volumes": (
        denoised_volumes,
        f"WITH {_GRAD}, u AS (SELECT volume_id, i, z, y, x, gx / m AS gx, gy / m AS gy, gz / m AS gz FROM (SELECT *, sqrt(gx * gx + gy * gy + gz * gz + 0.0001) AS m FROM g)) SELECT s.volume_id, s.i, round(CAST(CAST(v - 0.2 * 0.1 * w AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM s JOIN ({_adjoint('u')}) a ON a.volume_id = s.volume_id AND a.i = s.i",
    ),
}
