"""Volume queries: each embedding is a 4 x 4 x 4 volume (z = i div 16, y = i div 4 % 4, x = i % 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators import volumes
from voxelmill.plans.images import PIXELS, rounded


def cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices (volume_id, z, ny, nx, data) in double."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("volume_id"), F.col("embedding").cast("array<double>").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z"))
    return e.select("volume_id", "z", F.lit(4).alias("ny"), F.lit(4).alias("nx"), F.slice("d", F.col("z") * 16 + 1, 16).alias("data"))


def _voxels(df: DataFrame, columns: dict[str, str], digits: int = 5) -> DataFrame:
    """(volume_id, i, one value per column)."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in columns.items()])
    long = df.select("volume_id", "z", "ny", "nx", F.posexplode(zipped).alias("k", "s"))
    i = (F.col("z") * F.col("ny") * F.col("nx") + F.col("k")).cast("long")
    return long.select("volume_id", i.alias("i"), *[rounded(F.col("s").getField(n).cast("double"), digits).alias(n) for n in columns])


def block_mean_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(volumes.block_mean(cubes(spark, sf_dir), 2), {"value": "data"})


def grad3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(volumes.gradient(cubes(spark, sf_dir)), {"gx": "gx", "gy": "gy", "gz": "gz"})


def grad_adjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjoint applied to the gradient: the negative Laplacian with open ends."""
    return _voxels(volumes.gradient_adjoint(volumes.gradient(cubes(spark, sf_dir))), {"value": "adjoint"})


def laplacian3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(volumes.laplacian(cubes(spark, sf_dir)), {"value": "laplacian"})


def shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(volumes.shrink(volumes.gradient(cubes(spark, sf_dir)), 0.5), {"gx": "gx", "gy": "gy", "gz": "gz"})


def project_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(volumes.project_ball(volumes.gradient(cubes(spark, sf_dir)), 0.25), {"gx": "gx", "gy": "gy", "gz": "gz"})


def tv_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(volumes.tv_gradient(cubes(spark, sf_dir), 0.01), {"value": "tv_gradient"}, 4)


def tv_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cubes(spark, sf_dir)
    a, b = volumes.tv_norm(df, 0.01), volumes.tv_roughness(df)
    return a.join(b, "volume_id").select("volume_id", rounded(F.col("tv"), 4).alias("tv"), rounded(F.col("roughness"), 4).alias("roughness"))


def resize_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cropped to three columns and padded to five slices and rows."""
    return _voxels(volumes.resize(cubes(spark, sf_dir), 5, 5, 3), {"value": "data"})


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle axial, coronal and sagittal images."""
    df = cubes(spark, sf_dir)
    parts = [volumes.axial(df).select("volume_id", F.lit("axial").alias("plane"), "data"), *[volumes.across(df, p).select("volume_id", F.lit(p).alias("plane"), "data") for p in ("coronal", "sagittal")]]
    all_planes = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return all_planes.select("volume_id", "plane", F.posexplode("data").alias("i", "v")).select("volume_id", "plane", F.col("i").cast("long").alias("i"), rounded(F.col("v")).alias("value"))


def volume_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.shape(cubes(spark, sf_dir))


def volume_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = volumes.percentiles(cubes(spark, sf_dir), [0.005, 0.5, 0.995])
    return got.select("volume_id", *[rounded(F.col("p")[k]).alias(n) for k, n in enumerate(("low", "median", "high"))])


_VOX = f"{PIXELS}, s AS (SELECT vec_id AS volume_id, i, i // 16 AS z, i // 4 % 4 AS y, i % 4 AS x, v FROM px)"
_GRAD = (
    _VOX
    + """,
g AS (SELECT a.volume_id, a.i, a.z, a.y, a.x, a.v, coalesce(b.v - a.v, 0) AS gx, coalesce(c.v - a.v, 0) AS gy, coalesce(d.v - a.v, 0) AS gz FROM s a
  LEFT JOIN s b ON b.volume_id = a.volume_id AND b.i = a.i + 1 AND a.x < 3
  LEFT JOIN s c ON c.volume_id = a.volume_id AND c.i = a.i + 4 AND a.y < 3
  LEFT JOIN s d ON d.volume_id = a.volume_id AND d.i = a.i + 16 AND a.z < 3)"""
)


def _adjoint(source: str) -> str:
    """Sum of what each difference gives to its two voxels; at the far ends differences are 0."""
    parts = [f"SELECT volume_id, i, -{g} AS w FROM {source} UNION ALL SELECT volume_id, i + {step}, {g} FROM {source} WHERE {axis} < 3" for g, step, axis in (("gx", 1, "x"), ("gy", 4, "y"), ("gz", 16, "z"))]
    return "SELECT volume_id, i, sum(w) AS w FROM (" + " UNION ALL ".join(parts) + ") GROUP BY volume_id, i"


_TRIPLE = "SELECT volume_id, i, round(gx * f, 5) + 0.0 AS gx, round(gy * f, 5) + 0.0 AS gy, round(gz * f, 5) + 0.0 AS gz FROM (SELECT *, {f} AS f FROM g)"

QUERIES = {
    "block_mean_3d": (block_mean_3d, f"WITH {_VOX} SELECT volume_id, (z // 2) * 4 + (y // 2) * 2 + x // 2 AS i, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM s GROUP BY volume_id, (z // 2) * 4 + (y // 2) * 2 + x // 2"),
    "grad3d": (grad3d, f"WITH {_GRAD} " + _TRIPLE.format(f="1.0")),
    "grad_adjoint": (grad_adjoint, f"WITH {_GRAD} SELECT volume_id, i, round(w, 5) + 0.0 AS value FROM ({_adjoint('g')})"),
    "laplacian3d": (laplacian3d, f"WITH {_GRAD} SELECT volume_id, i, round(-w, 5) + 0.0 AS value FROM ({_adjoint('g')})"),
    "shrink": (shrink, f"WITH {_GRAD} " + _TRIPLE.format(f="greatest(1 - 0.5 / greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-12), 0)")),
    "project_ball": (project_ball, f"WITH {_GRAD} " + _TRIPLE.format(f="1 / greatest(1, sqrt(gx * gx + gy * gy + gz * gz) / 0.25)")),
    "tv_gradient": (
        tv_gradient,
        f"WITH {_GRAD}, u AS (SELECT volume_id, i, z, y, x, gx / m AS gx, gy / m AS gy, gz / m AS gz FROM (SELECT *, sqrt(gx * gx + gy * gy + gz * gz + 0.0001) AS m FROM g)) SELECT volume_id, i, round(w, 4) + 0.0 AS value FROM ({_adjoint('u')})",
    ),
    "tv_norm": (tv_norm, f"WITH {_GRAD} SELECT volume_id, round(sum(sqrt(gx * gx + gy * gy + gz * gz + 0.0001)), 4) + 0.0 AS tv, round(sum(abs(gx) + abs(gy) + abs(gz)) / greatest(sum(abs(v)), 1e-12), 4) + 0.0 AS roughness FROM g GROUP BY volume_id"),
    "resize_volume": (
        resize_volume,
        f"WITH {_VOX}, grid AS (SELECT volume_id, k, k // 15 AS z, k // 3 % 5 AS y, k % 3 AS x FROM (SELECT DISTINCT volume_id FROM s), (SELECT unnest(range(75)) AS k)) SELECT grid.volume_id, k AS i, round(CAST(CAST(coalesce(s.v, 0) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM grid LEFT JOIN s ON s.volume_id = grid.volume_id AND s.z = grid.z AND s.y = grid.y AND s.x = grid.x",
    ),
    "slices": (
        slices,
        f"WITH {_VOX} SELECT volume_id, 'axial' AS plane, y * 4 + x AS i, round(v, 5) + 0.0 AS value FROM s WHERE z = 2 UNION ALL SELECT volume_id, 'coronal', z * 4 + x, round(v, 5) + 0.0 FROM s WHERE y = 2 UNION ALL SELECT volume_id, 'sagittal', z * 4 + y, round(v, 5) + 0.0 FROM s WHERE x = 2",
    ),
    "volume_shape": (volume_shape, "SELECT vec_id AS volume_id, CAST(4 AS INTEGER) AS nz, CAST(4 AS INTEGER) AS ny, CAST(4 AS INTEGER) AS nx FROM embeddings"),
    "volume_percentiles": (volume_percentiles, f"WITH {_VOX} SELECT volume_id, round(quantile_cont(v, 0.005), 5) + 0.0 AS low, round(quantile_cont(v, 0.5), 5) + 0.0 AS median, round(quantile_cont(v, 0.995), 5) + 0.0 AS high FROM s GROUP BY volume_id"),
}
