"""Solver and streaming queries: volumes from embeddings, event streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.geometry import Geometry, ray_weights
from voxelmill.operators import linear, solvers
from voxelmill.plans.images import rounded
from voxelmill.streaming import monitors

#: The 64 values of a row of embeddings are a volume of 4 x 4 x 4 voxels.
PHANTOM = Geometry(200.0, 100.0, (6, 10), (2.0, 2.0), (4, 4, 4), (1.0, 1.0, 1.0), invert_angles=False)


def phantom_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ray relation of twelve views."""
    return linear.system_matrix(spark.range(12).select(F.col("id").alias("view_idx"), (F.col("id") * (np.pi / 6)).alias("angle_rad")), PHANTOM)


def forward_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections of every volume of embeddings; the relation of one geometry is small and goes to all tasks."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("volume_id"), F.posexplode("embedding").alias("voxel", "v")).select("volume_id", "voxel", F.abs("v").alias("value"))
    got = linear.forward(F.broadcast(phantom_matrix(spark, sf_dir)), x, ["volume_id"])
    return got.select("volume_id", "view_idx", "pixel", rounded(F.col("value"), 4).alias("value"))


def _projection_sql() -> str:
    """The projections as a join with the relation's rows, which the geometry gives as numbers."""
    rows = [(view, int(p), int(v), float(w)) for view in range(12) for p, v, w in zip(*ray_weights(PHANTOM, view * (np.pi / 6)), strict=True)]
    values = ", ".join(f"({a}, {b}, {c}, {w!r}::DOUBLE)" for a, b, c, w in rows)
    pixels = "px AS (SELECT vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) AS v, generate_subscripts(embedding, 1) - 1 AS voxel FROM embeddings)"
    return f"WITH m(view_idx, pixel, voxel, w) AS (VALUES {values}), {pixels} SELECT vec_id AS volume_id, CAST(view_idx AS BIGINT) AS view_idx, CAST(pixel AS BIGINT) AS pixel, round(sum(w * v), 4) + 0.0 AS value FROM px JOIN m USING (voxel) GROUP BY 1, 2, 3"


def forward_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity relation gives back each pixel."""
    px = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("k", "v")).select((F.col("vec_id") * 64 + F.col("k")).alias("voxel"), F.col("v").cast("double").alias("value"))
    eye = px.select((F.floor(F.col("voxel") / 64)).alias("view_idx"), (F.col("voxel") % 64).alias("pixel"), "voxel", F.lit(1.0).alias("w"))
    return linear.forward(eye, px).select("view_idx", "pixel", rounded(F.col("value")).alias("value"))


def solve_volume(b: np.ndarray) -> list[solvers.Solved]:
    """The four solvers on one small volume as its own data, with the identity operator."""
    op, x0 = linear.Identity(len(b)), np.zeros_like(b)
    return [solvers.admm(op, b, x0, 1e-3, 5e-2, 5), solvers.pdhg(op, b, x0, 1e-3, 5), solvers.subset_tv(op, b, x0, 1e-3, 5, 2), solvers.anchored(op, b, x0, b, np.ones_like(b), sweeps=3, subsets=2)]


def solver_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of the four solvers for every volume of embeddings (4 x 4 x 4, absolute values); a volume is solved in its row's task."""
    names = ["iteration", "objective", "data_fidelity", "tv_term", "relative_x_change"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, v in zip(pdf["volume_id"], pdf["embedding"], strict=True):
                b = np.abs(np.asarray(v, np.float64)).reshape(4, 4, 4)
                out += [(k, r.solver, *(getattr(r, n) for n in names)) for done in solve_volume(b) for r in done.rows]
            yield pd.DataFrame(out, columns=["volume_id", "solver", *names])

    volumes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("volume_id"), "embedding")
    return volumes.mapInPandas(run, "volume_id long, solver string, iteration int, objective double, data_fidelity double, tv_term double, relative_x_change double")


def cg_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjugate gradients on tables: customers as unknowns of a diagonal system."""
    from voxelmill.session import checkpoint_folder

    checkpoint_folder(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("i"), "c_acctbal", "c_nationkey")
    matrix = c.select("i", F.col("i").alias("j"), (2.0 + F.col("c_nationkey") % 5).alias("w"))
    x, _, _ = solvers.conjugate_gradient_tables(matrix, c.select("i", (F.col("c_acctbal") / 1000).alias("value")), 12, 1e-10)
    return x.select("i", rounded(F.col("value"), 7).alias("value"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and means per event type, from a stream of the events file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    df = monitors.event_stream(spark, sf_dir, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = monitors.run_once(monitors.window_summary(df, "ts", ["event_type"], "value", "1 day", late="3650 days"), f"w{uuid.uuid4().hex}", "complete")
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", rounded(F.col("mean"), 9).alias("mean"))


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 values of each user, from a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    df = monitors.event_stream(spark, sf_dir, "events.parquet", schema)
    got = monitors.run_once(monitors.history(df, "user_id", "event_id", "value", 30), f"h{uuid.uuid4().hex}", "update")
    return got.groupBy("user_id").agg(F.max_by(F.struct("n", "last", "values"), "last").alias("r")).select("user_id", "r.n", "r.last", rounded(F.aggregate("r.values", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


QUERIES = {
    "forward_identity": (forward_identity, "SELECT vec_id AS view_idx, i AS pixel, round(v, 5) + 0.0 AS value FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"),
    "forward_projection": (forward_projection, _projection_sql()),
    "solver_metrics": (solver_metrics, None),
    "cg_tables": (cg_tables, "SELECT c_custkey AS i, round(c_acctbal / 1000 / (2 + c_nationkey % 5), 7) + 0.0 AS value FROM customer"),
    "stream_windows": (stream_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 9) + 0.0 AS mean FROM events GROUP BY 1, 2"),
    "stream_history": (stream_history, "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, count(*) AS n, max(event_id) AS last, round(sum(value), 3) + 0.0 AS total FROM e WHERE k <= 30 GROUP BY 1"),
}
