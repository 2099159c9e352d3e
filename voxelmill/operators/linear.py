"""The projector as a relation and as Arrow kernels, exact adjoints of each other.

``system_matrix`` is the relation A(view_idx, pixel, voxel, w); ``forward`` and ``backproject`` are joins and sums with it, so both use
the very same weights. For grids whose relation would not be worth storing, ``RayProjector`` makes the weights of a view
when they are needed: views are the unit of distribution, partial volumes are added up per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions import geometry
from voxelmill.functions.geometry import Geometry


def system_matrix(views: DataFrame, g: Geometry) -> DataFrame:
    """views (view_idx, angle_rad), as traced; one row per ray and voxel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for view, angle in zip(pdf["view_idx"], pdf["angle_rad"], strict=True):
                pixel, voxel, w = geometry.ray_weights(g, float(angle))
                yield pd.DataFrame({"view_idx": np.full(len(w), view), "pixel": pixel, "voxel": voxel, "w": w})

    return views.select(F.col("view_idx").cast("long"), "angle_rad").mapInPandas(run, "view_idx long, pixel long, voxel long, w double")


def forward(matrix: DataFrame, x: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(view_idx, pixel, value) of x (voxel, value); of several volumes told apart by keys, with these before."""
    return matrix.join(x, "voxel").groupBy(*(keys or []), "view_idx", "pixel").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def backproject(matrix: DataFrame, y: DataFrame, views: Column | None = None, scale: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """(voxel, value) of y (view_idx, pixel, value); over a subset of the views, scaled; of several volumes as ``forward``."""
    rows = matrix if views is None else matrix.where(views)
    return rows.join(y, ["view_idx", "pixel"]).groupBy(*(keys or []), "voxel").agg((scale * F.sum(F.col("w") * F.col("value"))).alias("value"))


def normal(matrix: DataFrame, x: DataFrame) -> DataFrame:
    return backproject(matrix, forward(matrix, x))


def batch_gradient(matrix: DataFrame, x: DataFrame, b: DataFrame, views: Column, scale: float, weight: str | None = None) -> DataFrame:
    """(voxel, value): the scaled gradient of a batch of views; b (view_idx, pixel, value[, weight]), its weight squared."""
    part = matrix.where(views)
    predicted = forward(part, x).withColumnRenamed("value", "p")
    w = F.lit(1.0) if weight is None else F.col(weight) * F.col(weight)
    residual = b.where(views).join(predicted, ["view_idx", "pixel"], "left").select("view_idx", "pixel", (w * (F.coalesce("p", F.lit(0.0)) - F.col("value"))).alias("value"))
    return backproject(part, residual, scale=scale)


def subset_scale(n_views: int, subset: int, batch: int) -> float:
    """What a batch's gradient is multiplied by, so that it stands for all views."""
    return n_views / max(1, subset) * (subset / max(1, batch))


class Identity:
    """Every voxel is its own pixel."""

    def __init__(self, n_views: int):
        self.n_views = n_views

    def forward(self, x: np.ndarray, views: np.ndarray | None = None) -> np.ndarray:
        return x if views is None else x[views]

    def backproject(self, y: np.ndarray, views: np.ndarray | None = None) -> np.ndarray:
        if views is None:
            return y
        out = np.zeros((self.n_views, *y.shape[1:]))
        out[views] = y
        return out


class RayProjector:
    """Cone-beam projector over Spark tasks, for solvers whose vectors live on the driver.

    The volume is broadcast for a forward projection (``max_broadcast`` bytes at most: beyond, use the relation), and partial
    volumes of each task are summed slice by slice on the executors for a back projection.
    """

    def __init__(self, spark: SparkSession, g: Geometry, angles: np.ndarray, tasks: int | None = None, max_broadcast: int = 1 << 30):
        self.spark, self.g, self.angles = spark, g, g.angles(angles)
        self.n_views, self.tasks, self.max_broadcast = len(self.angles), tasks or spark.sparkContext.defaultParallelism, max_broadcast

    def _views(self, views: np.ndarray | None) -> tuple[np.ndarray, DataFrame]:
        chosen = np.arange(self.n_views) if views is None else np.asarray(views)
        rows = self.spark.createDataFrame(pd.DataFrame({"place": np.arange(len(chosen)), "angle": self.angles[chosen]}), "place long, angle double")
        return chosen, rows.repartition(max(1, min(self.tasks, len(chosen))), "place")

    def forward(self, x: np.ndarray, views: np.ndarray | None = None) -> np.ndarray:
        if x.nbytes > self.max_broadcast:
            raise ValueError("the volume is too large to broadcast; use system_matrix")
        chosen, rows = self._views(views)
        g, sent = self.g, self.spark.sparkContext.broadcast(np.asarray(x, np.float64).reshape(-1))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for place, angle in zip(pdf["place"], pdf["angle"], strict=True):
                    pixel, voxel, w = geometry.ray_weights(g, angle)
                    yield pd.DataFrame({"place": [place], "data": [np.bincount(pixel, w * sent.value[voxel], g.detector_pixels[0] * g.detector_pixels[1])]})

        out = np.zeros((len(chosen), *g.detector_pixels))
        for r in rows.mapInPandas(run, "place long, data array<double>").toLocalIterator():
            out[r["place"]] = np.asarray(r["data"]).reshape(g.detector_pixels)
        sent.unpersist()
        return out

    def backproject(self, y: np.ndarray, views: np.ndarray | None = None) -> np.ndarray:
        chosen, rows = self._views(views)
        if y.nbytes > self.max_broadcast:
            raise ValueError("the projections are too large to broadcast; use system_matrix")
        g, sent = self.g, self.spark.sparkContext.broadcast(np.asarray(y, np.float64).reshape(len(chosen), -1))
        nz = g.volume_voxels[0]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(int(np.prod(g.volume_voxels)))
            for pdf in batches:
                for place, angle in zip(pdf["place"], pdf["angle"], strict=True):
                    pixel, voxel, w = geometry.ray_weights(g, angle)
                    total += np.bincount(voxel, w * sent.value[place][pixel], len(total))
            yield pd.DataFrame({"z": np.arange(nz), "data": list(total.reshape(nz, -1))})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"z": [pdf["z"].iloc[0]], "data": [np.sum(np.stack(pdf["data"].to_list()), axis=0)]})

        out = np.zeros(g.volume_voxels)
        for r in rows.mapInPandas(run, "z long, data array<double>").groupBy("z").applyInPandas(add, "z long, data array<double>").toLocalIterator():
            out[r["z"]] = np.asarray(r["data"]).reshape(g.volume_voxels[1:])
        sent.unpersist()
        return out


def fdk(projections: DataFrame, g: Geometry, name: str = "ram_lak", slab: int = 32) -> DataFrame:
    """Filtered back projection of projections (view_idx, angle_rad, rows, cols, data): slices (z, ny, nx, data).

    Views are filtered where they lie. Every task then adds its views to each slab of slices in turn, and the partial slices are summed; a
    task holds one slab, whatever the volume.
    """
    rows, cols = g.detector_pixels
    nz, ny, nx = g.volume_voxels
    n_views = projections.count()
    share = 0.5 * 2 * np.pi / max(1, n_views)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(float(a), geometry.filter_projection(np.roll(np.asarray(d, np.float64).reshape(rows, cols), int(round(g.image_shift)), axis=1) if g.image_shift else np.asarray(d, np.float64).reshape(rows, cols), g, name)) for pdf in batches for a, d in zip(pdf["angle_rad"], pdf["data"], strict=True)]
        for a in range(0, nz, slab) if held else []:
            z = np.arange(a, min(nz, a + slab))
            part = sum(geometry.backproject_filtered(f, g, float(g.angles(np.array([angle]))[0]), z) for angle, f in held)
            yield pd.DataFrame({"z": z, "data": list(part.reshape(len(z), -1) * share)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"z": [pdf["z"].iloc[0]], "ny": [ny], "nx": [nx], "data": [np.sum(np.stack(pdf["data"].to_list()), axis=0).astype(np.float32)]})

    parts = projections.select("angle_rad", "data").mapInPandas(run, "z int, data array<double>")
    return parts.groupBy("z").applyInPandas(add, "z int, ny int, nx int, data array<float>")


def initial_volume(mode: str, g: Geometry, projections: DataFrame | None = None, existing: np.ndarray | None = None, constant: float = 0.0) -> np.ndarray:
    """Start of a solver: fdk, existing (resampled to the grid if its shape differs), zeros or constant."""
    shape = g.volume_voxels
    if mode == "zeros":
        return np.zeros(shape)
    if mode == "constant":
        return np.full(shape, float(constant))
    if mode == "fdk":
        out = np.zeros(shape)
        for r in fdk(projections, g).toLocalIterator():
            out[r["z"]] = np.asarray(r["data"]).reshape(shape[1:])
        return out
    if mode in ("existing", "existing_fdk"):
        return resample_volume(existing, shape)
    raise ValueError(f"unknown start {mode}")


def resample_volume(x: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """x as it is, block-averaged if its sizes are one multiple of the shape, else linearly interpolated."""
    if x.shape == tuple(shape):
        return x.astype(np.float64)
    factors = {a / b for a, b in zip(x.shape, shape, strict=True)}
    if len(factors) == 1 and (f := factors.pop()) == int(f) and f > 1:
        from voxelmill.operators.kernels import block_mean

        return block_mean(x, (int(f),) * 3).astype(np.float64)
    out = x.astype(np.float64)
    for axis, n in enumerate(shape):
        at = np.linspace(0, out.shape[axis] - 1, n)
        low = np.minimum(np.floor(at).astype(int), max(0, out.shape[axis] - 2))
        t = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        high = np.minimum(low + 1, out.shape[axis] - 1)
        out = np.take(out, low, axis) * (1 - t) + np.take(out, high, axis) * t
    return out
