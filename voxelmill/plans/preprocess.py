"""From raw views to attenuation: one Arrow kernel per view, with the mean flat and dark fields broadcast.

Order: bins, crop, flips, flat and dark correction, shift (stage transmission), logarithm, shift (stage attenuation), truncation
padding, transposition. Every step is also a column expression of ``operators.arrays``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.operators import kernels, stats


@dataclass(frozen=True)
class Preprocessing:
    """The defaults."""

    negative_log: bool = True
    epsilon: float = 1e-6
    clip_transmission: bool = True
    transmission_clip_min: float = 1e-6
    transmission_clip_max: float = 2.0
    max_transmission_for_log: float = 2.0
    clip_negative_attenuation_to_zero: bool = True
    binning: tuple[int, int] = (1, 1)
    crop: tuple[int, int, int, int] = (0, 0, 0, 0)
    flip_horizontal: bool = False
    flip_vertical: bool = False
    transpose: bool = False
    truncation_correction: bool = False
    truncation_extension_fraction: float = 0.1
    use_drift: bool = True
    drift_stage: str = "transmission"
    x_shift_sign: int = 1
    y_shift_sign: int = 1
    shift_sign: int = 1
    shift_order: int = 1
    shift_mode: str = "nearest"

    def __post_init__(self):
        if {self.x_shift_sign, self.y_shift_sign, self.shift_sign} - {1, -1}:
            raise ValueError("shift signs are 1 or -1")
        if self.drift_stage not in ("transmission", "attenuation"):
            raise ValueError(f"unknown drift stage {self.drift_stage}")


def coarser(p: Preprocessing, by: int, bx: int) -> Preprocessing:
    """For a quick run: binning by further factors, margins in the coarser pixels, rounded up."""
    return replace(p, binning=(p.binning[0] * by, p.binning[1] * bx), crop=tuple(-(-m // f) for m, f in zip(p.crop, (by, by, bx, bx), strict=True)))


def field_of(images: DataFrame | None, name: str) -> np.ndarray | None:
    """The mean image of a field's frames, all of one shape. One detector frame: its size does not grow with the views."""
    if images is None:
        return None
    shapes = images.select("rows", "cols").distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError(f"{name} frames: {'none' if not shapes else 'differing shapes'}")
    return np.asarray(stats.mean_field(images).first()["data"], np.float32).reshape(shapes[0]["rows"], shapes[0]["cols"])


def view_kernel(image: np.ndarray, c: Preprocessing, flat: np.ndarray | None, dark: np.ndarray | None, dx: float | None, dy: float | None) -> np.ndarray:
    """One view; flat and dark are binned and cropped as it is."""

    def reduce(a: np.ndarray) -> np.ndarray:
        a = kernels.crop(kernels.block_mean(a, c.binning) if c.binning != (1, 1) else a.astype(np.float32), *c.crop)
        return a[:: -1 if c.flip_vertical else 1, :: -1 if c.flip_horizontal else 1]

    def moved(a: np.ndarray, stage: str) -> np.ndarray:
        if not c.use_drift or c.drift_stage != stage or dx is None or dy is None or np.isnan(dx) or np.isnan(dy):
            return a
        return kernels.shift_image(a, c.shift_sign * c.y_shift_sign * dy, c.shift_sign * c.x_shift_sign * dx, c.shift_order, c.shift_mode)

    limits = (c.transmission_clip_min, c.transmission_clip_max) if c.clip_transmission else None
    t = kernels.flat_dark(reduce(image), None if flat is None else reduce(flat), None if dark is None or flat is None else reduce(dark), c.epsilon, limits)
    t = moved(t, "transmission")
    if c.negative_log:
        out = kernels.attenuation(t, c.epsilon, c.max_transmission_for_log, c.clip_negative_attenuation_to_zero)
    else:
        out = np.maximum(t, 0) if c.clip_negative_attenuation_to_zero else t
    out = moved(out, "attenuation")
    if c.truncation_correction:
        out = kernels.truncation_pad(out, c.truncation_extension_fraction)
    return (out.T if c.transpose else out).astype(np.float32)


def preprocess(views: DataFrame, config: Preprocessing = Preprocessing(), flat: DataFrame | None = None, dark: DataFrame | None = None) -> DataFrame:
    """views (view_idx, angle_rad, rows, cols, data[, x_shift_px, y_shift_px, ...]) with corrected rows, cols and data, and mean_raw for weights."""
    f, d = field_of(flat, "flat"), field_of(dark, "dark") if flat is not None else None
    sent = views.sparkSession.sparkContext.broadcast((config, f, d))
    for name in ("x_shift_px", "y_shift_px"):
        if name not in views.columns:
            views = views.withColumn(name, F.lit(None).cast("float"))
    keep = [c for c in views.columns if c not in ("rows", "cols", "data", "mean_raw")]
    kinds = dict(views.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, ff, dd = sent.value
        for pdf in batches:
            images, means = [], []
            for rows, cols, data, dx, dy in zip(pdf["rows"], pdf["cols"], pdf["data"], pdf["x_shift_px"], pdf["y_shift_px"], strict=True):
                raw = np.asarray(data, np.float32).reshape(int(rows), int(cols))
                for field, name in ((ff, "flat"), (dd, "dark")):
                    if field is not None and field.shape != raw.shape:
                        raise ValueError(f"the {name} field has shape {field.shape}, the views {raw.shape}")
                images.append(view_kernel(raw, c, ff, dd, dx, dy))
                means.append(float(np.nanmean(np.maximum(raw, 0))) if np.isfinite(raw).any() else 0.0)
            out = pdf[keep].copy()
            out["rows"], out["cols"] = [i.shape[0] for i in images], [i.shape[1] for i in images]
            out["data"], out["mean_raw"] = [i.reshape(-1) for i in images], means
            yield out

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "rows int", "cols int", "data array<float>", "mean_raw double"])
    return views.mapInPandas(run, schema)


def projection_range(views: DataFrame) -> DataFrame:
    """(least, greatest): of all pixels but NaN."""
    clean = F.filter("data", lambda x: ~F.isnan(x))
    return views.agg(F.min(F.array_min(clean)).alias("least"), F.max(F.array_max(clean)).alias("greatest"))


def pair_shifts(pairs: DataFrame, key: str, upsample: int = 10) -> DataFrame:
    """(key, x_shift_px, y_shift_px) of pairs (key, rows, cols, reference, data): the shift that moves data onto reference, to 1 / upsample of a pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            moved = [kernels.phase_shift(np.asarray(a, np.float64).reshape(r, c), np.asarray(b, np.float64).reshape(r, c), upsample) for a, b, r, c in zip(pdf["reference"], pdf["data"], pdf["rows"], pdf["cols"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "x_shift_px": [x for _, x in moved], "y_shift_px": [y for y, _ in moved]})

    return pairs.select(key, "rows", "cols", "reference", "data").mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, x_shift_px double, y_shift_px double")


def estimate_drift(views: DataFrame, median_width: int = 1) -> DataFrame:
    """(view_idx, x_shift_px, y_shift_px): the shift that moves each view onto the first, by phase correlation, to a tenth of a pixel; smoothed by a running median if wider than 1.

    The first view is one detector frame, which is broadcast.
    """
    first = views.orderBy("view_idx").select("rows", "cols", "data").first()
    sent = views.sparkSession.sparkContext.broadcast(np.asarray(first["data"], np.float64).reshape(first["rows"], first["cols"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            moved = [kernels.phase_shift(sent.value, np.asarray(d, np.float64).reshape(r, c)) for d, r, c in zip(pdf["data"], pdf["rows"], pdf["cols"], strict=True)]
            yield pd.DataFrame({"view_idx": pdf["view_idx"], "x_shift_px": [x for _, x in moved], "y_shift_px": [y for y, _ in moved]})

    found = views.select("view_idx", "rows", "cols", "data").mapInPandas(run, "view_idx long, x_shift_px double, y_shift_px double")
    if median_width <= 1:
        return found
    from voxelmill.operators.windows import running_median

    one = found.withColumn("__all", F.lit(0))
    for c in ("x_shift_px", "y_shift_px"):
        one = running_median(one, c, "view_idx", median_width, ["__all"]).drop(c).withColumnRenamed("median", c)
    return one.select("view_idx", "x_shift_px", "y_shift_px")
