"""Images as row-major float arrays in a column: expressions that stay inside the row, so nothing is shuffled.

An image of ``rows`` x ``cols`` holds pixel (r, c) at index ``r * cols + c``. Sizes are column expressions. Where an expression
would cost much more than a NumPy kernel (long chains on large detectors), ``plans.preprocess`` runs the same steps as one
Arrow kernel; these are for queries over images in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelmill.operators import kernels

Size = Column | int


def _c(x: Size) -> Column:
    return F.lit(x) if isinstance(x, int | float) else x


def _div(a: Size, b: Size) -> Column:
    return F.floor(_c(a) / _c(b)).cast("int")


def _indexes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gather(data: Column, n: Column, index: Callable[[Column], Column]) -> Column:
    """A new array of n elements, element k of which is data at index(k)."""
    return F.transform(_indexes(n.cast("int")), lambda k: F.get(data, index(k).cast("int")))


def block_mean(data: Column, rows: Size, cols: Size, by: int, bx: int) -> Column:
    """Mean over by x bx blocks; what is left over at the far edges is trimmed first; an error if nothing remains."""
    r2, c2 = _div(rows, by), _div(cols, bx)
    blocks = F.transform(
        _indexes(r2 * c2),
        lambda k: (F.aggregate(_indexes(F.lit(by * bx)), F.lit(0.0), lambda a, j: a + F.get(data, ((_div(k, c2) * by + _div(j, bx)) * _c(cols) + k % c2 * bx + j % bx).cast("int")).cast("double")) / (by * bx)).cast("float"),
    )
    return F.when(r2 * c2 > 0, blocks).otherwise(F.raise_error(F.lit(f"blocks of {by} x {bx} leave nothing")).cast("array<float>"))


def crop(data: Column, rows: Size, cols: Size, top: int, bottom: int, left: int, right: int) -> Column:
    """The image without its margins; an error if nothing remains."""
    r2, c2 = _c(rows) - top - bottom, _c(cols) - left - right
    inner = gather(data, r2 * c2, lambda k: (_div(k, c2) + top) * _c(cols) + k % c2 + left)
    return F.when((r2 > 0) & (c2 > 0), inner).otherwise(F.raise_error(F.lit("the crop leaves nothing")).cast("array<float>"))


def bin_and_crop(data: Column, rows: Size, cols: Size, binning: tuple[int, int], margins: tuple[int, int, int, int]) -> Column:
    """Blocks first, then the crop, whose margins count in binned pixels."""
    binned = block_mean(data, rows, cols, *binning)
    return crop(binned, _div(rows, binning[0]), _div(cols, binning[1]), *margins)


def flip_horizontal(data: Column, rows: Size, cols: Size) -> Column:
    return gather(data, _c(rows) * _c(cols), lambda k: _div(k, cols) * _c(cols) + _c(cols) - 1 - k % _c(cols))


def flip_vertical(data: Column, rows: Size, cols: Size) -> Column:
    return gather(data, _c(rows) * _c(cols), lambda k: (_c(rows) - 1 - _div(k, cols)) * _c(cols) + k % _c(cols))


def transpose(data: Column, rows: Size, cols: Size) -> Column:
    return gather(data, _c(rows) * _c(cols), lambda k: k % _c(rows) * _c(cols) + _div(k, rows))


def clip(x: Column, low: float, high: float) -> Column:
    """low to high; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def flat_dark(data: Column, flat: Column | None, dark: Column | None, epsilon: float = 1e-6, limits: tuple[float, float] | None = None) -> Column:
    """(I - D) / max(F - D, eps), or I / max(F, eps); without a flat field the dark field is not used."""
    if flat is None:
        out = data
    elif dark is None:
        out = F.zip_with(data, flat, lambda i, f: i / F.greatest(f, F.lit(epsilon)))
    else:
        both = F.arrays_zip(flat.alias("f"), dark.alias("d"))
        out = F.zip_with(data, both, lambda i, x: (i - x["d"]) / F.greatest(x["f"] - x["d"], F.lit(epsilon)))
    return out if limits is None else F.transform(out, lambda t: clip(t, *limits))


def attenuation(transmission: Column, epsilon: float = 1e-6, most: float = 2.0, clip_negative: bool = True) -> Column:
    """-ln(clip(T, eps, most)), not below 0 if asked."""
    out = F.transform(transmission, lambda t: -F.ln(clip(t, epsilon, most)))
    return F.transform(out, lambda a: F.greatest(a, F.lit(0.0))) if clip_negative else out


def without_log(transmission: Column, clip_negative: bool = True) -> Column:
    return F.transform(transmission, lambda t: F.greatest(t, F.lit(0.0).cast("float"))) if clip_negative else transmission


def truncation_pad(data: Column, rows: Size, cols: Size, fraction: float) -> Column:
    """Mirrored columns on both sides, int(cols * fraction) each, under a ramp from 0 at the outer edge to 1."""
    n = F.floor(_c(cols) * fraction).cast("int")
    wide = _c(cols) + n * 2

    def pixel(k: Column) -> Column:
        c = k % wide - n
        inner = F.when(c < 0, -c - 1).when(c >= _c(cols), _c(cols) * 2 - 1 - c).otherwise(c)
        out = F.get(data, (_div(k, wide) * _c(cols) + inner).cast("int"))
        edge = F.least(k % wide, wide - 1 - k % wide)
        return F.when(edge < n, out * F.when(n > 1, edge / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))).otherwise(out).cast("float")

    return F.when(n > 0, F.transform(_indexes(_c(rows) * wide), pixel)).otherwise(F.raise_error(F.lit("the extension is too small")).cast("array<float>"))


def scale(data: Column, weight: Column, squared: bool = False) -> Column:
    """Every pixel times a weight of the view (or, as an array, of the pixel)."""
    w = weight * weight if squared else weight
    return F.transform(data, lambda x: x * w)


def scale_pixels(data: Column, weights: Column, squared: bool = False) -> Column:
    return F.zip_with(data, weights, lambda x, w: x * w * w if squared else x * w)


def normalise(data: Column, low: Column, high: Column, limits: tuple[float, float] | None = None) -> Column:
    """(x - low) / max(high - low, 1e-12), clipped if asked."""
    span = F.greatest(high - low, F.lit(1e-12))
    out = F.transform(data, lambda x: (x - low) / span)
    return out if limits is None else F.transform(out, lambda x: clip(x, *limits))


def denormalise(data: Column, low: Column, high: Column) -> Column:
    """The inverse of normalise; a clip is not undone."""
    span = F.greatest(high - low, F.lit(1e-12))
    return F.transform(data, lambda x: x * span + low)


def replace_non_finite(data: Column, value: float = 0.0) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.transform(data, lambda x: F.when(bad(x), F.lit(value).cast("float")).otherwise(x))


def percentile(data: Column, p: float) -> Column:
    """Linearly interpolated percentile (p in 0 to 1) of an array's elements."""
    s = F.array_sort(data)
    at = (F.size(s) - 1) * F.lit(float(p))
    low = F.floor(at).cast("int")
    a, b = F.get(s, low).cast("double"), F.get(s, F.least(low + 1, F.size(s) - 1)).cast("double")
    return a + (b - a) * (at - low)


def metric_image(data: Column, rows: Size, cols: Size, margin: float = 0.1) -> Column:
    """The inner part, clipped at its percentiles 1 and 99 and scaled to [0, 1]; all zeros if it is even."""
    m = min(float(margin), 0.45)
    r, c = F.floor(_c(rows) * m).cast("int"), F.floor(_c(cols) * m).cast("int")
    r2, c2 = _c(rows) - r * 2, _c(cols) - c * 2
    inner = gather(replace_non_finite(data), r2 * c2, lambda k: (_div(k, c2) + r) * _c(cols) + k % c2 + c)
    # bound once, as a one-element array, so that the sort is not repeated per pixel
    return F.get(F.transform(F.array(F.struct(inner.alias("x"), percentile(inner, 0.01).alias("a"), percentile(inner, 0.99).alias("b"))), lambda s: F.transform(s["x"], lambda v: F.when(s["b"] > s["a"], (F.least(F.greatest(v.cast("double"), s["a"]), s["b"]) - s["a"]) / F.greatest(s["b"] - s["a"], F.lit(1e-300))).otherwise(F.lit(0.0)))), 0)


def shift(data: Column, rows: Column, cols: Column, row_shift: Column, col_shift: Column, order: int = 1, mode: str = "nearest") -> Column:
    """The image moved by a number of pixels (Arrow kernel); null shifts count as 0."""

    @F.pandas_udf("array<float>")
    def run(d, r, c, dr, dc):
        import pandas as pd

        out = []
        for x, n, m, a, b in zip(d, r, c, dr.fillna(0), dc.fillna(0), strict=True):
            out.append(None if x is None else kernels.shift_image(np.asarray(x, np.float32).reshape(n, m), a, b, order, mode).reshape(-1))
        return pd.Series(out)

    return run(data, rows, cols, row_shift, col_shift)
