"""Aggregations and statistics over views, pixels and metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.functions.scalars import finite
from voxelmill.operators.ordering import _kept, order_statistics, with_previous


def mean_field(images: DataFrame, data: str = "data", keys: list[str] | None = None) -> DataFrame:
    """(data, count) per key: the mean image, summed in double, in float; partial sums per task come first."""
    keys = keys or []
    pixels = images.select(*keys, F.posexplode(data).alias("pos", "value"))
    means = pixels.groupBy(*keys, "pos").agg(F.avg(F.col("value").cast("double")).cast("float").alias("mean"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"])
    return means.groupBy(*keys).agg(ordered.alias(data), F.max("n").alias("count"))


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Names that occur more than once, with their count."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def summary(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Least, greatest, mean and population deviation of the finite values."""
    x = F.when(finite(F.col(column)), F.col(column).cast("double"))
    return df.groupBy(*(keys or [])).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def direction(df: DataFrame, value: str, order: list[str], keys: list[str]) -> DataFrame:
    """Per key: ascending, descending, constant, mixed/non-monotonic or single angle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = df.select(*keys, (F.col(value).cast("double") - F.lag(F.col(value).cast("double")).over(w)).alias("__step"))
    up, down = F.count_if(F.col("__step") > 0), F.count_if(F.col("__step") < 0)
    kind = F.when(F.count(F.lit(1)) < 2, "single angle").when((up > 0) & (down == 0), "ascending").when((down > 0) & (up == 0), "descending").when((up == 0) & (down == 0), "constant").otherwise("mixed/non-monotonic")
    return step.groupBy(*keys).agg(kind.alias("direction"))


def endpoint_repeats(df: DataFrame, angle_deg: str, order: str, keys: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Per key whether the first and the last angle coincide on the circle."""
    ends = df.groupBy(*keys).agg(F.min_by(F.col(angle_deg).cast("double"), order).alias("a"), F.max_by(F.col(angle_deg).cast("double"), order).alias("b"), F.count(F.lit(1)).alias("n"))
    wrapped = F.abs(F.pmod(F.col("b") - F.col("a") + 180.0, F.lit(360.0)) - 180.0)
    return ends.select(*keys, ((F.col("n") > 1) & ((wrapped <= tolerance) | (F.abs(F.abs(F.col("b") - F.col("a")) - 360.0) <= tolerance))).alias("repeats"))


def view_weights(views: DataFrame, mean_raw: str, exposure_s: str | None = None, multiplier: float = 1.0) -> DataFrame:
    """views with ``weight``: from the exposure where it is positive, else from the mean raw count over a floor, else the multiplier.

    The floor is the fifth percentile of the positive means: one row, broadcast.
    """
    raw = F.when(finite(F.col(mean_raw)), F.col(mean_raw).cast("double")).otherwise(F.lit(0.0))
    floor = order_statistics(views.select(F.when(raw > 0, raw).alias("r")), "r", [0.05]).agg(F.max(F.get("q", F.lit(0))).alias("__p5"))
    with_floor = views.crossJoin(F.broadcast(floor))
    counted = F.when(F.col("__p5").isNotNull(), multiplier * F.sqrt(F.greatest(raw, F.col("__p5"), F.lit(1e-6)))).otherwise(F.lit(float(multiplier)))
    weight = counted if exposure_s is None else F.when(F.col(exposure_s) > 0, multiplier * F.sqrt(F.col(exposure_s))).otherwise(counted)
    return with_floor.withColumn("weight", weight).drop("__p5")


def normalise_weights(views: DataFrame, weight: str, is_main: Column, ratio: float = 10.0) -> DataFrame:
    """weight over the median of the main views' positive finite weights, not finite to 1, clipped to [1 / ratio, ratio]."""
    w = F.col(weight).cast("double")
    middle = order_statistics(views.select(F.when(is_main & (w > 0), w).alias("w")), "w", [0.5])
    median = middle.agg(F.greatest(F.coalesce(F.max(F.get("q", F.lit(0))), F.lit(1.0)), F.lit(1e-6)).alias("__median"))
    scaled = w / F.col("__median")
    fixed = F.when(finite(scaled), scaled).otherwise(F.lit(1.0))
    top = float(ratio)
    return views.crossJoin(F.broadcast(median)).withColumn(weight, F.least(F.greatest(fixed, F.lit(1.0 / max(top, 1.0))), F.lit(top))).drop("__median")


def mad_noise(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """(mad): 1.4826 times the median distance from the median of the finite values; 0 if there are none."""
    keys = keys or []
    x = df.select(*keys, F.when(finite(F.col(column)), F.col(column).cast("double")).alias("x"))
    medians = order_statistics(x, "x", [0.5], keys).select(*keys, F.get("q", F.lit(0)).alias("m"))
    joined = x.join(_kept(medians), keys) if keys else x.crossJoin(F.broadcast(medians))
    spread = order_statistics(joined.select(*keys, F.abs(F.col("x") - F.col("m")).alias("d")), "d", [0.5], keys).select(*keys, F.get("q", F.lit(0)).alias("d"))
    mad = (1.4826 * F.coalesce("d", F.lit(0.0))).alias("mad")
    return df.select(*keys).distinct().join(spread, keys, "left").select(*keys, mad) if keys else spread.agg(F.max("d").alias("d")).select(mad)


def weighted_residual(df: DataFrame, predicted: str, measured: str, weight: str | None, keys: list[str]) -> DataFrame:
    """sum((w (p - m))^2) / max(sum((w m)^2), 1e-12) over arrays of pixels, one row per key."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    diff = F.zip_with(predicted, measured, lambda p, m: p.cast("double") - m.cast("double"))
    parts = df.select(*keys, (w * w * square(diff)).alias("top"), (w * w * square(F.transform(measured, lambda m: m.cast("double")))).alias("bottom"))
    return parts.groupBy(*keys).agg((F.sum("top") / F.greatest(F.sum("bottom"), F.lit(1e-12))).alias("residual"))


def squared_residual(df: DataFrame, predicted: str, measured: str, keys: list[str] | None = None) -> DataFrame:
    """Half the squared distance between two arrays, summed over rows."""
    part = F.aggregate(F.zip_with(predicted, measured, lambda p, m: p.cast("double") - m.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    return df.groupBy(*(keys or [])).agg((0.5 * F.sum(part)).alias("data_term"))


def array_norms(data: str, other: str | None = None) -> dict[str, Column]:
    """Aggregates over arrays of a row: squared norm, inner product, absolute sum, negative energy's numerator."""
    x = F.transform(data, lambda v: v.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    out = {
        "sum_sq": total(F.transform(x, lambda v: v * v)),
        "sum_abs": total(F.transform(x, lambda v: F.abs(v))),
        "neg_sq": total(F.transform(x, lambda v: F.least(v, F.lit(0.0)) * F.least(v, F.lit(0.0)))),
    }
    if other is not None:
        out["dot"] = total(F.zip_with(x, other, lambda a, b: a * b.cast("double")))
        out["diff_sq"] = total(F.zip_with(x, other, lambda a, b: (a - b.cast("double")) * (a - b.cast("double"))))
    return out


def relative_change(diff_sq: Column, reference_sq: Column) -> Column:
    return F.sqrt(diff_sq) / F.greatest(F.sqrt(reference_sq), F.lit(1e-12))


def negative_energy(neg_sq: Column, sum_sq: Column) -> Column:
    return neg_sq / F.greatest(sum_sq, F.lit(1e-12))


def rmse(diff_sq: Column, n: Column) -> Column:
    return F.sqrt(diff_sq / n)


def relative_rmse(diff_sq: Column, reference_sq: Column) -> Column:
    return F.sqrt(diff_sq) / F.greatest(F.sqrt(reference_sq), F.lit(1e-12))


def gradient_energy(image: Column, rows: Column | int, cols: Column | int) -> Column:
    """Mean squared gradient: central differences inside, one-sided at the edges; 0 for less than 2 x 2."""
    from voxelmill.operators.arrays import _c, _div, _indexes

    r, c = _c(rows), _c(cols)
    at = lambda i, j: F.get(image, (i * c + j).cast("int"))

    def square(k: Column) -> Column:
        i, j = _div(k, c), k % c
        low_j, high_j = F.greatest(j - 1, F.lit(0)), F.least(j + 1, c - 1)
        low_i, high_i = F.greatest(i - 1, F.lit(0)), F.least(i + 1, r - 1)
        gx = (at(i, high_j) - at(i, low_j)) / F.greatest(high_j - low_j, F.lit(1))
        gy = (at(high_i, j) - at(low_i, j)) / F.greatest(high_i - low_i, F.lit(1))
        return gx * gx + gy * gy

    total = F.aggregate(F.transform(_indexes(r * c), square), F.lit(0.0), lambda a, x: a + x)
    return F.when((r < 2) | (c < 2), F.lit(0.0)).otherwise(total / (r * c))


def laplacian_variance(image: Column, rows: Column | int, cols: Column | int) -> Column:
    """Population variance of the five-point Laplacian, whose border of zeros counts."""
    from voxelmill.operators.arrays import _c, _div, _indexes

    r, c = _c(rows), _c(cols)
    at = lambda i, j: F.get(image, (i * c + j).cast("int"))

    def value(k: Column) -> Column:
        i, j = _div(k, c), k % c
        inner = (i > 0) & (i < r - 1) & (j > 0) & (j < c - 1)
        return F.when(inner, at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4.0 * at(i, j)).otherwise(F.lit(0.0))

    lap = F.transform(_indexes(r * c), value)
    sums = F.aggregate(lap, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: F.greatest(a["q"] / (r * c) - a["s"] / (r * c) * (a["s"] / (r * c)), F.lit(0.0)))
    return sums


def shannon_entropy(image: Column, bins: int = 256) -> Column:
    """Entropy in nats of an image in [0, 1] over equal bins, the last closed at 1; values outside do not count."""
    seen = F.filter(image, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    binned = F.array_sort(F.transform(seen, lambda x: F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")))

    def entropy(b: Column) -> Column:
        # runs of equal bins in sorted order; b is bound, so its size is not worked out again for each element
        zero = F.struct(F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("h"))
        n = F.greatest(F.size(b), F.lit(1))
        term = lambda run: F.when(run > 0, -(run / n) * F.ln(run / n + 1e-12)).otherwise(F.lit(0.0))
        step = lambda a, x: F.when(a["bin"] == x, F.struct(a["bin"].alias("bin"), (a["run"] + 1).alias("run"), a["h"].alias("h"))).otherwise(F.struct(x.alias("bin"), F.lit(1).cast("long").alias("run"), (a["h"] + term(a["run"])).alias("h")))
        return F.greatest(F.aggregate(b, zero, step, lambda a: a["h"] + term(a["run"])), F.lit(0.0))

    return F.get(F.transform(F.array(binned), entropy), 0)


def ssim(a: Column, b: Column, rows: int, cols: int) -> Column:
    """Mean structural similarity of two images over 7 x 7 windows; the span of values is the first image's."""
    from voxelmill.operators import kernels

    @F.pandas_udf("double")
    def run(x, y):
        import numpy as np
        import pandas as pd

        return pd.Series([kernels.ssim(np.asarray(p, float).reshape(rows, cols), np.asarray(q, float).reshape(rows, cols)) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def min_max(df: DataFrame, column: str, out: str, higher_is_better: bool = True) -> DataFrame:
    """column scaled to [0, 1] over the rows (NaN as the least), turned around if lower is better."""
    x = F.when(finite(F.col(column)), F.col(column).cast("double"))
    span = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    scaled = (F.coalesce(x, F.col("__lo")) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-12)
    value = F.coalesce(scaled if higher_is_better else 1.0 - scaled, F.lit(0.0))
    return df.crossJoin(F.broadcast(span)).withColumn(out, value).drop("__lo", "__hi")


def focus_scores(df: DataFrame) -> DataFrame:
    """df (gradient_energy, laplacian_variance, entropy) with ``combined_score`` = 0.4 g + 0.4 l + 0.2 (1 - e)."""
    out = min_max(min_max(min_max(df, "gradient_energy", "__g"), "laplacian_variance", "__l"), "entropy", "__e", False)
    return out.withColumn("combined_score", 0.4 * F.col("__g") + 0.4 * F.col("__l") + 0.2 * F.col("__e")).drop("__g", "__l", "__e")


def qc_pivot(rows: DataFrame) -> DataFrame:
    """rows (position, volume, split, residual) to (volume, tune, qc): the last finite residual of each, known volumes first."""
    clean = rows.select("position", F.lower(F.trim("volume")).alias("volume"), F.lower(F.trim("split")).alias("split"), F.col("residual").cast("double").alias("residual")).where("volume <> '' AND split IN ('tune', 'qc')")
    last = lambda name: F.max_by(F.col("residual"), F.when((F.col("split") == name) & finite(F.col("residual")), F.col("position")))
    # The order in which the volumes are shown.
    rank = F.when(F.col("volume") == "fdk", 0).when(F.col("volume") == "prior", 1).when(F.col("volume") == "final", 2).otherwise(3)
    return clean.groupBy("volume").agg(last("tune").alias("tune"), last("qc").alias("qc"), F.min("position").alias("__first")).orderBy(rank, "__first").drop("__first")


def ordered_distinct(df: DataFrame, column: str, position: str) -> DataFrame:
    """(value, position): non-empty trimmed values with the place of their first occurrence."""
    return df.select(F.trim(column).alias("value"), position).where("value <> ''").groupBy("value").agg(F.min(position).alias("position"))


def histogram(df: DataFrame, column: str, bins: int = 96, every: int = 1, position: str | None = None) -> DataFrame:
    """(bin, n): equal bins between the least and greatest finite value; every n-th row by position, if asked."""
    x = df if every <= 1 or position is None else df.where(F.col(position) % every == 0)
    x = x.select(F.col(column).cast("double").alias("x")).where(finite(F.col("x")))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return x.crossJoin(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def median_step(df: DataFrame, angle: str, order: str) -> DataFrame:
    """(step): median absolute difference of neighbouring angles."""
    ordered = with_previous(df.select(F.col(angle).cast("double").alias("a"), F.col(order).alias("o")), "a", ["o"], "b")
    return order_statistics(ordered.select(F.abs(F.col("a") - F.col("b")).alias("d")), "d", [0.5]).agg(F.max(F.get("q", F.lit(0))).alias("step"))


def gpu_totals(gpus: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Count, least and summed free and total memory of the selected devices."""
    rows = gpus if wanted is None else gpus.where(F.col("gpu_id").isin(wanted))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("free_gb").alias("min_free"), F.min("total_gb").alias("min_total"), F.sum("free_gb").alias("sum_free"), F.sum("total_gb").alias("sum_total"))
