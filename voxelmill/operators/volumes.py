"""Volumes as one row per slice: (volume_id, z, ny, nx, data), data row-major.

In-slice neighbours are array indexes; neighbours across slices are ``lead`` and ``lag`` over z, so a volume is never exploded
to voxels unless they have to meet by coordinate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.operators import kernels
from voxelmill.operators.arrays import _div, _indexes
from voxelmill.operators.ordering import order_statistics



def _by_z():
    return Window.partitionBy("volume_id").orderBy("z")


def voxels(df: DataFrame) -> DataFrame:
    """(volume_id, z, y, x, value)."""
    return df.select("volume_id", "z", "nx", F.posexplode("data").alias("k", "value")).select("volume_id", "z", _div(F.col("k"), F.col("nx")).alias("y"), (F.col("k") % F.col("nx")).alias("x"), "value")


def from_voxels(df: DataFrame, ny: Column | int, nx: Column | int) -> DataFrame:
    """Slices of (volume_id, z, y, x, value); every voxel of a slice must be there."""
    ny, nx = [F.lit(v) if isinstance(v, int) else v for v in (ny, nx)]
    values = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "value"))), lambda s: s["value"])
    return df.groupBy("volume_id", "z").agg(values.alias("data")).select("volume_id", "z", ny.alias("ny"), nx.alias("nx"), "data")


def block_mean(df: DataFrame, factor: int) -> DataFrame:
    """Mean over cubes; sizes must divide by the factor. Sums inside the slice first, so only reduced slices are shuffled."""
    nx2 = _div(F.col("nx"), factor)
    ny2 = _div(F.col("ny"), factor)
    inner = F.transform(_indexes(ny2 * nx2), lambda k: F.aggregate(_indexes(F.lit(factor * factor)), F.lit(0.0), lambda a, j: a + F.get("data", ((_div(k, nx2) * factor + _div(j, factor)) * F.col("nx") + k % nx2 * factor + j % factor).cast("int"))))
    fits = ((F.col("ny") % factor) == 0) & ((F.col("nx") % factor) == 0)
    # the sums first: in one select, a lambda would see the new sizes instead of the old
    summed = df.withColumn("__s", F.when(fits, inner).otherwise(F.raise_error(F.lit("sizes do not divide by the factor")).cast("array<double>")))
    part = summed.select("volume_id", _div(F.col("z"), factor).alias("z"), ny2.alias("ny"), nx2.alias("nx"), F.col("__s").alias("data"))
    long = part.select("volume_id", "z", "ny", "nx", F.posexplode("data").alias("k", "v")).groupBy("volume_id", "z", "ny", "nx", "k").agg((F.sum("v") / (factor**3)).cast("float").alias("v"))
    return long.groupBy("volume_id", "z", "ny", "nx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("data"))


def resize(df: DataFrame, nz: int, ny: int, nx: int) -> DataFrame:
    """Cropped or zero-padded at the far ends to a shape."""
    grid = df.select("volume_id").distinct().select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(nz - 1))).alias("z"))
    old = df.select("volume_id", "z", F.col("nx").alias("__nx"), F.col("ny").alias("__ny"), F.col("data").alias("__d"))
    joined = grid.join(old, ["volume_id", "z"], "left")
    y, x = lambda k: _div(k, nx), lambda k: k % nx
    value = lambda k: F.when(F.col("__d").isNotNull() & (y(k) < F.col("__ny")) & (x(k) < F.col("__nx")), F.get("__d", (y(k) * F.col("__nx") + x(k)).cast("int")))
    return joined.select("volume_id", "z", F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), F.transform(_indexes(F.lit(ny * nx)), lambda k: F.coalesce(value(k), F.lit(0.0)).cast("float")).alias("data"))


def axial(df: DataFrame, z: int | None = None) -> DataFrame:
    """One slice of each volume; the middle one by default; out of range is clamped."""
    n = df.groupBy("volume_id").agg(F.max("z").alias("__last"))
    at = _div(F.col("__last") + 1, 2) if z is None else F.least(F.greatest(F.lit(z), F.lit(0)), F.col("__last"))
    return df.join(n, "volume_id").where(F.col("z") == at).select("volume_id", "z", F.col("ny").alias("rows"), F.col("nx").alias("cols"), "data")


def across(df: DataFrame, plane: str, at: int | None = None) -> DataFrame:
    """A coronal (y fixed) or sagittal (x fixed) image of each volume: rows are z. Each slice gives one line, so little is shuffled."""
    size = F.col("ny") if plane == "coronal" else F.col("nx")
    place = _div(size, 2) if at is None else F.least(F.greatest(F.lit(at), F.lit(0)), size - 1)
    if plane == "coronal":
        line, cols = F.slice("data", place * F.col("nx") + 1, F.col("nx")), F.col("nx")
    elif plane == "sagittal":
        line, cols = F.transform(_indexes(F.col("ny")), lambda y: F.get("data", (y * F.col("nx") + place).cast("int"))), F.col("ny")
    else:
        raise ValueError(f"unknown plane {plane}")
    lines = df.select("volume_id", "z", line.alias("line"), cols.alias("cols"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("z", "line"))), lambda s: s["line"]))
    return lines.groupBy("volume_id").agg(F.count(F.lit(1)).cast("int").alias("rows"), F.first("cols").alias("cols"), ordered.alias("data"))


def gradient(df: DataFrame) -> DataFrame:
    """df with gx, gy, gz: forward differences, 0 at the far ends."""
    return differences(df.withColumn("__next", F.lead("data").over(_by_z())))


def differences(ahead: DataFrame) -> DataFrame:
    """The gradient of slices that hold the next slice's data as ``__next``, null at the last."""
    k_of = lambda f: F.transform("data", lambda v, k: f(v.cast("double"), k))
    gx = k_of(lambda v, k: F.when(k % F.col("nx") < F.col("nx") - 1, F.get("data", k + 1).cast("double") - v).otherwise(F.lit(0.0)))
    gy = k_of(lambda v, k: F.when(_div(k, F.col("nx")) < F.col("ny") - 1, F.get("data", (k + F.col("nx")).cast("int")).cast("double") - v).otherwise(F.lit(0.0)))
    gz = F.when(F.col("__next").isNull(), F.transform("data", lambda v: F.lit(0.0))).otherwise(F.zip_with("__next", "data", lambda b, a: b.cast("double") - a.cast("double")))
    return ahead.withColumns({"gx": gx, "gy": gy, "gz": gz}).drop("__next")


def gradient_adjoint(df: DataFrame, out: str = "adjoint") -> DataFrame:
    """df (gx, gy, gz) with the adjoint of gradient applied: what flows into a voxel less what flows out."""
    return inflow(df.withColumns({"__before": F.lag("gz").over(_by_z()), "__last": F.lead("z").over(_by_z()).isNull()}), out)


def inflow(behind: DataFrame, out: str) -> DataFrame:
    """The adjoint for slices that hold the former slice's gz as ``__before``, null at the first, and whether they are the ``__last``."""

    def value(v: Column, k: Column) -> Column:
        x, y = k % F.col("nx"), _div(k, F.col("nx"))
        zero = F.lit(0.0)
        in_x = F.when(x > 0, F.get("gx", k - 1)).otherwise(zero) - F.when(x < F.col("nx") - 1, v).otherwise(zero)
        in_y = F.when(y > 0, F.get("gy", (k - F.col("nx")).cast("int"))).otherwise(zero) - F.when(y < F.col("ny") - 1, F.get("gy", k)).otherwise(zero)
        in_z = F.when(F.col("__before").isNotNull(), F.get("__before", k)).otherwise(zero) - F.when(~F.col("__last"), F.get("gz", k)).otherwise(zero)
        return in_x + in_y + in_z

    return behind.withColumn(out, F.transform("gx", lambda v, k: value(v, k))).drop("__before", "__last")


def divergence(df: DataFrame, out: str = "divergence") -> DataFrame:
    """The negative adjoint."""
    return gradient_adjoint(df, out).withColumn(out, F.transform(out, lambda v: -v))


def laplacian(df: DataFrame, out: str = "laplacian") -> DataFrame:
    """Divergence of the gradient."""
    return divergence(gradient(df), out).drop("gx", "gy", "gz")


def magnitude(epsilon: float = 0.0) -> Column:
    """sqrt(gx^2 + gy^2 + gz^2 + eps^2) per voxel, from the columns gx, gy and gz."""
    xy = F.zip_with("gx", "gy", lambda a, b: a * a + b * b)
    return F.zip_with(xy, "gz", lambda a, c: F.sqrt(a + c * c + epsilon * epsilon))


def _scaled(df: DataFrame, factor: Column) -> DataFrame:
    with_factor = df.withColumn("__f", factor)
    return with_factor.withColumns({g: F.zip_with(g, "__f", lambda a, f: a * f) for g in ("gx", "gy", "gz")}).drop("__f")


def shrink(df: DataFrame, threshold: float) -> DataFrame:
    """Isotropic shrinkage of (gx, gy, gz)."""
    return _scaled(df, F.transform(magnitude(), lambda m: F.greatest(1.0 - threshold / F.greatest(m, F.lit(1e-12)), F.lit(0.0))))


def project_ball(df: DataFrame, radius: float) -> DataFrame:
    """(gx, gy, gz) of every voxel drawn into a ball; a radius of 0 or less gives zeros."""
    if radius <= 0:
        return _scaled(df, F.transform("gx", lambda _: F.lit(0.0)))
    return _scaled(df, F.transform(magnitude(), lambda m: 1.0 / F.greatest(m / radius, F.lit(1.0))))


def tv_gradient(df: DataFrame, epsilon: float, out: str = "tv_gradient") -> DataFrame:
    """Gradient of the smoothed total variation."""
    unit = _scaled(gradient(df), F.transform(magnitude(epsilon), lambda m: 1.0 / m))
    return gradient_adjoint(unit, out).drop("gx", "gy", "gz")


def tv_norm(df: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(volume_id, tv): isotropic total variation."""
    return gradient(df).groupBy("volume_id").agg(F.sum(F.aggregate(magnitude(epsilon), F.lit(0.0), lambda a, x: a + x)).alias("tv"))


def tv_roughness(df: DataFrame) -> DataFrame:
    """(volume_id, roughness): summed absolute differences over the summed absolute values."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return gradient(df).groupBy("volume_id").agg((F.sum(total("gx") + total("gy") + total("gz")) / F.greatest(F.sum(total("data")), F.lit(1e-12))).alias("roughness"))


def percentiles(df: DataFrame, ps: list[float]) -> DataFrame:
    """(volume_id, p): exact percentiles of the finite voxels."""
    return order_statistics(voxels(df), "value", ps, ["volume_id"]).select("volume_id", F.col("q").alias("p"))


def overlap_average(df: DataFrame, depth: int, slab: int, overlap: int, fn, schema_extra: str = "") -> DataFrame:
    """fn on each slab of slices (a 3-D array in, one out), overlapping slices averaged.

    One task per (volume, slab): slabs bound a task's memory. The last join adds up at most two arrays a slice.
    """
    cuts = kernels.slabs(depth, slab, overlap)
    numbered = F.filter(F.array(*[F.struct(F.lit(n).alias("slab"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in enumerate(cuts)]), lambda s: (F.col("z") >= s["a"]) & (F.col("z") < s["b"]))
    each = df.withColumn("__s", F.explode(numbered)).withColumn("slab", F.col("__s.slab")).drop("__s")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("z")
        cube = np.stack([np.asarray(d, np.float64).reshape(n, m) for d, n, m in zip(pdf["data"], pdf["ny"], pdf["nx"], strict=True)])
        done = fn(cube)
        return pd.DataFrame({"volume_id": pdf["volume_id"], "z": pdf["z"], "ny": pdf["ny"], "nx": pdf["nx"], "data": [x.reshape(-1) for x in done]})

    kind = dict(df.dtypes)["volume_id"]
    parts = each.groupBy("volume_id", "slab").applyInPandas(run, f"volume_id {kind}, z int, ny int, nx int, data array<double>")
    summed = parts.groupBy("volume_id", "z", "ny", "nx").agg(F.collect_list("data").alias("all"))
    mean = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", 0), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return summed.select("volume_id", "z", "ny", "nx", F.transform(mean, lambda v: (v / F.size("all")).cast("float")).alias("data"))


def tv_denoise(df: DataFrame, depth: int, weight: float, epsilon: float = 1e-4, iterations: int = 50, slab: int = 96, overlap: int = 12) -> DataFrame:
    """Total-variation denoising slab by slab."""
    return overlap_average(df, depth, slab, overlap, lambda cube: kernels.tv_denoise(cube, weight, epsilon, iterations))


def smooth(df: DataFrame, depth: int, sigma: float, slab: int = 96) -> DataFrame:
    """Gaussian smoothing; slabs overlap by the filter's reach, and only slices away from their inner edges are kept."""
    reach = int(4 * sigma + 0.5)
    cuts = [(a, min(depth, a + slab)) for a in range(0, depth, slab)]
    pick = F.filter(F.array(*[F.struct(F.lit(n).alias("slab"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in enumerate(cuts)]), lambda s: (F.col("z") >= s["a"] - reach) & (F.col("z") < s["b"] + reach))
    each = df.withColumn("__s", F.explode(pick)).withColumns({"slab": F.col("__s.slab"), "__a": F.col("__s.a"), "__b": F.col("__s.b")}).drop("__s")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("z")
        cube = np.stack([np.asarray(d, np.float64).reshape(n, m) for d, n, m in zip(pdf["data"], pdf["ny"], pdf["nx"], strict=True)])
        keep = ((pdf["z"] >= pdf["__a"]) & (pdf["z"] < pdf["__b"])).to_numpy()
        done = kernels.gaussian(cube, sigma)[keep].astype(np.float32)
        own = pdf[keep]
        return pd.DataFrame({"volume_id": own["volume_id"], "z": own["z"], "ny": own["ny"], "nx": own["nx"], "data": [x.reshape(-1) for x in done]})

    return each.groupBy("volume_id", "slab").applyInPandas(run, f"volume_id {dict(df.dtypes)['volume_id']}, z int, ny int, nx int, data array<float>")


def shape(df: DataFrame) -> DataFrame:
    """(volume_id, nz, ny, nx)."""
    return df.groupBy("volume_id").agg((F.max("z") + 1).alias("nz"), F.max("ny").alias("ny"), F.max("nx").alias("nx"))


def _mix(data: str, ny: Column, nx: Column, axis: str, n: Column, taps: Column, index: Callable[[Column, Column], Column], weight: Callable[[Column, Column], Column]) -> Column:
    """A slice with n places along y or x, each the weighted sum of ``taps`` places: tap t of place k is at index(k, t)."""

    def mixed(d: Column) -> Column:
        total = lambda k, at: F.aggregate(_indexes(taps), F.lit(0.0), lambda a, t: a + weight(k, t) * F.get(d, at(index(k, t)).cast("int")).cast("double"))
        if axis == "x":
            return F.transform(_indexes(ny * n), lambda k: total(k % n, lambda i: _div(k, n) * nx + i))
        return F.transform(_indexes(n * nx), lambda k: total(_div(k, nx), lambda i: i * nx + k % nx))

    # bound, as a one-element array: what data is computed from is not worked out again for each tap
    return F.get(F.transform(F.array(F.col(data)), mixed), 0)


def _summed(parts: DataFrame) -> DataFrame:
    """Slices of parts (volume_id, z, ny, nx, source, weight, data): weighted sums of the few slices that feed each, in the order of their sources."""
    lists = parts.groupBy("volume_id", "z", "ny", "nx").agg(F.array_sort(F.collect_list(F.struct("source", "weight", "data"))).alias("all"))
    zero = F.transform(F.get("all", 0)["data"], lambda _: F.lit(0.0))
    return lists.select("volume_id", "z", "ny", "nx", F.aggregate("all", zero, lambda a, s: F.zip_with(a, s["data"], lambda x, y: x + s["weight"] * y.cast("double"))).alias("data"))


def gaussian(df: DataFrame, depth: int, sigma: float) -> DataFrame:
    """Gaussian smoothing by expressions: along x and y within the slice, along z by a relation of slices; cut at four sigma, edges reflected."""
    if sigma <= 0:
        return df.select("volume_id", "z", "ny", "nx", F.transform("data", lambda v: v.cast("double")).alias("data"))
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w = (w / w.sum()).tolist()

    def at(n: Column) -> Callable[[Column, Column], Column]:
        folded = lambda k, t: F.pmod(k + t - r, n * 2)
        return lambda k, t: F.when(folded(k, t) < n, folded(k, t)).otherwise(n * 2 - 1 - folded(k, t))

    weight = lambda _, t: F.get(F.array(*[F.lit(x) for x in w]), t)
    ny, nx, taps = F.col("ny"), F.col("nx"), F.lit(2 * r + 1)
    flat = df.withColumn("data", _mix("data", ny, nx, "x", nx, taps, at(nx), weight)).withColumn("data", _mix("data", ny, nx, "y", ny, taps, at(ny), weight))
    feeds: dict[tuple[int, int], float] = {}
    for z in range(depth):
        for t, x in enumerate(w):
            source = (z + t - r) % (2 * depth)
            source = source if source < depth else 2 * depth - 1 - source
            feeds[source, z] = feeds.get((source, z), 0.0) + x
    relation = df.sparkSession.createDataFrame([(a, b, x) for (a, b), x in feeds.items()], "source int, to int, weight double")
    parts = flat.select("volume_id", F.col("z").alias("source"), "ny", "nx", "data").join(F.broadcast(relation), "source")  # a row per slice and tap
    return _summed(parts.select("volume_id", F.col("to").alias("z"), "ny", "nx", "source", "weight", "data"))


def resample(df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Volumes of any shapes on a grid of the given shape: block means where all sizes divide by it, else linear between neighbours, ends on ends."""
    counts = df.groupBy("volume_id").agg((F.max("z") + 1).alias("__nz"))
    rows = df.join(counts, "volume_id")
    old = {"z": F.col("__nz"), "y": F.col("ny"), "x": F.col("nx")}
    new = dict(zip("zyx", shape, strict=True))
    rows = rows.withColumn("__block", (old["z"] % new["z"] == 0) & (old["y"] % new["y"] == 0) & (old["x"] % new["x"] == 0))
    rows = rows.withColumns({f"__{a}": n for a, n in old.items()})

    def taps(axis: str) -> tuple:
        n, m, block = F.col(f"__{axis}"), new[axis], F.col("__block")
        place = lambda k: k * (n - 1) / (m - 1) if m > 1 else k * 0.0
        low = lambda k: F.least(F.floor(place(k)), F.greatest(n - 2, F.lit(0)))
        index = lambda k, t: F.when(block, k * _div(n, m) + t).otherwise(F.least(low(k) + t, n - 1))
        weight = lambda k, t: F.when(block, F.lit(float(m)) / n).when(t == 0, 1 - (place(k) - low(k))).otherwise(place(k) - low(k))
        return F.when(block, _div(n, m)).otherwise(F.lit(2)), index, weight

    flat = rows.withColumn("data", _mix("data", F.col("__y"), F.col("__x"), "x", F.lit(new["x"]), *taps("x"))).withColumn("data", _mix("data", F.col("__y"), F.lit(new["x"]), "y", F.lit(new["y"]), *taps("y")))
    count, index, weight = taps("z")
    share = lambda to: F.aggregate(_indexes(count), F.lit(0.0), lambda a, t: a + F.when(index(to, t) == F.col("z"), weight(to, t)).otherwise(F.lit(0.0)))
    fed = F.filter(F.transform(_indexes(F.lit(new["z"])), lambda to: F.struct(to.alias("to"), share(to).alias("w"))), lambda s: s["w"] != 0)
    parts = flat.select("volume_id", F.col("z").alias("source"), "data", F.explode(fed).alias("f"))
    return _summed(parts.select("volume_id", F.col("f.to").alias("z"), F.lit(new["y"]).alias("ny"), F.lit(new["x"]).alias("nx"), "source", F.col("f.w").alias("weight"), "data"))
