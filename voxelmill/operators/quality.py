"""How a smoothed volume compares with what it was, and how far a correction can be trusted: by slices and voxels, no task holds a volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.operators.ordering import _kept, order_statistics
from voxelmill.operators.stats import mad_noise
from voxelmill.operators.volumes import gaussian, gradient, magnitude


def _median(rows: DataFrame, column: str, out: str, p: float = 0.5) -> DataFrame:
    return order_statistics(rows, column, [p], ["volume_id"]).select("volume_id", F.get("q", F.lit(0)).alias(out))


def denoise_quality(df: DataFrame, smoothed: DataFrame, share: float = 0.95) -> DataFrame:
    """(volume_id, noise, correction, edges) of slices before and after.

    noise: MAD of what smoothing takes away; correction: the summed change over the summed values; edges: the median gradient that is
    left over the one that was, where that was among the strongest (from the quantile ``share`` on).
    """
    sized = lambda d, x, g: gradient(d).select("volume_id", "z", F.transform("data", lambda v: v.cast("double")).alias(x), magnitude().alias(g))
    both = sized(df, "x", "gx").join(sized(smoothed, "c", "gc"), ["volume_id", "z"])
    cells = _kept(both.select("volume_id", F.explode(F.arrays_zip("x", "gx", "c", "gc")).alias("v")).select("volume_id", "v.*"))
    # each number by itself: together their sorts and sums would be a hundred operators in each task
    noise = mad_noise(cells.select("volume_id", (F.col("x") - F.col("c")).alias("d")), "d", ["volume_id"]).withColumnRenamed("mad", "noise").transform(_kept)
    change = cells.groupBy("volume_id").agg((F.sum(F.abs(F.col("c") - F.col("x"))) / F.greatest(F.sum(F.abs("x")), F.lit(1e-12))).alias("correction")).transform(_kept)
    strong = _kept(cells.join(_median(cells, "gx", "least", share).transform(_kept), "volume_id").where("gx >= least"))
    edges = _median(strong, "gc", "after").join(_median(strong, "gx", "before"), "volume_id").select("volume_id", (F.col("after") / F.greatest("before", F.lit(1e-12))).alias("edges"))
    return noise.join(change, "volume_id").join(edges, "volume_id", "left").withColumn("edges", F.coalesce("edges", F.lit(1.0)))


def confidence(df: DataFrame, depth: int, tau_loss: float, sigma: float, low: float, high: float) -> DataFrame:
    """Slices (volume_id, z, ny, nx, delta, loss, and support as 0 and 1 if there is any) to the map of confidence in ``data``.

    It falls with the correction, measured by twice its median over the support, and with the lost gradient; smoothed, then clipped.
    """
    inside = F.arrays_zip("delta", "support") if "support" in df.columns else F.arrays_zip("delta", F.transform("delta", lambda _: F.lit(1)).alias("support"))
    cells = df.select("volume_id", F.explode(inside).alias("v")).where("v.support = 1").select("volume_id", F.col("v.delta").alias("d"))
    scaled = df.join(_median(cells, "d", "m"), "volume_id", "left").withColumn("tau", F.coalesce(F.col("m") * 2, F.lit(0.0)) + 1e-12)
    raw = F.zip_with("delta", "loss", lambda d, g: F.exp(-F.pow(d / F.col("tau"), F.lit(2.0))) * F.exp(-F.pow(g / tau_loss, F.lit(2.0))))
    smooth = gaussian(scaled.select("volume_id", "z", "ny", "nx", raw.alias("data")), depth, sigma)
    return smooth.withColumn("data", F.transform("data", lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)).cast("float")))
