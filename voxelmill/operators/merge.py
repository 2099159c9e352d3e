"""Merging of data sets: clusters of near-equal angles, inverse-variance weighted means, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.operators.clusters import angle_clusters as angle_clusters


def merge_clusters(views: DataFrame, data: str, angle: str, weight: str | None, cluster: list[str]) -> DataFrame:
    """One row per cluster: pixels and angle weighted by the squared weight (at least 1e-6), weight the root of the summed squares.

    Without weights: the plain mean, weight null. The angle's mean is linear. Pixels meet by (cluster, place), so a large cluster is no large task.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.col(weight).cast("double"), F.lit(1e-6))
    v = views.withColumn("__v", w * w)
    per_cluster = v.groupBy(*cluster).agg((F.sum(F.col(angle).cast("double") * F.col("__v")) / F.greatest(F.sum("__v"), F.lit(1e-12))).alias(angle), (F.sqrt(F.sum("__v")) if weight is not None else F.lit(None).cast("double")).alias(weight or "weight"), F.count(F.lit(1)).alias("merged"))
    pixels = v.select(*cluster, "__v", F.posexplode(data).alias("pos", "value")).groupBy(*cluster, "pos").agg((F.sum(F.col("value").cast("double") * F.col("__v")) / F.greatest(F.sum("__v"), F.lit(1e-12))).alias("value"))
    images = pixels.groupBy(*cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"].cast("float")).alias(data))
    return per_cluster.join(images, cluster)


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The same merge for scalar rows: (keys, value, weight)."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(1e-6))
    return df.select(*keys, F.col(value).cast("double").alias("x"), (w * w).alias("v")).groupBy(*keys).agg((F.sum(F.col("x") * F.col("v")) / F.greatest(F.sum("v"), F.lit(1e-12))).alias(value), F.sqrt(F.sum("v")).alias(weight))


def stack(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts, repeats included; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fill_weights(parts: list[DataFrame], weight: str, ones: bool) -> list[DataFrame]:
    """If any part has no weights: all parts get ones, or none keeps any."""
    known = [weight in p.columns for p in parts]
    if all(known):
        return parts
    value = F.lit(1.0) if ones else F.lit(None).cast("double")
    return [p.withColumn(weight, value) for p in parts]


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts).distinct()


def difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.join(b, on, "left_anti")


def drop_endpoint(views: DataFrame, ends: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """views without the last row of the keys whose first and last angle coincide; ends: (keys, repeats)."""
    last = views.groupBy(*keys).agg(F.max(order).alias("__last"))
    marked = views.join(last.join(ends, keys), keys)
    return marked.where(~(F.col("repeats") & (F.col(order) == F.col("__last")))).drop("__last", "repeats")
