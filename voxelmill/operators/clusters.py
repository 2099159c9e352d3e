"""Greedy clusters of near-equal angles over many tasks.

The rule is sequential: in ascending order each angle that is not yet taken is a seed and takes what lies within the tolerance around the
circle. Within one turn only its first seed reaches over the end of the turn; past that, the seed after an angle s is the first angle
beyond s + tolerance. That is a pointer from every angle to another, and pointer jumping finds all seeds in as many rounds as the
number of seeds has binary digits. Further turns, if the angles span several, first give their angles to the seeds of the turns before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.functions.scalars import circular_distance, finite
from voxelmill.operators.ordering import number_rows
from voxelmill.session import checkpoint_folder

_TURN = 2 * math.pi


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _numbered(df: DataFrame, order: str, keys: list[str], out: str) -> DataFrame:
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long")) if keys else number_rows(df, [order], out)


def _pointers(points: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """points (keys, a), all different, with ``next``: the least angle beyond a + tolerance, null if there is none.

    In buckets as wide as the tolerance it lies in the bucket after a's own, or is the first angle of the next one that has any.
    """
    own = F.floor(F.col("a") / tolerance).cast("long")
    placed = points.withColumn("b", own)
    values = placed.select(*keys, "b", F.col("a").alias("v"), F.lit(None).cast("double").alias("a"))
    probes = placed.select(*keys, (F.col("b") + 1).alias("b"), (F.col("a") + tolerance).alias("v"), "a")
    # from the greatest value down, so the least value so far is the first beyond; at a tie the probe comes first, as it needs more
    down = Window.partitionBy(*keys, "b").orderBy(F.desc("v"), F.desc_nulls_last("a")).rowsBetween(Window.unboundedPreceding, 0)
    near = values.unionByName(probes).withColumn("near", F.min(F.when(F.col("a").isNull(), F.col("v"))).over(down)).where("a IS NOT NULL").select(*keys, "a", (F.col("b") - 1).alias("b"), "near")
    buckets = _cut(_numbered(placed.groupBy(*keys, "b").agg(F.min("a").alias("first")), "b", keys, "k"))
    later = lambda d: buckets.select(*keys, (F.col("k") - d).alias("k"), F.col("b").alias(f"b{d}"), F.col("first").alias(f"first{d}"))
    after = buckets.join(later(1), [*keys, "k"], "left").join(later(2), [*keys, "k"], "left")
    far = after.select(*keys, "b", F.when(F.col("b1") == F.col("b") + 1, F.col("first2")).otherwise(F.col("first1")).alias("far"))
    return near.join(far, [*keys, "b"]).select(*keys, "a", F.coalesce("near", "far").alias("next"))


def _reached(pointers: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a): the starts and all that the pointers lead to from them."""
    jump, reached, known = _cut(pointers.where("next IS NOT NULL")), _cut(starts), -1
    while known != (n := reached.count()):
        known = n
        more = reached.join(jump, [*keys, "a"]).select(*keys, F.col("next").alias("a"))
        reached = _cut(reached.unionByName(more).distinct())
        then = jump.select(*keys, F.col("a").alias("next"), F.col("next").alias("then"))
        jump = _cut(jump.join(then, [*keys, "next"]).select(*keys, "a", F.col("then").alias("next")))
    return reached


def _chain(points: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, a, seed) of angles along a line."""
    if tolerance == 0:
        return points.select(*keys, "a", F.col("a").alias("seed"))
    starts = points.groupBy(*keys).agg(F.min("a").alias("a")).where("a IS NOT NULL")
    seeds = _reached(_pointers(points, keys, tolerance), starts, keys).withColumnRenamed("a", "seed")
    bucket = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    spots = seeds.select(*keys, "seed", F.explode(F.array(bucket("seed"), bucket("seed") + 1)).alias("b"))
    return points.withColumn("b", bucket("a")).join(spots, [*keys, "b"]).where("seed <= a").groupBy(*keys, "a").agg(F.max("seed").alias("seed"))


def _taken(points: DataFrame, seeds: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, a, seed) of the points within the tolerance of a seed around the circle; the least seed takes them."""
    n = max(1, math.floor(_TURN / max(tolerance, 1e-6)))
    sector = lambda c: F.least(F.floor(F.pmod(F.col(c), F.lit(_TURN)) / (_TURN / n)), F.lit(n - 1)).cast("long")
    near = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.pmod(sector("seed") + d, F.lit(n))))
    met = points.withColumn("b", sector("a")).join(seeds.select(*keys, "seed", F.explode(near).alias("b")), [*keys, "b"])
    return met.where(_distance("a", "seed") <= tolerance).groupBy(*keys, "a").agg(F.min("seed").alias("seed"))


def _distance(a: str, b: str) -> Column:
    return circular_distance(F.col(a), F.col(b))


def angle_clusters(views: DataFrame, angle: str, position: str, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, position, cluster, seed): clusters are numbered per key in the order of their seeds' angles; seed is the position of the seed.

    Of equal angles the first position is the seed. Rows whose angle is null or not finite have a null cluster and seed. Keys are not
    null. Work is spread by angle: a bucket, as wide as the tolerance, is a task's least share, and equal angles count once in it.
    """
    keys, tol = keys or [], max(float(tolerance), 0.0)
    rows = views.select(*keys, position, (F.col(angle).cast("double") + 0.0).alias("a"))
    points = rows.where(finite(F.col("a"))).groupBy(*keys, "a").agg(F.min(position).alias("first_position"))
    least = points.groupBy(*keys).agg(F.min("a").alias("least"))
    spread = points.join(least, keys) if keys else points.crossJoin(F.broadcast(least))
    turned = _cut(spread.select(*keys, "a", "first_position", F.floor((F.col("a") - F.col("least")) / _TURN).cast("long").alias("turn")))

    done = None
    for (turn,) in sorted(turned.select("turn").distinct().collect()):  # a turn of the circle each
        rest = turned.where(F.col("turn") == turn).select(*keys, "a")
        if done is not None:
            early = _cut(_taken(rest, done.select(*keys, "seed").distinct(), keys, tol))
            done, rest = done.unionByName(early), rest.join(early, [*keys, "a"], "left_anti")
        first = rest.groupBy(*keys).agg(F.min("a").alias("seed")).where("seed IS NOT NULL")
        met = _cut(rest.join(first, keys) if keys else rest.crossJoin(F.broadcast(first)))
        near = _distance("a", "seed") <= tol
        now = met.where(near).unionByName(_chain(met.where(~near).select(*keys, "a"), keys, tol))
        done = _cut(now if done is None else done.unionByName(now))
    if done is None:
        return rows.select(*keys, position, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast(dict(views.dtypes)[position]).alias("seed"))
    seeds = turned.select(*keys, F.col("a").alias("seed"), F.col("first_position").alias("seed_position")).join(done.select(*keys, "seed").distinct(), [*keys, "seed"])
    numbers = _numbered(seeds, "seed", keys, "cluster")
    placed = done.join(numbers, [*keys, "seed"]).select(*keys, "a", F.col("cluster").cast("int").alias("cluster"), F.col("seed_position").alias("seed"))
    return rows.join(placed, [*keys, "a"], "left").select(*keys, position, "cluster", "seed")
