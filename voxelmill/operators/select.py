"""Sorts, picks, splits and ranked selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.functions.scalars import finite, wrap_angle
from voxelmill.operators.ordering import number_rows, order_statistics


def robust_z_score(df: DataFrame, weights: dict[str, float], out: str = "score_total") -> DataFrame:
    """Weighted sum of (v - median) / max(q75 - q25, 1e-12) per metric; quartiles are of its finite values, in one row, which is broadcast."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in weights])).alias("m")).select("m.*")
    found = order_statistics(each, "v", [0.25, 0.5, 0.75], ["metric"])
    quartiles = found.agg(*[F.max_by("q", F.when(F.col("metric") == m, 1)).alias(f"__q_{m}") for m in weights])
    joined = df.crossJoin(F.broadcast(quartiles))
    z = [F.lit(float(w)) * (F.col(m) - F.col(f"__q_{m}")[1]) / F.greatest(F.col(f"__q_{m}")[2] - F.col(f"__q_{m}")[0], F.lit(1e-12)) for m, w in weights.items()]
    return joined.withColumn(out, reduce(lambda a, b: a + b, z)).drop(*[f"__q_{m}" for m in weights])


def select_min(df: DataFrame, score: str, position: str) -> DataFrame:
    """The row with the least score; the first position wins a tie; NaN scores never win. One row, or none if all are NaN."""
    best = F.min_by(F.struct("*"), F.struct(F.col(score), F.col(position)))
    return df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).agg(best.alias("best")).where("best IS NOT NULL").select("best.*")


def select_best(df: DataFrame, metric: str, position: str, lowest: bool | None = None) -> DataFrame:
    """The row with the best finite metric: the least of ``entropy`` (or if lowest), else the greatest; first position wins a tie; no row if none is finite."""
    low = metric == "entropy" if lowest is None else lowest
    rows = df.where(finite(F.col(metric)))
    score = F.col(metric).cast("double") if low else -F.col(metric).cast("double")
    return rows.agg(F.min_by(F.struct("*"), F.struct(score, F.col(position))).alias("best")).where("best IS NOT NULL").select("best.*")


def select_accepted(df: DataFrame, accepted: str, noise: str, strength: str, position: str, by_noise: bool = True) -> DataFrame:
    """The accepted row of least noise (or the first accepted); if none is, the row of least strength, flagged ``fallback``."""
    key = F.col(noise).cast("double") if by_noise else F.lit(0.0)
    rank = F.struct((~F.col(accepted)).alias("a"), F.when(F.col(accepted), key).otherwise(F.col(strength).cast("double")).alias("b"), F.col(position).alias("c"))
    return df.agg(F.min_by(F.struct("*", (~F.col(accepted)).alias("fallback")), rank).alias("best")).where("best IS NOT NULL").select("best.*")


def select_named(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows of a name, whatever its case and outer blanks; an error if there are none."""
    found = df.where(F.lower(F.trim(column)) == name.strip().lower())
    if found.isEmpty():
        raise ValueError(f"{name} was not evaluated")
    return found


def numbered(df: DataFrame, order: list[Column | str], out: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """df with its row number from 0, per key or, by ranges of the order, over the whole table."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) if keys else number_rows(df, order, out)


def by_angle(df: DataFrame, angle: str, position: str, wrapped: bool = True) -> DataFrame:
    """df with ``rank``: the stable order by the angle, wrapped to a turn or raw."""
    return numbered(df, [wrap_angle(F.col(angle)) if wrapped else F.col(angle).cast("double"), F.col(position)])


def reverse(df: DataFrame, position: str) -> DataFrame:
    """Rows in descending position, which is not renumbered."""
    return df.orderBy(F.desc(position))


def pick_evenly(df: DataFrame, rank: str, count: int) -> DataFrame:
    """count rows spread evenly over the ranks 0 to n - 1, rounded half to even.

    The ranks are rows. They differ by (n - 1) / (count - 1), which is one at least, so no two of them round to the same.
    """
    n = df.count()
    k = min(max(0, count), n)
    step = (n - 1) / (k - 1) if k > 1 else 0.0
    chosen = df.sparkSession.range(k).select(F.rint(F.col("id") * F.lit(step)).cast("long").alias(rank))
    return df.join(chosen, rank, "left_semi")


def split_views(views: DataFrame, angle: str, position: str, tune: int, qc: int, recon: int | None = None, seed: int | None = None) -> DataFrame:
    """views with ``split``: tune, qc, recon or unused. Tune views are picked evenly over the wrapped angles, then qc views from the rest, then recon.

    With a seed, the order is shuffled first (NumPy's PCG64, on the driver: views are few).
    """
    n = views.count()
    t = min(max(0, tune), n)
    q = min(max(0, qc), n - t)
    r = n - t - q if recon is None else min(max(0, recon), n - t - q)
    ordered = by_angle(views.select(F.col(position), F.col(angle)), angle, position)
    if seed is not None:
        order = np.array([row[0] for row in ordered.orderBy("rank").select(position).collect()], np.int64)
        np.random.default_rng(seed).shuffle(order)
        ordered = views.sparkSession.createDataFrame(list(zip(order.tolist(), range(n), strict=True)), f"{position} long, rank long")
    labels, rest = [], ordered.select(position, "rank")
    for name, count in (("tune", t), ("qc", q), ("recon", r)):
        again = numbered(rest, ["rank"], "place")
        chosen = pick_evenly(again, "place", count).select(position)
        labels.append(chosen.withColumn("split", F.lit(name)))
        rest = rest.join(chosen, position, "left_anti")
    return with_split(views, reduce(DataFrame.unionByName, labels), position)


def with_split(views: DataFrame, labels: DataFrame, position: str) -> DataFrame:
    """views with the label of their position; ``unused`` where there is none."""
    return views.join(labels.select(position, "split"), position, "left").withColumn("split", F.coalesce("split", F.lit("unused")))


def head_and_tail(df: DataFrame, position: str, edge: int = 5) -> DataFrame:
    """The first and the last rows by position; all of them if they are no more than twice as many."""
    first, last = df.orderBy(position).limit(edge), df.orderBy(F.desc(position)).limit(edge)
    return df.join(F.broadcast(first.unionByName(last).select(position).distinct()), position, "left_semi")


def first_offenders(df: DataFrame, bad: Column, position: str, most: int = 10) -> DataFrame:
    return df.where(bad).orderBy(position).limit(most)


def top(df: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(n)


def candidate_grid(start: float, end: float, step: float, most: int = 100_000) -> list[float]:
    """start to end by step in either direction, rounded to ten places; a last value that comes within a hair of the end is the end."""
    if not all(np.isfinite(v) for v in (start, end, step)) or step <= 0:
        raise ValueError("start, end and step must be finite, and the step positive")
    sign, hair = (1.0 if end >= start else -1.0), max(step * 1e-7, 1e-9)
    n = int(np.floor((abs(end - start) + hair) / step)) + 1
    if n > most:
        raise ValueError(f"more than {most} candidates")
    values = np.round(start + sign * step * np.arange(n), 10).tolist()
    if abs(values[-1] - end) <= hair:
        values[-1] = round(float(end), 10)
    return values


def fine_grid(best: float, step: float) -> list[float]:
    """Candidates around the best one of a coarse search: a fifth of its step, over two steps or one pixel at least."""
    reach = max(1.0, 2.0 * step)
    return candidate_grid(best - reach, best + reach, step / 5.0)


def stride(df: DataFrame, position: str, every: int, offset: int = 0) -> DataFrame:
    """Every n-th row by position, which is kept: an interleaved subset."""
    return df.where(F.col(position) % max(1, every) == offset)


def batches(df: DataFrame, position: str, size: int, out: str = "batch") -> DataFrame:
    """Contiguous batches of positions."""
    return df.withColumn(out, F.floor(F.col(position) / size))


def shards(df: DataFrame, position: str, n: int, out: str = "shard") -> DataFrame:
    """n contiguous shards whose sizes differ by one at most, the first ones larger: from the row count, so no task sees all rows."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    small, extra = F.floor(F.col("__n") / n), F.col("__n") % n
    edge = extra * (small + 1)
    p = F.col(position)
    shard = F.when(p < edge, F.floor(p / (small + 1))).otherwise(extra + F.floor((p - edge) / F.greatest(small, F.lit(1))))
    return df.crossJoin(F.broadcast(total)).withColumn(out, shard).drop("__n")


def recent(df: DataFrame, order: list[str], n: int = 300, keys: list[str] | None = None) -> DataFrame:
    """The last n rows (of each key)."""
    w = Window.partitionBy(*(keys or [])).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k") if keys else df.orderBy(*[F.desc(c) for c in order]).limit(n)


def pick_available(df: DataFrame, key: str, rank: str) -> DataFrame:
    """Of the rows of each key the one of least rank."""
    return df.groupBy(key).agg(F.min_by(F.struct("*"), rank).alias("r")).select("r.*")


def latest_request(df: DataFrame, request: str) -> DataFrame:
    """Only the result of the newest request."""
    return df.agg(F.max_by(F.struct("*"), request).alias("r")).where("r IS NOT NULL").select("r.*")
