"""Join-like operators: look-ups with a fallback, positional joins, merges with precedence, nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.functions.scalars import safe_key
from voxelmill.operators.ordering import number_rows


def resolve_files(views: DataFrame, files: DataFrame, name: str = "filename") -> DataFrame:
    """views with ``path`` and ``exists``: the file of that name, else that of its last part, else the name as it is.

    files: (path), relative to the folder. A folder's list is an equi-join on either key, whatever its size.
    """
    known = files.select(F.col("path").alias("__path")).distinct()
    direct = views.withColumn("__name", F.trim(name)).withColumn("__base", F.element_at(F.split("__name", "/"), -1))
    first = direct.join(known.withColumnRenamed("__path", "__a"), F.col("__name") == F.col("__a"), "left")
    second = first.join(known.withColumnRenamed("__path", "__b"), F.col("__a").isNull() & (F.col("__base") == F.col("__b")), "left")
    found = F.coalesce("__a", "__b")
    return second.withColumns({"path": F.coalesce(found, "__name"), "exists": found.isNotNull()}).drop("__name", "__base", "__a", "__b")


def missing(views: DataFrame, files: DataFrame, on: str) -> DataFrame:
    return views.join(files, on, "left_anti")


def positional(left: DataFrame, right: DataFrame, left_order: str, right_order: str, dropped_endpoint: bool = False, reverse: bool = False) -> DataFrame:
    """Rows joined by their place in either order; counts must agree, but for one row more on the right if an endpoint was dropped on the left.

    reverse: the right side runs backwards. Both sides are numbered by ranges of their order.
    """
    n, m = left.count(), right.count()
    if dropped_endpoint and m == n + 1:
        m -= 1
    elif m != n:
        raise ValueError(f"{m} rows do not match {n}")
    a = number_rows(left, [left_order], "__k")
    b = number_rows(right, [right_order], "__k").where(F.col("__k") < m).drop(right_order)
    b = b.withColumn("__k", F.lit(m - 1) - F.col("__k")) if reverse else b
    return a.join(b, "__k").drop("__k")


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_anti")


def nearest(df: DataFrame, value: str, target: Column, position: str, keys: list[str] | None = None) -> DataFrame:
    """The row (per key) whose value is nearest to target; the first position wins a tie."""
    return df.groupBy(*(keys or [])).agg(F.min_by(F.struct(*[c for c in df.columns if c not in (keys or [])]), F.struct(F.abs(F.col(value) - target), F.col(position))).alias("r")).select(*(keys or []), "r.*")


def merge_sources(sources: DataFrame, display_order: list[str] | None = None) -> DataFrame:
    """sources (id, rank, context, signature) merged by id: the highest rank keeps the id, other signatures stay under ``id@context``.

    Equal signatures of an id are one source; a second alias of the same name gets ``#2`` and so on; ids in display_order come first.
    """
    one = sources.groupBy("id", "signature").agg(F.max_by(F.struct("context", "rank"), "rank").alias("r")).select("id", "signature", "r.*")
    by_rank = Window.partitionBy("id").orderBy(F.desc("rank"))
    placed = one.withColumn("__place", F.row_number().over(by_rank))
    base = F.when(F.col("__place") == 1, F.col("id")).otherwise(F.concat_ws("@", "id", safe_key(F.col("context"))))
    named = placed.withColumn("__base", base).withColumn("__n", F.row_number().over(Window.partitionBy("__base").orderBy("__place", "signature")))
    out = named.withColumn("source_id", F.when(F.col("__n") > 1, F.concat_ws("#", "__base", F.col("__n").cast("string"))).otherwise(F.col("__base")))
    spot = F.array_position(F.array(*[F.lit(x) for x in display_order]), F.col("source_id")) if display_order else F.lit(0)
    return out.withColumn("display", F.when(spot > 0, spot).otherwise(F.lit(1 << 30))).select("source_id", "id", "context", "signature", "rank", "display").orderBy("display", "rank", "source_id")
