"""Orders over whole tables without a task that sees all rows: row numbers, neighbours, order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.functions.scalars import finite
from voxelmill.session import checkpoint_folder

#: Rank error of the first bracket (a share of the rows), and equal bins that the second pass cuts it into; values of a key that are sorted as a list.
ACCURACY, BINS, LISTED = 100_000, 4096, 8192


def number_rows(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """df with its row number from 0 in the given order; equal rows keep the order in which they are read.

    Rows are dealt out by ranges of the order, sorted within each range and written to the shared folder; a row's number is its place in
    its range plus the rows of all ranges before. Only a count per range reaches the driver. Ties are broken by the place of reading, so a
    value that a third of the rows has is dealt out as well.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = df.withColumn("__read", F.monotonically_increasing_id())
    ranged = read.repartitionByRange(parts, *order, "__read").sortWithinPartitions(*order, "__read").drop("__read")
    checkpoint_folder(spark)
    # the upper bits of the id are the partition's number, the lower 33 the row's place in it
    kept = ranged.withColumn("__id", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright("__id", 33)
    before, rows = [], 0
    for number, n in sorted(kept.groupBy(part.alias("part")).count().collect()):  # a row per range
        before.append((number, rows))
        rows += n
    offsets = spark.createDataFrame(before, "__part long, __before long")
    placed = kept.join(F.broadcast(offsets), part == F.col("__part"))
    return placed.withColumn(out, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__before")


def with_previous(df: DataFrame, value: str, order: Sequence[Column | str], out: str) -> DataFrame:
    """df with the value of the row before in the order, null for the first."""
    numbered = number_rows(df, order, "__k")
    last = numbered.select((F.col("__k") + 1).alias("__k"), F.col(value).alias(out))
    return numbered.join(last, "__k", "left").drop("__k")


def _with_targets(x: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Every value next to the targets of its key; without keys they are two a probability, so they are broadcast."""
    return x.join(targets, keys) if keys else x.crossJoin(F.broadcast(targets))


def _kept(df: DataFrame) -> DataFrame:
    """df, a small table, in the shared folder: what comes after is planned without what came before, whose operators would share a task's memory."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _of_lists(x: DataFrame, probabilities: Sequence[float], keys: list[str]) -> DataFrame:
    """The quantiles of keys with few values, from a sorted list each."""
    lists = x.dropna(subset=keys).groupBy(*keys).agg(F.sort_array(F.collect_list("__x")).alias("l")).withColumn("n", F.size("l").cast("long"))

    def quantile(p: float) -> Column:
        k = F.lit(float(p)) * (F.col("n") - 1)
        a, b = [F.get("l", f(k).cast("int")) for f in (F.floor, F.ceil)]
        return F.when(a == b, a).otherwise((F.ceil(k) - k) * a + (k - F.floor(k)) * b)

    return lists.select(*keys, "n", F.array(*[quantile(p) for p in probabilities]).alias("q"))


def order_statistics(df: DataFrame, column: str, probabilities: Sequence[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, n, q): per key the number of finite values and their quantiles in the order of the probabilities, interpolated between neighbours.

    Exact, in memory that does not grow with the values. Where no key has more than LISTED, each key's are sorted as a list. Else pass one takes a bracket of each wanted rank from a sketch; pass two counts equal bins
    within it and what lies outside, and keeps the cell that holds the rank; pass three counts the values of that cell. A bracket
    that misses costs time only, as what lies outside are cells too. Keys without finite values give no row.
    """
    keys = keys or []
    x = df.select(*keys, F.col(column).cast("double").alias("__x")).where(finite(F.col("__x")))
    if keys and (x.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= LISTED:
        return _of_lists(x, probabilities, keys)
    low = F.percentile_approx("__x", [max(0.0, p - 5 / ACCURACY) for p in probabilities], ACCURACY)
    high = F.percentile_approx("__x", [min(1.0, p + 5 / ACCURACY) for p in probabilities], ACCURACY)
    sketch = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), low.alias("__low"), high.alias("__high")).where("__n > 0")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("k"), F.col("__low")[i].alias("lo"), F.col("__high")[i].alias("hi")) for i, p in enumerate(probabilities)])
    listed = sketch.select(*keys, "__n", F.explode(wanted).alias("t")).select(*keys, "__n", "t.*")
    targets = listed.select(*keys, "__n", "i", "k", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("k"), F.ceil("k")))).alias("r"))
    targets = _kept(targets) if keys else targets
    same = [*keys, "i", "r"]

    met = _with_targets(x, targets, keys)
    share = (F.col("__x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    cell = F.when(F.col("__x") < F.col("lo"), -1).when(F.col("__x") > F.col("hi"), BINS).when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
    cells = met.groupBy(*same, "__n", "k", cell.cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    found = cells.withColumn("__to", F.sum("c").over(Window.partitionBy(*same).orderBy("cell"))).where("r < __to AND r >= __to - c")
    found = _kept(found) if keys else found

    in_cell = _with_targets(x, found.select(*same, "__n", "k", "lo", "hi", (F.col("__to") - F.col("c")).alias("below")), keys).where("__x BETWEEN lo AND hi")
    values = in_cell.groupBy(*same, "__n", "k", "below", "__x").agg(F.count(F.lit(1)).alias("c"))
    chosen = values.withColumn("__to", F.col("below") + F.sum("c").over(Window.partitionBy(*same).orderBy("__x"))).where("r < __to AND r >= __to - c")
    pair = chosen.groupBy(*keys, "__n", "i", "k").agg(F.min_by("__x", "r").alias("a"), F.max_by("__x", "r").alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("k") - F.col("k")) * F.col("a") + (F.col("k") - F.floor("k")) * F.col("b"))
    q = F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"])
    return pair.groupBy(*keys).agg(F.max("__n").alias("n"), q.alias("q")).where("n IS NOT NULL")
