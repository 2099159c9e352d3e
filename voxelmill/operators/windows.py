"""Window operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_median(df: DataFrame, value: str, order: str, width: int, keys: list[str]) -> DataFrame:
    """df with ``median`` over an odd number of neighbours; at the ends the rows are mirrored, the end row included."""
    if width % 2 == 0 or width < 1:
        raise ValueError("the width must be odd")
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(-half, half)
    near = F.collect_list(F.col(value).cast("double")).over(frame)
    numbered = df.withColumns({"__near": near, "__k": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    # what a mirrored end repeats lies in the same frame: the rows next to the end
    low = F.greatest(half - F.col("__k"), F.lit(0)).cast("int")
    high = F.greatest(F.col("__k") + half - F.col("__n") + 1, F.lit(0)).cast("int")
    head, tail = F.slice("__near", F.lit(1), F.least(low, F.size("__near"))), F.slice("__near", F.greatest(F.size("__near") - high + 1, F.lit(1)), F.least(high, F.size("__near")))
    full = F.array_sort(F.concat("__near", head, tail))
    n = F.size(full)
    middle = (F.get(full, F.floor((n - 1) / 2).cast("int")) + F.get(full, F.floor(n / 2).cast("int"))) / 2
    return numbered.withColumn("median", middle).drop("__near", "__k", "__n")
