"""Table functions for SQL: grids, batches and shards of each row of a table of settings, by a lateral join.

``register(spark)`` names them candidate_grid(start, end, step), fine_grid(best, step), batch_list(n, size) and shard_list(n, shards). A null
argument gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from voxelmill.operators import select


@udtf(returnType="place int, value double")
class CandidateGrid:
    """The values from start to end by step, in either direction."""

    def eval(self, start: float, end: float, step: float) -> Iterator[tuple[int, float]]:
        if None not in (start, end, step):
            yield from enumerate(select.candidate_grid(start, end, step))


@udtf(returnType="place int, value double")
class FineGrid:
    """Candidates around the best one of a coarse search."""

    def eval(self, best: float, step: float) -> Iterator[tuple[int, float]]:
        if None not in (best, step):
            yield from enumerate(select.fine_grid(best, step))


@udtf(returnType="batch int, first long, last long")
class BatchList:
    """Contiguous batches of at most ``size`` of n places, ends included."""

    def eval(self, n: int, size: int) -> Iterator[tuple[int, int, int]]:
        if None not in (n, size):
            for batch, first in enumerate(range(0, n, max(1, size))):
                yield batch, first, min(n, first + max(1, size)) - 1


@udtf(returnType="shard int, first long, last long")
class ShardList:
    """Contiguous shards whose sizes differ by one at most, the first ones larger; no more of them than places."""

    def eval(self, n: int, shards: int) -> Iterator[tuple[int, int, int]]:
        if None not in (n, shards) and n > 0:
            small, extra = divmod(n, max(1, min(shards, n)))
            first = 0
            for shard in range(max(1, min(shards, n))):
                last = first + small + (shard < extra)
                yield shard, first, last - 1
                first = last


def register(spark: SparkSession) -> None:
    for name, function in (("candidate_grid", CandidateGrid), ("fine_grid", FineGrid), ("batch_list", BatchList), ("shard_list", ShardList)):
        spark.udtf.register(name, function)
