"""Sorts, sums and windows share a task's memory when they follow one another on the same key: steps have few of them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import masks, ordering, quality, volumes


def operators(df) -> int:
    """Aggregates, joins, windows and sorts that are planned together."""
    return len(re.findall(r"\b(?:Aggregate|Join|Window|Sort) ", df._jdf.queryExecution().optimizedPlan().toString()))


@pytest.fixture(scope="module")
def cubes(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(v, z, 4, 5, rng.normal(size=20).tolist()) for v in range(3) for z in range(3)], "volume_id long, z int, ny int, nx int, data array<double>").cache()


def quantiles(df, ps):
    return {r["g"]: (r["n"], r["q"]) for r in ordering.order_statistics(df, "v", ps, ["g"]).collect()}


def test_lists_and_ranges_give_the_same_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    values = [(g, float(v)) for g, n in ((1, 1), (2, 2), (3, 57), (4, 400)) for v in rng.integers(0, 90, n) / 7]
    df = spark.createDataFrame([*values, (3, float("nan")), (4, None), (5, None), (6, float("inf")), (None, 1.0)], "g int, v double")
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    one = quantiles(df, ps)
    assert set(one) == {1, 2, 3, 4} and one[3][0] == 57
    assert np.allclose(one[4][1], np.quantile([v for g, v in values if g == 4], ps))
    monkeypatch.setattr(ordering, "LISTED", 0)
    assert quantiles(df, ps) == one


def test_denoise_quality_is_planned_in_pieces(cubes, monkeypatch):
    solve = lambda: quality.denoise_quality(cubes, volumes.gaussian(cubes, 3, 0.6))
    got = solve()
    assert operators(got) <= 10
    one = {r["volume_id"]: r.asDict() for r in got.collect()}
    monkeypatch.setattr(ordering, "LISTED", 0)
    assert {r["volume_id"]: r.asDict() for r in solve().collect()} == one and len(one) == 3


def test_support_is_planned_in_pieces(cubes, monkeypatch):
    solve = lambda: masks.support(cubes, 3, 0.6, 1, slab=2)
    got = solve()
    assert operators(got) <= 10
    one = {(r["volume_id"], r["z"]): list(r["bits"]) for r in got.select("volume_id", "z", "bits").collect()}
    monkeypatch.setattr(ordering, "LISTED", 0)
    assert {(r["volume_id"], r["z"]): list(r["bits"]) for r in solve().collect()} == one and len(one) == 9
