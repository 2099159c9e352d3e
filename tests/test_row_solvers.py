"""Small volumes as rows: the same results as slices and rays as rows, and steps that shuffle nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_slice_solvers import VIEWS, problem, slices  # noqa: F401
from voxelmill.operators import row_solvers, slice_solvers


def rows_of(got, by):
    return {tuple(r[c] for c in by): r for r in got.collect()}


def same(one, other):
    for a, b, by in zip(one, other, (["volume_id", "z"], ["volume_id", "iteration"]), strict=True):
        a, b = rows_of(a, by), rows_of(b, by)
        assert set(a) == set(b)
        for key, r in a.items():
            for c in b[key].asDict():
                x, y = r[c], b[key][c]
                assert (x is None) == (y is None) and (x is None or np.allclose(x, y, rtol=1e-9, atol=1e-12)), (key, c)


@pytest.fixture
def odd(problem):  # noqa: F811
    """Pixels that are missing, a pixel that no ray has, a volume without projections."""
    _, truth, _, matrix, data, x0 = problem
    spark = data.sparkSession
    more = spark.createDataFrame([(7, 1, 99, 0.5, 0.5)], data.schema)
    return matrix, data.where("volume_id <> 9 AND NOT (volume_id = 11 AND pixel % 5 = 0)").unionByName(more), x0, slices(spark, truth)


def both(monkeypatch, solve):
    one = solve()
    monkeypatch.setattr(row_solvers, "MOST_VOXELS", 0)
    return one, solve()


@pytest.mark.parametrize("name", ["pdhg", "subset_tv", "anchored", "admm"])
def test_rows_and_slices_agree(monkeypatch, odd, name):
    matrix, data, x0, truth = odd
    prior = truth.select("volume_id", "z", F.transform("data", lambda v: v / 2).alias("prior"), F.transform("data", lambda _, k: (k % 5) / 4).alias("trust"))
    solve = {
        "pdhg": lambda: slice_solvers.pdhg(matrix, data, x0, 0.01, 2),
        "subset_tv": lambda: slice_solvers.subset_tv(matrix, data, x0, VIEWS, 0.01, 2, batch=1, subsets=2),
        "anchored": lambda: slice_solvers.anchored(matrix, data, x0, prior, VIEWS, sweeps=1, batch=1, subsets=2, weighted=True),
        "admm": lambda: slice_solvers.admm(matrix, data, x0, 0.01, 0.2, 2, cg_iterations=2),
    }[name]
    same(*both(monkeypatch, solve))


def test_what_fits_no_row(odd, monkeypatch):
    matrix, data, x0, _ = odd
    pack = lambda b=data, x=x0: row_solvers.pack(matrix, b, x, ["data"], True)
    assert pack().rows.count() == 3
    assert pack(x=x0.where("z <> 1")) is None
    assert pack(x=x0.unionByName(x0.where("z = 1"))) is None
    assert pack(x=x0.withColumn("data", F.transform("data", lambda v, k: F.when(k > 0, v)))) is None
    assert pack(b=data.unionByName(data.where("view_idx = 0"))) is None
    assert pack(b=data.withColumn("value", F.when(F.col("pixel") > 0, F.col("value")))) is None
    assert pack(x=x0.limit(0)) is None
    monkeypatch.setattr(row_solvers, "MOST_RAYS", 5)
    assert pack() is None


def test_a_step_of_small_volumes_shuffles_nothing(odd, monkeypatch):
    matrix, data, x0, _ = odd
    plans = []
    keep = row_solvers.written
    monkeypatch.setattr(row_solvers, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    slice_solvers.admm(matrix, data, x0, 0.01, 0.2, 2, cg_iterations=2)
    steps = [p for p in plans if "primal_residual" in p]
    assert len(steps) == 2 and not any("Aggregate" in p or "Repartition" in p or "Window" in p for p in steps)


def test_a_volume_s_row_is_copied_for_its_slices_only(spark, odd):
    x0 = odd[2]
    scalars = x0.select("volume_id").distinct().withColumn("s", F.col("volume_id") * 2)
    got = slice_solvers._with_scalars(x0, scalars)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["volume_id"], r["z"], r["s"]) for r in got.collect()} == {(k, z, 2 * k) for k in (7, 9, 11) for z in range(3)}
