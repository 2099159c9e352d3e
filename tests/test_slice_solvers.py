"""The table solvers against the solvers on arrays, volume by volume."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import geometry
from voxelmill.functions.geometry import Geometry
from voxelmill.operators import kernels, slice_solvers, solvers

G = Geometry(200.0, 100.0, (4, 6), (2.0, 2.0), (3, 4, 5), (1.0, 1.0, 1.0), invert_angles=False)
VIEWS, SHAPE = 4, (3, 4, 5)


class Dense:
    """The relation as one array per view."""

    def __init__(self):
        self.a = np.zeros((VIEWS, 24, 60))
        for v in range(VIEWS):
            pixel, voxel, w = geometry.ray_weights(G, v * np.pi / VIEWS)
            np.add.at(self.a[v], (np.asarray(pixel, int), np.asarray(voxel, int)), w)

    def forward(self, x, views=None):
        return (self.a if views is None else self.a[views]) @ x.reshape(-1)

    def backproject(self, y, views=None):
        return np.einsum("vpk,vp->k", self.a if views is None else self.a[views], y).reshape(SHAPE)


@pytest.fixture(scope="module")
def problem(spark):
    op, rng = Dense(), np.random.default_rng(3)
    truth = {7: rng.uniform(0, 1, SHAPE), 9: np.zeros(SHAPE), 11: np.pad(np.ones((1, 2, 2)), ((1, 1), (1, 1), (1, 2)))}
    b = {k: op.forward(v) for k, v in truth.items()}
    v, p, k = np.nonzero(op.a)
    matrix = spark.createDataFrame([(int(i), int(j), int(m), float(op.a[i, j, m])) for i, j, m in zip(v, p, k, strict=True)], "view_idx long, pixel long, voxel long, w double").cache()
    rows = [(key, i, j, float(y[i, j]), 0.5 + 0.1 * i) for key, y in b.items() for i in range(VIEWS) for j in range(24)]
    data = spark.createDataFrame(rows, "volume_id long, view_idx long, pixel long, value double, weight double").cache()
    return op, truth, b, matrix, data, slices(spark, {k: np.zeros(SHAPE) for k in truth})


def slices(spark, cubes):
    rows = [(k, z, 4, 5, s.reshape(-1).tolist()) for k, v in cubes.items() for z, s in enumerate(v)]
    return spark.createDataFrame(rows, "volume_id long, z int, ny int, nx int, data array<double>").cache()


def check(got, want, fields=("objective", "data_fidelity", "tv_term", "relative_x_change")):
    """want: Solved of each volume."""
    x, metrics = got
    cubes = {}
    for r in x.collect():
        cubes.setdefault(r["volume_id"], np.zeros(SHAPE))[r["z"]] = np.reshape(r["data"], SHAPE[1:])
    rows = {(r["volume_id"], r["iteration"]): r for r in metrics.collect()}
    assert set(cubes) == set(want) and set(rows) == {(k, r.iteration) for k, s in want.items() for r in s.rows}
    for k, s in want.items():
        assert np.allclose(cubes[k], s.x, atol=1e-9)
        for r in s.rows:
            for f in fields:
                assert np.isclose(rows[k, r.iteration][f], getattr(r, f), rtol=1e-7, atol=1e-9), (k, r.iteration, f)


def test_pdhg(problem):
    op, truth, b, matrix, data, x0 = problem
    size = np.sqrt(solvers.power_iteration(lambda v: op.backproject(op.forward(v)) + kernels.grad3_adjoint(kernels.grad3(v)), SHAPE, 3, 17))
    want = {k: solvers.pdhg(op, y, np.zeros(SHAPE), 0.01, 3) for k, y in b.items()}
    assert len(want[9].rows) == 2  # it has nothing to do and leaves
    check(slice_solvers.pdhg(matrix, data, x0, 0.01, 3, step=0.95 / size), want)


def test_pdhg_without_a_penalty_and_bounds(problem):
    op, truth, b, matrix, data, x0 = problem
    largest = np.linalg.norm(op.a.reshape(-1, 60), 2) ** 2
    assert largest <= slice_solvers.norm_bound(matrix) * (1 + 1e-9)
    assert 0.97 * largest <= slice_solvers.power_norm(matrix, 6) <= largest * (1 + 1e-9)
    got = slice_solvers.pdhg(matrix, data.where("volume_id = 7"), x0.where("volume_id = 7"), 0.0, 2)
    objective = {(r["volume_id"], r["iteration"]): r["objective"] for r in got[1].collect()}
    assert objective[7, 2] < objective[7, 1]


def test_subsets(problem):
    op, truth, b, matrix, data, x0 = problem
    bend = solvers.power_iteration(lambda v: op.backproject(op.forward(v)), SHAPE, 2, 23)
    want = {k: solvers.subset_tv(op, y, np.zeros(SHAPE), 0.01, 2, batch=1, subsets=2) for k, y in b.items()}
    check(slice_solvers.subset_tv(matrix, data, x0, VIEWS, 0.01, 2, batch=1, subsets=2, step=0.7 / bend), want)


def test_anchored(spark, problem):
    op, truth, b, matrix, data, x0 = problem
    w = 0.5 + 0.1 * np.arange(VIEWS)
    rng = np.random.default_rng(4)
    prior, trust = {k: rng.uniform(0, 1, SHAPE) for k in b}, {k: rng.uniform(0, 1, SHAPE) for k in b}
    bend = solvers.power_iteration(lambda v: op.backproject(op.forward(v)), SHAPE, 2, 23) * float(np.square(w).max())
    want = {k: solvers.anchored(op, y, np.zeros(SHAPE), prior[k], trust[k], sweeps=2, batch=1, subsets=2, weights=w) for k, y in b.items()}
    known = slices(spark, prior).withColumnRenamed("data", "prior").join(slices(spark, trust).select("volume_id", "z", F.col("data").alias("trust")), ["volume_id", "z"])
    steps = {k: 0.5 / (bend + 0.05 * float(trust[k].max())) for k in b}
    one = slice_solvers.anchored(matrix, data.where("volume_id = 7"), x0.where("volume_id = 7"), known, VIEWS, sweeps=2, batch=1, subsets=2, step=steps[7], weighted=True)
    check(one, {7: want[7]}, ("objective", "data_fidelity", "tv_term", "relative_x_change", "prior_term"))


def test_admm(problem):
    op, truth, b, matrix, data, x0 = problem
    want = {k: solvers.admm(op, y, np.zeros(SHAPE), 0.01, 0.2, 2, cg_iterations=3) for k, y in b.items()}
    assert len(want[9].rows) == 1
    check(slice_solvers.admm(matrix, data, x0, 0.01, 0.2, 2, cg_iterations=3), want, ("objective", "data_fidelity", "tv_term", "relative_x_change", "primal_residual", "dual_residual", "cg_residual", "cg_iterations"))
    for lam, rho in ((-1, 1), (1, 0)):
        with pytest.raises(ValueError):
            slice_solvers.admm(matrix, data, x0, lam, rho, 1)


def test_empty_and_missing(problem):
    op, truth, b, matrix, data, x0 = problem
    x, rows = slice_solvers.pdhg(matrix, data.limit(0), x0.limit(0), 0.01, 2)
    assert x.count() == 0 and rows.count() == 0
    x, rows = slice_solvers.subset_tv(matrix, data.where("volume_id <> 11"), x0, VIEWS, 0.0, 1, step=0.01)
    got = {r["volume_id"]: r for r in rows.collect()}
    assert got[11]["data_fidelity"] == 0.0 and got[11]["relative_x_change"] == 0.0 and got[7]["relative_x_change"] > 0
