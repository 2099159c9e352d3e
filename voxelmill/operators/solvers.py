"""Iterative solvers: a driver loop over an operator with ``forward`` and ``backproject``, and metric rows of each iteration.

Volumes are NumPy arrays on the driver; what is heavy, the projections, is the operator's and runs on Spark (see ``linear``).
``conjugate_gradient_tables`` is the same method with the vectors as tables, for unknowns that no driver holds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators import kernels
from voxelmill.operators.linear import subset_scale

NAN = float("nan")


@dataclass
class Iteration:
    solver: str
    iteration: int
    objective: float
    data_fidelity: float
    tv_term: float
    primal_residual: float = NAN
    dual_residual: float = NAN
    relative_x_change: float = NAN
    cg_residual: float = NAN
    cg_iterations: int = 0
    elapsed_s: float = 0.0
    prior_term: float = NAN
    qc_residual: float = NAN


@dataclass
class Solved:
    x: np.ndarray
    rows: list[Iteration]
    converged: bool

    def table(self, spark: SparkSession, run_id: str = "run") -> DataFrame:
        schema = "run_id string, solver string, iteration int, objective double, data_fidelity double, tv_term double, primal_residual double, dual_residual double, relative_x_change double, cg_residual double, cg_iterations int, elapsed_s double, prior_term double, qc_residual double"
        return spark.createDataFrame([(run_id, *asdict(r).values()) for r in self.rows], schema)


Watch = Callable[[Iteration, np.ndarray], Any] | None


def _change(new: np.ndarray, old: np.ndarray) -> float:
    return float(np.linalg.norm(new - old) / max(np.linalg.norm(old), 1e-12))


def conjugate_gradient(matvec: Callable[[np.ndarray], np.ndarray], b: np.ndarray, x: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, float, int]:
    """x, the last relative residual and the iterations done."""
    x, r = x.astype(np.float64).copy(), b - matvec(x)
    p, size = r.copy(), max(float(np.linalg.norm(b)), 1e-30)
    square = float(np.vdot(r, r))
    done = 0
    while np.sqrt(square) / size > tolerance and done < iterations:
        ap = matvec(p)
        curve = float(np.vdot(p, ap))
        if abs(curve) <= 1e-30:
            break
        alpha, done = square / curve, done + 1
        x += alpha * p
        r -= alpha * ap
        new = float(np.vdot(r, r))
        p = r + new / max(square, 1e-30) * p
        square = new
    return x, float(np.sqrt(square) / size), done


def admm(op, b: np.ndarray, x0: np.ndarray, lam: float, rho: float, iterations: int, cg_iterations: int = 10, cg_tolerance: float = 1e-4, tolerances: tuple[float, float, float] = (1e-4, 1e-4, 1e-5), epsilon: float = 1e-8, positivity: bool = True, watch: Watch = None, subsets: Callable[[int], np.ndarray] | None = None) -> Solved:
    """min |Ax - b|^2 / 2 + lam TV(x), x >= 0, by the alternating direction method; subsets: the views that an iteration sees."""
    if rho <= 0 or lam < 0:
        raise ValueError("rho must be positive and lam not negative")
    nonneg = (lambda v: np.maximum(v, 0)) if positivity else (lambda v: v)
    began, x = time.monotonic(), nonneg(x0.astype(np.float64))
    d = u = np.zeros((3, *x.shape))
    n, rows, full = len(b), [], op.backproject(b)
    for k in range(1, iterations + 1):
        views = None if subsets is None else subsets(k)
        if views is None:
            rhs, data = full, lambda v: op.backproject(op.forward(v))
        else:
            s = n / max(1, len(views))
            rhs, data = s * op.backproject(b[views], views), lambda v, w=views, s=s: s * op.backproject(op.forward(v, w), w)
        old, old_d = x, d
        x, left, used = conjugate_gradient(lambda v: data(v) + rho * kernels.grad3_adjoint(kernels.grad3(v)), rhs + rho * kernels.grad3_adjoint(d - u), x, cg_iterations, cg_tolerance)
        x = nonneg(x)
        g = kernels.grad3(x)
        z = g + u
        d = np.maximum(1 - lam / rho / np.maximum(np.sqrt((z * z).sum(axis=0)), 1e-12), 0) * z
        u = u + g - d
        fit = 0.5 * float(((op.forward(x) - b) ** 2).sum())
        tv = lam * kernels.tv_norm(x, epsilon)
        row = Iteration("admm", k, fit + tv, fit, tv, float(np.linalg.norm(g - d)), rho * float(np.linalg.norm(kernels.grad3_adjoint(d - old_d))), _change(x, old), left, used, time.monotonic() - began)
        rows.append(row)
        if watch:
            watch(row, x)
        if row.primal_residual <= tolerances[0] and row.dual_residual <= tolerances[1] and row.relative_x_change <= tolerances[2]:
            return Solved(x, rows, True)
    return Solved(x, rows, False)


def power_iteration(matvec: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], iterations: int, seed: int) -> float:
    """The largest eigenvalue, about."""
    v = np.random.default_rng(seed).normal(size=shape)
    v /= max(np.linalg.norm(v), 1e-30)
    value = 0.0
    for _ in range(max(1, iterations)):
        w = matvec(v)
        value = float(np.linalg.norm(w))
        v = w / max(value, 1e-30)
    return value


def pdhg(op, b: np.ndarray, x0: np.ndarray, lam: float, iterations: int, power: int = 3, safety: float = 0.95, theta: float = 1.0, tolerance: float = 1e-5, epsilon: float = 1e-8, positivity: bool = True, watch: Watch = None) -> Solved:
    """The same problem by the primal-dual hybrid gradient method; residuals of the other methods are NaN."""
    began = time.monotonic()
    nonneg = (lambda v: np.maximum(v, 0)) if positivity else (lambda v: v)
    size = np.sqrt(power_iteration(lambda v: op.backproject(op.forward(v)) + kernels.grad3_adjoint(kernels.grad3(v)), x0.shape, power, 17))
    step = safety / max(size, 1e-12)
    x = nonneg(x0.astype(np.float64))
    ahead, y, p, rows = x, np.zeros(b.shape), np.zeros((3, *x.shape)), []
    for k in range(1, iterations + 1):
        y = (y + step * (op.forward(ahead) - b)) / (1 + step)
        if lam > 0:
            p = p + step * kernels.grad3(ahead)
            p /= np.maximum(1, np.sqrt((p * p).sum(axis=0)) / lam)
        else:
            p = np.zeros_like(p)
        new = nonneg(x - step * (op.backproject(y) + kernels.grad3_adjoint(p)))
        ahead, change = new + theta * (new - x), _change(new, x)
        x = new
        fit = 0.5 * float(((op.forward(x) - b) ** 2).sum())
        tv = lam * kernels.tv_norm(x, epsilon)
        row = Iteration("pdhg", k, fit + tv, fit, tv, NAN, NAN, change, NAN, 0, time.monotonic() - began)
        rows.append(row)
        if watch:
            watch(row, x)
        if k > 1 and change <= tolerance:
            return Solved(x, rows, True)
    return Solved(x, rows, False)


def view_batches(n: int, size: int, subsets: int = 1, subset: int | None = None) -> Iterator[np.ndarray]:
    """Batches of a strided subset (or of each subset in turn)."""
    for s in range(subsets) if subset is None else [subset]:
        views = np.arange(s, n, max(1, subsets))
        for a in range(0, len(views), max(1, size)):
            yield views[a : a + size]


def subset_tv(op, b: np.ndarray, x0: np.ndarray, lam: float, iterations: int, batch: int = 64, subsets: int = 1, power: int = 2, safety: float = 0.7, tolerance: float = 1e-5, epsilon: float = 1e-4, positivity: bool = True, watch: Watch = None, weights: np.ndarray | None = None, prior: np.ndarray | None = None, trust: np.ndarray | None = None, rho: float = 0.0, qc: Callable[[np.ndarray], float] | None = None, name: str = "subset_tv", all_subsets: bool = False) -> Solved:
    """Streaming ordered-subset descent on the smoothed problem: batches of views one after the other, each from the last one's x.

    With a prior: + rho/2 |sqrt(trust) (x - prior)|^2; with weights, residuals count by their squares.
    """
    began, n = time.monotonic(), len(b)
    nonneg = (lambda v: np.maximum(v, 0)) if positivity else (lambda v: v)
    bend = power_iteration(lambda v: op.backproject(op.forward(v)), x0.shape, power, 23)
    w2 = None if weights is None else (weights.astype(np.float64) ** 2).reshape(-1, *[1] * (b.ndim - 1)) if weights.ndim == 1 else weights.astype(np.float64) ** 2
    if w2 is not None:
        bend *= max(float(w2.max()), 1e-6)
    if prior is not None:
        bend += rho * float(trust.max())
    tau, x, rows = safety / max(bend, 1e-12), nonneg(x0.astype(np.float64)), []
    for k in range(1, iterations + 1):
        start, moved = x, 0.0
        used = list(view_batches(n, batch, subsets)) if all_subsets else list(view_batches(n, batch, subsets, (k - 1) % max(1, subsets)))
        for views in used:
            residual = op.forward(x, views) - b[views]
            if w2 is not None:
                residual = residual * w2[views]
            subset = sum(len(v) for v in used) if not all_subsets else len(range(int(views[0]) % max(1, subsets), n, max(1, subsets)))
            g = subset_scale(n, subset, len(views)) * op.backproject(residual, views) + lam * kernels.tv_gradient(x, epsilon)
            if prior is not None:
                g = g + rho * trust * (x - prior)
            moved += (tau / len(used)) ** 2 * float((g * g).sum())
            x = nonneg(x - tau / len(used) * g)
        change = float(np.sqrt(moved) / max(np.linalg.norm(start), 1e-12))
        diff = op.forward(x) - b
        fit = 0.5 * float((diff * diff if w2 is None else w2 * diff * diff).sum())
        tv = lam * kernels.tv_norm(x, epsilon)
        pull = NAN if prior is None else 0.5 * rho * float((trust * (x - prior) ** 2).sum())
        row = Iteration(name, k, fit + tv + (0.0 if prior is None else pull), fit, tv, NAN, NAN, change, NAN, 0, time.monotonic() - began, pull, NAN if qc is None else qc(x))
        rows.append(row)
        if watch:
            watch(row, x)
        if k > 1 and change <= tolerance:
            return Solved(x, rows, True)
    return Solved(x, rows, False)


def anchored(op, b: np.ndarray, x0: np.ndarray, prior: np.ndarray, trust: np.ndarray, lam: float = 1e-4, rho: float = 0.05, sweeps: int = 5, batch: int = 32, subsets: int = 8, power: int = 2, safety: float = 0.5, epsilon: float = 1e-4, tolerance: float = 1e-5, weights: np.ndarray | None = None, positivity: bool = True, watch: Watch = None, qc: Callable[[np.ndarray], float] | None = None) -> Solved:
    """Sweeps over all subsets with a pull towards a prior volume where it is trusted."""
    for name, v in (("prior", prior), ("trust", trust)):
        if v.shape != x0.shape:
            raise ValueError(f"{name} has shape {v.shape}, the volume {x0.shape}")
    return subset_tv(op, b, x0, lam, sweeps, batch, max(1, min(subsets, len(b))), power, safety, tolerance, epsilon, positivity, watch, weights, prior, trust, rho, qc, "anchored", all_subsets=True)


def residual_of(op, b: np.ndarray, views: np.ndarray, weights: np.ndarray | None = None) -> Callable[[np.ndarray], float]:
    """Normalised weighted residual of held-out views, as a function of the volume; NaN without views."""

    def run(x: np.ndarray) -> float:
        if not len(views):
            return NAN
        w = 1.0 if weights is None else weights[views].reshape(-1, *[1] * (b.ndim - 1))
        return float(((w * (op.forward(x, views) - b[views])) ** 2).sum() / max(float(((w * b[views]) ** 2).sum()), 1e-12))

    return run


def _saved_iterations(spark: SparkSession, folder: str) -> list[int]:
    """Iterations whose state was written to the end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/iteration_*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().rpartition("_")[2]) for f in found)


def conjugate_gradient_tables(matrix: DataFrame, b: DataFrame, iterations: int, tolerance: float, cut: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None) -> tuple[DataFrame, float, int]:
    """Solve M x = b for a symmetric M as a table (i, j, w) and b (i, value), from x = 0; vectors are tables, only norms reach the driver.

    cut: how lineage is cut after each iteration; a checkpoint if none is given. folder: each iteration's state is written there instead, and
    a call with the same folder goes on from the last one that was written to the end; only the newest two stay.
    """
    spark = b.sparkSession
    saved = _saved_iterations(spark, folder) if folder else []
    cut = cut or (lambda df: df.checkpoint())
    total = lambda df, e: df.agg(F.sum(e)).first()[0] or 0.0
    r = p = cut(b.select("i", F.col("value").cast("double").alias("value")))
    x = r.select("i", F.lit(0.0).alias("value"))
    square = total(r, F.col("value") * F.col("value"))
    size, done = max(square**0.5, 1e-30), 0
    if saved:
        done = saved[-1]
        state = spark.read.parquet(f"{folder}/iteration_{done:06d}")
        x, r, p = [state.select("i", F.col(c).alias("value")) for c in ("x", "r", "p")]
        square = state.agg(F.max("square")).first()[0]
    while square**0.5 / size > tolerance and done < iterations:
        ap = matrix.join(p.select(F.col("i").alias("j"), "value"), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("value")).alias("q"))
        pq = cut(p.join(ap, "i", "left").select("i", "value", F.coalesce("q", F.lit(0.0)).alias("q")))
        curve = total(pq, F.col("value") * F.col("q"))
        if abs(curve) <= 1e-30:
            break
        alpha, done = square / curve, done + 1
        state = x.withColumnRenamed("value", "x").join(r.withColumnRenamed("value", "r"), "i").join(pq.withColumnRenamed("value", "p"), "i")
        state = cut(state.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p"))
        new = total(state, F.col("r") * F.col("r"))
        state = state.select("i", "x", "r", (F.col("r") + new / max(square, 1e-30) * F.col("p")).alias("p"))
        square = new
        if folder:
            state.withColumn("square", F.lit(square)).write.mode("overwrite").parquet(f"{folder}/iteration_{done:06d}")
            state = spark.read.parquet(f"{folder}/iteration_{done:06d}")
            for old in _saved_iterations(spark, folder)[:-2]:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/iteration_{old:06d}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        x, r, p = [state.select("i", F.col(c).alias("value")) for c in ("x", "r", "p")]
    return x, square**0.5 / size, done
