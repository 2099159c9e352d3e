"""Iterative solvers whose volumes and projections stay tables: ADMM, PDHG, ordered subsets and anchored descent for many volumes at once.

Volumes are one row per slice (volume_id, z, ny, nx, data), projections one row per pixel (volume_id, view_idx, pixel, value), the projector is
a relation (view_idx, pixel, voxel, w) that all volumes share, with voxels counted through the slices. The driver holds the loop and the
step; what depends on a volume (norms, CG's steps) is a row per volume. Neighbouring slices meet by a join on (volume_id, z), so one large
volume is spread over all tasks. Small volumes on a small relation are rows of their own instead (``row_solvers``). Each volume leaves the loop when its change is small enough, and the work shrinks with it.

Every solver returns the slices and a table of metrics (volume_id, iteration, objective, data_fidelity, tv_term, primal_residual,
dual_residual, relative_x_change, cg_residual, cg_iterations, prior_term); what a solver has no use for is null. State is
written to the shared folder after each step, so a lost executor costs a step at most; the metrics read it, so it stays there. A volume without projections keeps its start;
a pixel that no ray of the relation names only adds to the fidelity; a null voxel or pixel makes its volume's metrics null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.operators import linear, volumes
from voxelmill.operators.solvers import view_batches
from voxelmill.session import checkpoint_folder

VOLUME, RAY = ["volume_id"], ["volume_id", "view_idx", "pixel"]
METRICS = ["objective", "data_fidelity", "tv_term", "primal_residual", "dual_residual", "relative_x_change", "cg_residual", "cg_iterations", "prior_term"]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. Unlike a checkpoint it is read by column, and hands on no constraints, which pile up in a loop."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/slices-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _plus(a: str | Column, b: str | Column, scale: Column | float = 1.0) -> Column:
    """a + scale * b, element by element."""
    return F.zip_with(a, b, lambda x, y: x + scale * y)


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _clip(data: str | Column, positivity: bool) -> Column:
    return F.transform(data, lambda v: F.greatest(v, F.lit(0.0))) if positivity else F.transform(data, lambda v: v)


def _zeros() -> Column:
    return F.transform("data", lambda _: F.lit(0.0))


def _neighbour(df: DataFrame, column: str, step: int, name: str) -> DataFrame:
    """df with a column of the slice ``step`` further as name, null where there is none."""
    other = df.select("volume_id", (F.col("z") - step).alias("z"), F.col(column).alias(name))
    return df.join(other, ["volume_id", "z"], "left")


def gradient(df: DataFrame, column: str = "data") -> DataFrame:
    """df with gx, gy, gz of a column, as ``volumes.gradient``."""
    own = df.withColumn("__kept", F.col("data")).withColumn("data", F.col(column))
    return volumes.differences(_neighbour(own, "data", 1, "__next")).withColumn("data", F.col("__kept")).drop("__kept")


def adjoint(df: DataFrame, out: str) -> DataFrame:
    """The gradient's adjoint of (gx, gy, gz); gz is 0 in the last slice, as every field here."""
    return volumes.inflow(_neighbour(df, "gz", -1, "__before").withColumn("__last", F.lit(False)), out)


def _tv_gradient(df: DataFrame, epsilon: float) -> DataFrame:
    with_size = gradient(df).withColumn("__m", volumes.magnitude(epsilon))
    unit = with_size.withColumns({g: F.zip_with(g, "__m", lambda a, m: a / m) for g in ("gx", "gy", "gz")}).drop("__m")
    return adjoint(unit, "tv").drop("gx", "gy", "gz")


def _tv(df: DataFrame, epsilon: float) -> DataFrame:
    """(volume_id, tv); partial sums per slice before the shuffle."""
    return gradient(df).groupBy("volume_id").agg(F.sum(F.aggregate(volumes.magnitude(epsilon), F.lit(0.0), lambda a, x: a + x)).alias("tv"))


def _with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """df, a written table, with the columns of its volume's one row; that is copied for each slice there is, so a large volume is no hot key."""
    copies = df.select("volume_id", "z").join(scalars, "volume_id")
    return df.join(copies, ["volume_id", "z"])


def project(matrix: DataFrame, df: DataFrame, column: str = "data") -> DataFrame:
    """(volume_id, view_idx, pixel, value): projections of a column of the slices."""
    voxels = df.select("volume_id", (F.col("z") * F.col("ny") * F.col("nx")).alias("base"), F.posexplode(column).alias("k", "value"))
    return linear.forward(matrix, voxels.select("volume_id", (F.col("base") + F.col("k")).cast("long").alias("voxel"), "value"), VOLUME)


def backprojected(matrix: DataFrame, y: DataFrame, df: DataFrame, out: str, like: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """df with the backprojection of y as a column; 0 where no ray passes. like: a written table with the slices of df, so that df is planned once."""
    size = F.col("ny") * F.col("nx")
    shape = (df if like is None else like).select("volume_id", "z", "ny", "nx")
    sums = linear.backproject(matrix, y, None, scale, VOLUME)
    grid = shape.select("volume_id", "z", F.explode(F.sequence(F.lit(0), size - 1)).alias("k"), (F.col("z") * size).alias("base"))
    each = grid.select("volume_id", "z", "k", (F.col("base") + F.col("k")).cast("long").alias("voxel")).join(sums, ["volume_id", "voxel"], "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("value", F.lit(0.0)).alias("v")))), lambda s: s["v"])
    return df.join(each.groupBy("volume_id", "z").agg(ordered.alias(out)), ["volume_id", "z"])


def norm_bound(matrix: DataFrame) -> float:
    """An upper bound of the projector's squared norm: its largest row sum times its largest column sum (Schur's test)."""
    rows = matrix.groupBy("view_idx", "pixel").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0]
    cols = matrix.groupBy("voxel").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0]
    return float((rows or 0.0) * (cols or 0.0))


def power_norm(matrix: DataFrame, iterations: int = 10) -> float:
    """The projector's squared norm, about and from below, by power iteration over the relation from a positive vector."""
    v, value = matrix.select("voxel").distinct().withColumn("value", F.lit(1.0)), 0.0
    for _ in range(max(1, iterations)):
        size = (v.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0) ** 0.5
        v = written(linear.normal(matrix, v.withColumn("value", F.col("value") / max(size, 1e-30))))
        value = (v.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0) ** 0.5
    return value


def _residual(matrix: DataFrame, df: DataFrame, b: DataFrame, column: str = "data") -> DataFrame:
    """b (volume_id, view_idx, pixel, value[, ...]) with ``left``: the projections less the values."""
    got = project(matrix, df, column).withColumnRenamed("value", "p")
    return b.join(got, RAY, "left").withColumn("left", F.coalesce("p", F.lit(0.0)) - F.col("value")).drop("p")


def _fidelity(matrix: DataFrame, df: DataFrame, b: DataFrame, weight: Column | None = None) -> DataFrame:
    square = F.col("left") * F.col("left")
    return _residual(matrix, df, b).groupBy("volume_id").agg((0.5 * F.sum(square if weight is None else weight * weight * square)).alias("data_fidelity"))


def _metrics(k: int, matrix: DataFrame, df: DataFrame, b: DataFrame, lam: float, epsilon: float, scalars: DataFrame, weight: Column | None = None) -> DataFrame:
    """A row per volume; scalars: (volume_id, ...) what else the solver knows of an iteration."""
    rows = scalars.join(_fidelity(matrix, df, b, weight), "volume_id", "left").join(_tv(df, epsilon), "volume_id", "left")
    rows = rows.withColumn("data_fidelity", F.coalesce("data_fidelity", F.lit(0.0))).withColumn("tv_term", lam * F.col("tv"))
    prior = F.coalesce("prior_term", F.lit(0.0)) if "prior_term" in scalars.columns else F.lit(0.0)
    rows = rows.withColumn("objective", F.col("data_fidelity") + F.col("tv_term") + prior).withColumn("iteration", F.lit(k))
    kinds = {m: "int" if m == "cg_iterations" else "double" for m in METRICS}
    return rows.select("volume_id", "iteration", *[(F.col(m) if m in rows.columns else F.lit(None)).cast(t).alias(m) for m, t in kinds.items()])


def _start(x0: DataFrame, positivity: bool) -> DataFrame:
    data = F.transform("data", lambda v: v.cast("double"))
    return written(x0.select("volume_id", F.col("z").cast("int").alias("z"), "ny", "nx", _clip(data, positivity).alias("data")))


def _loop(state: DataFrame, iterations: int, step: Callable[[int, DataFrame], tuple[DataFrame, DataFrame, DataFrame]], going: Column) -> tuple[DataFrame, DataFrame]:
    """step(k, state): the new state, (volume_id, ...) scalars of the iteration, and metrics. Volumes for which ``going`` is not true leave."""
    ended, rows = [], []
    for k in range(1, iterations + 1):
        state, scalars, metrics = step(k, state)
        rows.append(metrics)
        if k == iterations:
            break
        stay = scalars.withColumn("__k", F.lit(k)).select("volume_id", F.coalesce(going, F.lit(True)).alias("__go"))
        if not stay.where(~F.col("__go")).isEmpty():
            ended.append(_with_scalars(state, stay.where(~F.col("__go"))).select("volume_id", "z", "ny", "nx", "data"))
            state = written(_with_scalars(state, stay.where("__go")).drop("__go"))
            if state.isEmpty():
                break
    final = state.select("volume_id", "z", "ny", "nx", "data")
    return reduce(DataFrame.unionByName, [*ended, final]), reduce(DataFrame.unionByName, rows)


def _change(moved: Column, before: Column) -> Column:
    """Relative change from sums over a volume's slices."""
    return (F.sqrt(F.sum(moved)) / F.greatest(F.sqrt(F.sum(before)), F.lit(1e-12))).alias("relative_x_change")


def _moved(old: str, new: str) -> Column:
    return F.aggregate(F.zip_with(new, old, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def pdhg(matrix: DataFrame, b: DataFrame, x0: DataFrame, lam: float, iterations: int, step: float | None = None, safety: float = 0.95, theta: float = 1.0, tolerance: float = 1e-5, epsilon: float = 1e-8, positivity: bool = True) -> tuple[DataFrame, DataFrame]:
    """min |Ax - b|^2 / 2 + lam TV(x) by the primal-dual hybrid gradient method; step: safety / the norm of (A, gradient) if none is given."""
    tau = step or safety / max((norm_bound(matrix) + 12.0) ** 0.5, 1e-12)
    from voxelmill.operators import row_solvers  # it takes its helpers from here

    if (packed := row_solvers.pack(matrix, b, x0, ["data"], positivity)) is not None:
        return row_solvers.pdhg(packed, lam, iterations, tau, theta, tolerance, epsilon, positivity)
    state = _start(x0, positivity).withColumn("ahead", F.col("data")).withColumns({g: _zeros() for g in ("gx", "gy", "gz")})
    duals = [written(b.select(*RAY, "value").withColumn("y", F.lit(0.0)))]

    def one(k: int, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        here = duals[-1].join(state.select("volume_id").distinct(), "volume_id", "left_semi") if k > 1 else duals[-1]
        duals.append(written(_residual(matrix, state, here, "ahead").select(*RAY, "value", ((F.col("y") + tau * F.col("left")) / (1 + tau)).alias("y"))))
        moved = gradient(state.withColumnsRenamed({"gx": "px", "gy": "py", "gz": "pz"}), "ahead")
        moved = moved.withColumns({g: _plus(p, g, tau) for g, p in (("gx", "px"), ("gy", "py"), ("gz", "pz"))}).drop("px", "py", "pz")
        field = adjoint(written(volumes.project_ball(moved, lam)), "pull")
        whole = backprojected(matrix, duals[-1].select(*RAY, F.col("y").alias("value")), field, "data_pull", state)
        new = whole.withColumn("old", F.col("data")).withColumn("data", _clip(_plus("data", _plus("data_pull", "pull"), -tau), positivity))
        new = written(new.withColumn("ahead", F.zip_with("data", "old", lambda n, o: n + theta * (n - o))).drop("pull", "data_pull"))
        scalars = written(new.groupBy("volume_id").agg(_change(_moved("old", "data"), _dot("old", "old"))))
        return new.drop("old"), scalars, _metrics(k, matrix, new, b, lam, epsilon, scalars)

    return _loop(state, iterations, one, (F.col("__k") == 1) | (F.col("relative_x_change") > tolerance))


def subset_tv(matrix: DataFrame, b: DataFrame, x0: DataFrame, n_views: int, lam: float, iterations: int, batch: int = 64, subsets: int = 1, step: float | None = None, safety: float = 0.7, tolerance: float = 1e-5, epsilon: float = 1e-4, positivity: bool = True, weighted: bool = False, prior: DataFrame | None = None, rho: float = 0.0, all_subsets: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ordered-subset descent on the smoothed problem: batches of views (0 to n_views - 1) one after the other, each from the last one's x.

    weighted: b has a column ``weight`` (at most 1, or give a step), whose square a residual counts by. prior: slices with ``prior`` and ``trust``
    (0 to 1), for + rho/2 |sqrt(trust) (x - prior)|^2. The curvature of the data is bounded by ``norm_bound``.
    """
    tau = step or safety / max(norm_bound(matrix) + (rho if prior is not None else 0.0), 1e-12)
    known = None if prior is None else prior.select("volume_id", F.col("z").cast("int").alias("z"), *[F.transform(c, lambda v: v.cast("double")).alias(c) for c in ("prior", "trust")])
    slices = x0 if known is None else x0.withColumn("z", F.col("z").cast("int")).join(known, ["volume_id", "z"])
    from voxelmill.operators import row_solvers  # it takes its helpers from here

    if (packed := row_solvers.pack(matrix, b, slices, ["data"] if known is None else ["data", "prior", "trust"], positivity, weighted)) is not None:
        return row_solvers.subset_tv(packed, n_views, lam, iterations, batch, subsets, tau, tolerance, epsilon, positivity, rho, all_subsets)
    state = _start(x0, positivity)
    if known is not None:
        state = written(state.join(known, ["volume_id", "z"]))
    weight = F.col("weight") if weighted else None
    value = F.col("left") if weight is None else weight * weight * F.col("left")

    def one(k: int, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        used = [v.tolist() for v in (view_batches(n_views, batch, subsets) if all_subsets else view_batches(n_views, batch, subsets, (k - 1) % max(1, subsets)))]
        state = state.withColumns({"moved": F.lit(0.0), "before": _dot("data", "data")})
        for views in used:
            subset = sum(map(len, used)) if not all_subsets else len(range(views[0] % max(1, subsets), n_views, max(1, subsets)))
            seen = F.col("view_idx").isin(views)
            part = matrix.where(seen)
            here = b.where(seen).join(state.select("volume_id").distinct(), "volume_id", "left_semi")
            pull = _residual(part, state, here).select(*RAY, value.alias("value"))
            g = backprojected(part, pull, _tv_gradient(state, epsilon), "g", state, linear.subset_scale(n_views, subset, len(views)))
            g = g.withColumn("g", _plus("g", "tv", lam)).drop("tv")
            if prior is not None:
                g = g.withColumn("g", _plus("g", F.zip_with("trust", F.zip_with("data", "prior", lambda a, p: a - p), lambda t, d: t * d), rho))
            t = tau / len(used)
            state = written(g.withColumns({"moved": F.col("moved") + t * t * _dot("g", "g"), "data": _clip(_plus("data", "g", -t), positivity)}).drop("g"))
        sums = [_change(F.col("moved"), F.col("before"))]
        if prior is not None:
            off = F.zip_with("data", "prior", lambda a, p: (a - p) * (a - p))
            sums.append((0.5 * rho * F.sum(_dot("trust", off))).alias("prior_term"))
        scalars = written(state.groupBy("volume_id").agg(*sums))
        return state.drop("moved", "before"), scalars, _metrics(k, matrix, state, b, lam, epsilon, scalars, weight)

    return _loop(state, iterations, one, (F.col("__k") == 1) | (F.col("relative_x_change") > tolerance))


def anchored(matrix: DataFrame, b: DataFrame, x0: DataFrame, prior: DataFrame, n_views: int, lam: float = 1e-4, rho: float = 0.05, sweeps: int = 5, batch: int = 32, subsets: int = 8, step: float | None = None, safety: float = 0.5, epsilon: float = 1e-4, tolerance: float = 1e-5, weighted: bool = False, positivity: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sweeps over all subsets with a pull towards a prior (volume_id, z, prior, trust) where it is trusted; a slice without a prior is left out."""
    return subset_tv(matrix, b, x0, n_views, lam, sweeps, batch, max(1, min(subsets, n_views)), step, safety, tolerance, epsilon, positivity, weighted, prior, rho, all_subsets=True)


def _normal(matrix: DataFrame, df: DataFrame, column: str, rho: float, out: str) -> DataFrame:
    """df with (A'A + rho G'G) of a column."""
    own = df.drop("gx", "gy", "gz")
    both = adjoint(gradient(own, column), "__rough").drop("gx", "gy", "gz")
    both = backprojected(matrix, project(matrix, df, column), both, "__data", df)
    return both.withColumn(out, _plus("__data", "__rough", rho)).drop("__data", "__rough")


def _cg(matrix: DataFrame, df: DataFrame, rho: float, iterations: int, tolerance: float) -> DataFrame:
    """df (data, rhs) with data solved for and ``cg_left``, ``cg_used`` of its volume; a volume that is done, or has no curvature, stands still."""
    work = _normal(matrix, df, "data", rho, "r").withColumn("r", _plus("rhs", "r", -1.0)).withColumn("p", F.col("r"))
    work = written(work)
    first = work.groupBy("volume_id").agg(F.sum(_dot("r", "r")).alias("square"), F.greatest(F.sqrt(F.sum(_dot("rhs", "rhs"))), F.lit(1e-30)).alias("size"))
    work = written(_with_scalars(work, first).withColumn("cg_used", F.lit(0)))
    for _ in range(iterations):
        work = written(_normal(matrix, work, "p", rho, "q"))
        curve = work.groupBy("volume_id").agg(F.sum(_dot("p", "q")).alias("curve"))
        work = _with_scalars(work, curve).withColumn("__go", (F.sqrt("square") / F.col("size") > tolerance) & (F.abs("curve") > 1e-30))
        alpha = F.when(F.col("__go"), F.col("square") / F.col("curve")).otherwise(F.lit(0.0))
        work = work.withColumn("__alpha", alpha)
        work = written(work.withColumns({"data": _plus("data", "p", F.col("__alpha")), "r": _plus("r", "q", -F.col("__alpha")), "cg_used": F.col("cg_used") + F.col("__go").cast("int")}).drop("__alpha", "q", "curve"))
        new = work.groupBy("volume_id").agg(F.sum(_dot("r", "r")).alias("__new"))
        work = _with_scalars(work, new).withColumn("__beta", F.when(F.col("__go"), F.col("__new") / F.greatest("square", F.lit(1e-30))).otherwise(F.lit(0.0)))
        turned = F.when(F.col("__go"), _plus("r", "p", F.col("__beta"))).otherwise(F.col("p"))
        work = written(work.withColumn("p", turned).withColumn("square", F.col("__new")).drop("__new", "__beta", "__go"))
    return work.withColumn("cg_left", F.sqrt("square") / F.col("size")).drop("r", "p", "square", "size", "rhs")


def admm(matrix: DataFrame, b: DataFrame, x0: DataFrame, lam: float, rho: float, iterations: int, cg_iterations: int = 10, cg_tolerance: float = 1e-4, tolerances: tuple[float, float, float] = (1e-4, 1e-4, 1e-5), epsilon: float = 1e-8, positivity: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same problem by the alternating direction method, with conjugate gradients inside."""
    if rho <= 0 or lam < 0:
        raise ValueError("rho must be positive and lam not negative")
    from voxelmill.operators import row_solvers  # it takes its helpers from here

    if (packed := row_solvers.pack(matrix, b, x0, ["data"], positivity)) is not None:
        return row_solvers.admm(packed, lam, rho, iterations, cg_iterations, cg_tolerance, tolerances, epsilon, positivity)
    parts = ("x", "y", "z")
    state = _start(x0, positivity).withColumns({f"{f}{a}": _zeros() for f in ("d", "u") for a in parts})
    state = written(backprojected(matrix, b.select(*RAY, "value"), state, "full"))

    def one(k: int, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        wanted = adjoint(state.withColumns({f"g{a}": _plus(f"d{a}", f"u{a}", -1.0) for a in parts}), "back").drop("gx", "gy", "gz")
        ready = written(wanted.withColumns({"rhs": _plus("full", "back", rho), "old": F.col("data")}).drop("back"))
        solved = _cg(matrix, ready, rho, cg_iterations, cg_tolerance)
        solved = written(solved.withColumn("data", _clip("data", positivity)))
        split = gradient(solved).withColumnsRenamed({f"g{a}": f"v{a}" for a in parts})
        shrunk = volumes.shrink(split.withColumns({f"g{a}": _plus(f"v{a}", f"u{a}") for a in parts}), lam / rho)
        # u + gradient - d; then the change of d, whose adjoint is the dual residual
        new = shrunk.withColumns({f"u{a}": _plus(_plus(f"u{a}", f"v{a}"), f"g{a}", -1.0) for a in parts})
        new = new.withColumn("gap", reduce(lambda s, a: s + _moved(f"v{a}", f"g{a}"), parts, F.lit(0.0)))
        new = new.withColumns({f"d{a}": F.col(f"g{a}") for a in parts} | {f"g{a}": _plus(f"g{a}", f"d{a}", -1.0) for a in parts})
        new = written(adjoint(written(new.drop(*[f"v{a}" for a in parts])), "turn").drop("gx", "gy", "gz"))
        sums = [_change(_moved("old", "data"), _dot("old", "old")), F.sqrt(F.sum("gap")).alias("primal_residual"), (rho * F.sqrt(F.sum(_dot("turn", "turn")))).alias("dual_residual"), F.max("cg_left").alias("cg_residual"), F.max("cg_used").alias("cg_iterations")]
        scalars = written(new.groupBy("volume_id").agg(*sums))
        return new.drop("old", "gap", "turn", "cg_left", "cg_used"), scalars, _metrics(k, matrix, new, b, lam, epsilon, scalars)

    over = (F.col("primal_residual") > tolerances[0]) | (F.col("dual_residual") > tolerances[1]) | (F.col("relative_x_change") > tolerances[2])
    return _loop(state, iterations, one, over)
