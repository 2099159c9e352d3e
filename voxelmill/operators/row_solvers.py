"""The table solvers for volumes that are small: a volume with its projections is a row, so that nothing has to meet and a step shuffles nothing.

``pack`` makes such rows where every volume, its rays and the relation are bounded, and gives None where they are not; the solvers of
``slice_solvers`` then keep slices and rays as rows. Both do the same sums. The relation is one row (rays with their voxels, voxels with their rays)
that is broadcast; a volume's row is written after each iteration with that iteration's metrics, and volumes that are done leave the loop.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.operators import linear, volumes
from voxelmill.operators.arrays import _div
from voxelmill.operators.slice_solvers import METRICS, _dot, _moved, _plus, written
from voxelmill.operators.solvers import view_batches

#: Bounds of a row: voxels of a volume, rays and entries of the relation, pixels of a volume.
MOST_VOXELS, MOST_RAYS, MOST_ENTRIES = 4096, 2048, 65536
KEPT = ["volume_id", "slices", "ny", "nx", "data", "b", "weight", "off"]
G = ("gx", "gy", "gz")


def _let(columns: list[str], f: Callable[[Column], Column]) -> Column:
    """f of a struct of the columns, which are worked out once a row and not once an element."""
    return F.get(F.transform(F.array(F.struct(*columns)), f), 0)


def _total(array: str | Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def _relation(matrix: DataFrame) -> DataFrame | None:
    """One row: ``rays`` (view_idx, pixel, of voxel k and weight w) in order, and ``columns``, for every voxel the rays r and weights w."""
    known = matrix.where("view_idx IS NOT NULL AND pixel IS NOT NULL AND voxel >= 0 AND w IS NOT NULL")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max("voxel").alias("last")).first()
    if not size["n"] or size["n"] > MOST_ENTRIES or size["last"] >= MOST_ENTRIES:
        return None
    each = known.groupBy("view_idx", "pixel").agg(F.array_sort(F.collect_list(F.struct(F.col("voxel").cast("int").alias("k"), F.col("w").cast("double").alias("w")))).alias("of"))
    rays = written(each.agg(F.array_sort(F.collect_list(F.struct("view_idx", "pixel", "of"))).alias("rays")))
    turned = rays.select(F.posexplode("rays").alias("r", "ray")).select("r", F.explode("ray.of").alias("e")).groupBy("e.k").agg(F.array_sort(F.collect_list(F.struct("r", "e.w"))).alias("of"))
    grid = matrix.sparkSession.range(size["last"] + 1).select(F.col("id").cast("int").alias("k")).join(turned, "k", "left")
    columns = grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "of"))), lambda s: s["of"]).alias("columns"))
    return written(rays.crossJoin(columns))


def _volumes(slices: DataFrame, arrays: list[str]) -> DataFrame | None:
    """A row per volume of slices (volume_id, z, ny, nx, arrays), if every volume is small and whole: equal slices from 0 on without gaps or nulls."""
    whole = reduce(lambda a, b: a & b, [(F.size(c) == F.col("ny") * F.col("nx")) & ~F.exists(c, lambda v: v.isNull()) for c in arrays])
    last = F.max("z")
    each = slices.groupBy("volume_id").agg(F.sum(F.size("data")).alias("voxels"), (F.min(F.coalesce(whole, F.lit(False))) & (F.count("z") == F.count(F.lit(1))) & (F.min("z") == 0) & (last + 1 == F.count(F.lit(1))) & (F.sum(F.col("z") * F.col("z")) * 6 == last * (last + 1) * (2 * last + 1)) & (F.sum("z") * 2 == last * (last + 1)) & (F.min("ny") == F.max("ny")) & (F.min("nx") == F.max("nx")) & F.col("volume_id").isNotNull()).alias("fits"))
    found = each.agg(F.max("voxels").alias("voxels"), F.min(F.coalesce("fits", F.lit(False))).alias("fits")).first()
    if not found["fits"] or found["voxels"] > MOST_VOXELS:
        return None
    rows = slices.groupBy("volume_id").agg(F.array_sort(F.collect_list(F.struct("z", "ny", "nx", *arrays))).alias("s"))
    return rows.select("volume_id", F.size("s").alias("slices"), F.col("s")[0]["ny"].alias("ny"), F.col("s")[0]["nx"].alias("nx"), *[F.flatten(f"s.{c}").alias(c) for c in arrays])


def _pixels(relation: DataFrame, b: DataFrame, weighted: bool) -> DataFrame | None:
    """(volume_id, b, weight, off): values in the order of the rays, null where a volume has none; off: half the squares of pixels without a ray."""
    names = ["value", *(["weight"] if weighted else [])]
    missing = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in ("view_idx", "pixel", *names)])
    each = b.where("volume_id IS NOT NULL").groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), F.max(missing).alias("missing"))
    found = each.agg(F.max("n").alias("n"), F.max("missing").alias("missing")).first()
    if (found["n"] or 0) > MOST_RAYS or found["missing"]:
        return None
    numbers = relation.select(F.posexplode("rays").alias("r", "ray")).select("r", "ray.view_idx", "ray.pixel")
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    known = b.select("volume_id", "view_idx", "pixel", F.col("value").cast("double").alias("v"), weight.alias("w")).join(F.broadcast(numbers), ["view_idx", "pixel"], "left")
    lists = known.groupBy("volume_id").agg(F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "v", "w")))).alias("l"), F.sum(F.when(F.col("r").isNull(), 0.5 * F.col("w") * F.col("w") * F.col("v") * F.col("v")).otherwise(F.lit(0.0))).alias("off"))
    count = F.size("rays")
    listed = lists.crossJoin(F.broadcast(relation.select("rays")))
    twice = listed.where(F.size("l") != F.size(F.array_distinct(F.transform("l", lambda x: x["r"]))))
    if not twice.isEmpty():
        return None
    place = F.map_from_entries(F.transform("l", lambda x: F.struct(x["r"], x)))
    full = listed.withColumn("l", F.when(F.size("l") == count, F.col("l")).otherwise(_let([place.alias("m"), count.alias("n")], lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda r: F.try_element_at(s["m"], r)))))
    return full.select("volume_id", F.transform("l", lambda x: x["v"]).alias("b"), *([F.transform("l", lambda x: x["w"]).alias("weight")] if weighted else []), "off")


class Packed:
    """Volumes as rows, and the relation as one."""

    def __init__(self, rows: DataFrame, relation: DataFrame):
        self.rows, self.relation = rows, relation

    def beside(self, df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(self.relation))  # one row


def pack(matrix: DataFrame, b: DataFrame, slices: DataFrame, arrays: list[str], positivity: bool, weighted: bool = False) -> Packed | None:
    """Rows (volume_id, slices, ny, nx, arrays, b[, weight], off), written once; None if anything is too large or irregular for a row."""
    relation = _relation(matrix)
    if relation is None or relation.select(F.size("rays")).first()[0] > MOST_RAYS:
        return None
    plain = slices.select("volume_id", F.col("z").cast("int").alias("z"), F.col("ny").cast("int").alias("ny"), F.col("nx").cast("int").alias("nx"), *[F.transform(c, lambda v: v.cast("double")).alias(c) for c in arrays])
    rows = _volumes(plain, arrays)
    pixels = None if rows is None else _pixels(relation, b, weighted)
    if pixels is None:
        return None
    if positivity:
        rows = rows.withColumn("data", F.transform("data", lambda v: F.greatest(v, F.lit(0.0))))
    none = F.transform("rays", lambda _: F.lit(None).cast("double"))
    joined = rows.join(pixels, "volume_id", "left").crossJoin(F.broadcast(relation.select("rays")))
    filled = {c: F.coalesce(c, none) for c in ("b", *(["weight"] if weighted else []))} | {"off": F.coalesce("off", F.lit(0.0))}
    parts = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count, so that small rows with much work are not put into few tasks
    return Packed(written(joined.withColumns(filled).drop("rays").repartition(parts, "volume_id")), relation)


def gradient(df: DataFrame, column: str) -> DataFrame:
    """df with gx, gy, gz of a column: forward differences, 0 at the far ends."""

    def along(inside: Callable[[Column, Column], Column], step: Callable[[Column], Column]) -> Column:
        return _let([F.col(column).alias("d"), "ny", "nx"], lambda s: F.transform(s["d"], lambda v, k: F.when(inside(s, k), F.get(s["d"], k + step(s)) - v).otherwise(F.lit(0.0))))

    gx = along(lambda s, k: k % s["nx"] < s["nx"] - 1, lambda s: F.lit(1))
    gy = along(lambda s, k: _div(k, s["nx"]).cast("int") % s["ny"] < s["ny"] - 1, lambda s: s["nx"])
    gz = along(lambda s, k: k + s["ny"] * s["nx"] < F.size(s["d"]), lambda s: s["ny"] * s["nx"])
    return df.withColumns(dict(zip(G, (gx, gy, gz), strict=True)))


def adjoint(df: DataFrame, out: str) -> DataFrame:
    """The gradient's adjoint of (gx, gy, gz), which are 0 at the far ends."""

    def value(s: Column, k: Column) -> Column:
        nx, plane, zero = s["nx"], s["ny"] * s["nx"], F.lit(0.0)
        in_x = F.when(k % nx > 0, F.get(s["gx"], k - 1)).otherwise(zero) - F.get(s["gx"], k)
        in_y = F.when(_div(k, nx).cast("int") % s["ny"] > 0, F.get(s["gy"], k - nx)).otherwise(zero) - F.get(s["gy"], k)
        in_z = F.when(k >= plane, F.get(s["gz"], k - plane)).otherwise(zero) - F.get(s["gz"], k)
        return in_x + in_y + in_z

    return df.withColumn(out, _let([*G, "ny", "nx"], lambda s: F.transform(s["gx"], lambda _, k: value(s, k))))


def project(column: str, views: list[int] | None = None) -> Column:
    """Projections of a column in the order of the rays; 0 for rays of other views."""

    def ray(s: Column, r: Column) -> Column:
        value = F.aggregate(r["of"], F.lit(0.0), lambda a, e: a + e["w"] * F.coalesce(F.get(s["d"], e["k"]), F.lit(0.0)))
        return value if views is None else F.when(r["view_idx"].isin(views), value).otherwise(F.lit(0.0))

    return _let([F.col(column).alias("d"), "rays"], lambda s: F.transform(s["rays"], lambda r: ray(s, r)))


def backproject(column: str) -> Column:
    """The sums over the rays of each voxel; 0 where none passes."""
    value = lambda s, k: F.coalesce(F.aggregate(F.get(s["columns"], k), F.lit(0.0), lambda a, e: a + e["w"] * F.get(s["y"], e["r"])), F.lit(0.0))
    return _let([F.col(column).alias("y"), "columns", "data"], lambda s: F.transform(s["data"], lambda _, k: value(s, k)))


def _left(df: DataFrame, column: str, out: str, views: list[int] | None = None) -> DataFrame:
    """df with the projections of a column less the pixels; 0 where the volume has no pixel, and for other views."""
    got = df.withColumn(out, project(column, views))
    left = F.zip_with(out, "b", lambda p, v: F.when(v.isNull(), F.lit(0.0)).otherwise(p - v))
    if views is not None:
        left = _let([left.alias("l"), "rays"], lambda s: F.transform(s["rays"], lambda r, i: F.when(r["view_idx"].isin(views), F.get(s["l"], i)).otherwise(F.lit(0.0))))
    return got.withColumn(out, left)


def _weighed(df: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, F.zip_with(out, "weight", lambda v, w: F.coalesce(w * w * v, F.lit(0.0)))) if "weight" in df.columns else df


def _tv_gradient(df: DataFrame, epsilon: float) -> DataFrame:
    with_size = gradient(df, "data").withColumn("__m", volumes.magnitude(epsilon))
    unit = with_size.withColumns({g: F.zip_with(g, "__m", lambda a, m: a / m) for g in G}).drop("__m")
    return adjoint(unit, "tv").drop(*G)


def _with_metrics(df: DataFrame, lam: float, epsilon: float) -> DataFrame:
    """df (with what else the solver knows of the iteration) with objective, data_fidelity and tv_term."""
    got = gradient(_left(df, "data", "__left"), "data").withColumn("tv_term", lam * _total(volumes.magnitude(epsilon)))
    square = _weighed(got.withColumn("__w", F.col("__left")), "__w").withColumn("data_fidelity", 0.5 * _dot("__w", "__left") + F.col("off"))
    prior = F.col("prior_term") if "prior_term" in df.columns else F.lit(0.0)
    return square.withColumn("objective", F.col("data_fidelity") + F.col("tv_term") + prior).drop("__left", "__w", *G)


def _change(moved: Column, before: Column) -> Column:
    return F.sqrt(moved) / F.greatest(F.sqrt(before), F.lit(1e-12))


def _clip(data: Column, positivity: bool) -> Column:
    return F.transform(data, lambda v: F.greatest(v, F.lit(0.0))) if positivity else data


def _loop(packed: Packed, state: DataFrame, iterations: int, step: Callable[[int, DataFrame], DataFrame], carried: list[str], going: Callable[[int], Column]) -> tuple[DataFrame, DataFrame]:
    """step(k, state): the state with what is carried and the metrics of the iteration. Volumes for which ``going`` is not true leave."""
    kinds = {m: "int" if m == "cg_iterations" else "double" for m in METRICS}
    columns = [c for c in KEPT if c in packed.rows.columns] + carried
    ended, rows = [], []
    for k in range(1, iterations + 1):
        done = step(k, packed.beside(state))
        done = written(done.select(*columns, *[m for m in METRICS if m in done.columns]))
        rows.append(done.select("volume_id", F.lit(k).alias("iteration"), *[(F.col(m) if m in done.columns else F.lit(None)).cast(t).alias(m) for m, t in kinds.items()]))
        go = F.coalesce(going(k), F.lit(True))
        if k == iterations:
            ended.append(done.select("volume_id", "slices", "ny", "nx", "data"))
            break
        ended.append(done.where(~go).select("volume_id", "slices", "ny", "nx", "data"))
        state = done.where(go).select(*columns)
        if state.isEmpty():
            break
    last = reduce(DataFrame.unionByName, ended)
    plane = F.col("ny") * F.col("nx")
    cut = last.select("volume_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("z"), "ny", "nx", "data")
    return cut.withColumn("data", F.slice("data", F.col("z") * plane + 1, plane)), reduce(DataFrame.unionByName, rows)


def pdhg(packed: Packed, lam: float, iterations: int, tau: float, theta: float, tolerance: float, epsilon: float, positivity: bool) -> tuple[DataFrame, DataFrame]:
    state = packed.rows.withColumns({"ahead": F.col("data"), "y": F.transform("b", lambda _: F.lit(0.0))} | {p: F.transform("data", lambda _: F.lit(0.0)) for p in ("px", "py", "pz")})

    def one(k: int, state: DataFrame) -> DataFrame:
        got = _left(state, "ahead", "__left").withColumn("y", F.zip_with("y", "__left", lambda y, v: (y + tau * v) / (1 + tau)))
        moved = gradient(got, "ahead").withColumns({g: _plus(p, g, tau) for g, p in zip(G, ("px", "py", "pz"), strict=True)})
        field = adjoint(volumes.project_ball(moved, lam), "pull").withColumn("data_pull", backproject("y"))
        new = field.withColumn("old", F.col("data")).withColumn("data", _clip(_plus("data", _plus("data_pull", "pull"), -tau), positivity))
        new = new.withColumns({"ahead": F.zip_with("data", "old", lambda n, o: n + theta * (n - o)), "relative_x_change": _change(_moved("old", "data"), _dot("old", "old"))} | {p: F.col(g) for g, p in zip(G, ("px", "py", "pz"), strict=True)})
        return _with_metrics(new, lam, epsilon)

    return _loop(packed, state, iterations, one, ["ahead", "y", "px", "py", "pz"], lambda k: F.lit(k == 1) | (F.col("relative_x_change") > tolerance))


def subset_tv(packed: Packed, n_views: int, lam: float, iterations: int, batch: int, subsets: int, tau: float, tolerance: float, epsilon: float, positivity: bool, rho: float, all_subsets: bool) -> tuple[DataFrame, DataFrame]:
    known = [c for c in ("prior", "trust") if c in packed.rows.columns]

    def one(k: int, state: DataFrame) -> DataFrame:
        used = [v.tolist() for v in (view_batches(n_views, batch, subsets) if all_subsets else view_batches(n_views, batch, subsets, (k - 1) % max(1, subsets)))]
        state = state.withColumns({"moved": F.lit(0.0), "before": _dot("data", "data")})
        for views in used:
            subset = sum(map(len, used)) if not all_subsets else len(range(views[0] % max(1, subsets), n_views, max(1, subsets)))
            scale, t = linear.subset_scale(n_views, subset, len(views)), tau / len(used)
            pull = _weighed(_left(state, "data", "__left", views), "__left").withColumn("g", backproject("__left"))
            g = _tv_gradient(pull, epsilon).withColumn("g", F.zip_with("g", "tv", lambda a, b: scale * a + lam * b))
            if known:
                g = g.withColumn("g", _plus("g", F.zip_with("trust", F.zip_with("data", "prior", lambda a, p: a - p), lambda t, d: t * d), rho))
            state = g.withColumns({"moved": F.col("moved") + t * t * _dot("g", "g"), "data": _clip(_plus("data", "g", -t), positivity)}).drop("g", "tv", "__left")
        state = state.withColumn("relative_x_change", _change(F.col("moved"), F.col("before")))
        if known:
            state = state.withColumn("prior_term", 0.5 * rho * _dot("trust", F.zip_with("data", "prior", lambda a, p: (a - p) * (a - p))))
        return _with_metrics(state, lam, epsilon)

    return _loop(packed, packed.rows, iterations, one, known, lambda k: F.lit(k == 1) | (F.col("relative_x_change") > tolerance))


def _normal(df: DataFrame, column: str, rho: float, out: str) -> DataFrame:
    """df with (A'A + rho G'G) of a column."""
    both = adjoint(gradient(df, column), "__rough").withColumn("__seen", project(column)).withColumn("__data", backproject("__seen"))
    return both.withColumn(out, _plus("__data", "__rough", rho)).drop("__data", "__rough", "__seen", *G)


def _cg(df: DataFrame, rho: float, iterations: int, tolerance: float) -> DataFrame:
    """df (data, rhs) with data solved for, ``cg_residual`` and ``cg_iterations``; a volume that is done, or has no curvature, stands still."""
    work = _normal(df, "data", rho, "r").withColumn("r", _plus("rhs", "r", -1.0))
    work = work.withColumns({"p": F.col("r"), "square": _dot("r", "r"), "size": F.greatest(F.sqrt(_dot("rhs", "rhs")), F.lit(1e-30)), "cg_iterations": F.lit(0)})
    for _ in range(iterations):
        work = _normal(work, "p", rho, "q").withColumn("curve", _dot("p", "q"))
        work = work.withColumn("__go", (F.sqrt("square") / F.col("size") > tolerance) & (F.abs("curve") > 1e-30))
        work = work.withColumn("__alpha", F.when(F.col("__go"), F.col("square") / F.col("curve")).otherwise(F.lit(0.0)))
        work = work.withColumns({"data": _plus("data", "p", F.col("__alpha")), "r": _plus("r", "q", -F.col("__alpha")), "cg_iterations": F.col("cg_iterations") + F.col("__go").cast("int")})
        work = work.withColumn("__new", _dot("r", "r"))
        work = work.withColumn("__beta", F.when(F.col("__go"), F.col("__new") / F.greatest("square", F.lit(1e-30))).otherwise(F.lit(0.0)))
        work = work.withColumns({"p": F.when(F.col("__go"), _plus("r", "p", F.col("__beta"))).otherwise(F.col("p")), "square": F.col("__new")}).drop("q", "curve", "__go", "__alpha", "__new", "__beta")
    return work.withColumn("cg_residual", F.sqrt("square") / F.col("size")).drop("r", "p", "square", "size", "rhs")


def admm(packed: Packed, lam: float, rho: float, iterations: int, cg_iterations: int, cg_tolerance: float, tolerances: tuple[float, float, float], epsilon: float, positivity: bool) -> tuple[DataFrame, DataFrame]:
    parts = ("x", "y", "z")
    duals = [f"{f}{a}" for f in ("d", "u") for a in parts]
    state = packed.rows.withColumns({c: F.transform("data", lambda _: F.lit(0.0)) for c in duals})

    def one(k: int, state: DataFrame) -> DataFrame:
        wanted = adjoint(state.withColumns({f"g{a}": _plus(f"d{a}", f"u{a}", -1.0) for a in parts}), "back").drop(*G)
        wanted = wanted.withColumn("__y", F.transform("b", lambda v: F.coalesce(v, F.lit(0.0)))).withColumn("full", backproject("__y"))
        ready = wanted.withColumns({"rhs": _plus("full", "back", rho), "old": F.col("data")}).drop("back", "full", "__y")
        solved = _cg(ready, rho, cg_iterations, cg_tolerance)
        split = gradient(solved.withColumn("data", _clip(F.col("data"), positivity)), "data").withColumnsRenamed({f"g{a}": f"v{a}" for a in parts})
        shrunk = volumes.shrink(split.withColumns({f"g{a}": _plus(f"v{a}", f"u{a}") for a in parts}), lam / rho)
        new = shrunk.withColumns({f"u{a}": _plus(_plus(f"u{a}", f"v{a}"), f"g{a}", -1.0) for a in parts} | {"gap": reduce(lambda s, a: s + _moved(f"v{a}", f"g{a}"), parts, F.lit(0.0))})
        new = new.withColumns({f"d{a}": F.col(f"g{a}") for a in parts} | {f"g{a}": _plus(f"g{a}", f"d{a}", -1.0) for a in parts})
        new = adjoint(new, "turn").withColumns({"relative_x_change": _change(_moved("old", "data"), _dot("old", "old")), "primal_residual": F.sqrt("gap"), "dual_residual": rho * F.sqrt(_dot("turn", "turn"))})
        return _with_metrics(new.drop(*G), lam, epsilon)

    over = (F.col("primal_residual") > tolerances[0]) | (F.col("dual_residual") > tolerances[1]) | (F.col("relative_x_change") > tolerances[2])
    return _loop(packed, state, iterations, one, duals, lambda _: over)
