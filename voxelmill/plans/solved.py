"""Queries of the table solvers: every volume of embeddings from its projections in four views, with SQL that does the same sums on lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.geometry import ray_weights
from voxelmill.operators import linear, slice_solvers
from voxelmill.plans.images import rounded
from voxelmill.plans.iterative import PHANTOM

VIEWS, LAM = 4, 0.01


def _problem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The relation, written once so that Spark broadcasts it by its size or not, projections, the slices to start from, and the true slices."""
    angles = spark.range(VIEWS).select(F.col("id").alias("view_idx"), (F.col("id") * (np.pi / VIEWS)).alias("angle_rad"))
    matrix = slice_solvers.written(linear.system_matrix(angles, PHANTOM))
    cube = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    whole = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("volume_id"), cube.alias("cube"))
    whole = whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "volume_id")  # a small file is one task, whose voxels and rays are many
    truth = whole.select("volume_id", "cube", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z"))
    truth = truth.select("volume_id", "z", F.lit(4).alias("ny"), F.lit(4).alias("nx"), F.slice("cube", F.col("z") * 16 + 1, 16).alias("data"))
    b = slice_solvers.written(slice_solvers.project(matrix, truth))
    return matrix, b, truth.withColumn("data", F.transform("data", lambda _: F.lit(0.1))), truth


def _out(solved: tuple[DataFrame, DataFrame], metrics: list[str]) -> DataFrame:
    """Metrics of each iteration (voxel -1), and the solved voxels (iteration 0)."""
    x, rows = solved
    numbers: list[Column] = [rounded(F.col(m), 4).alias(m) for m in metrics]
    each = rows.select("volume_id", "iteration", F.lit(-1).alias("voxel"), F.lit(None).cast("double").alias("value"), *numbers)
    voxels = x.select("volume_id", "z", F.posexplode("data").alias("k", "v")).select("volume_id", F.lit(0).alias("iteration"), (F.col("z") * 16 + F.col("k")).alias("voxel"), rounded(F.col("v"), 4).alias("value"), *[F.lit(None).cast("double").alias(m) for m in metrics])
    return each.unionByName(voxels)


BASE = ["objective", "data_fidelity", "tv_term", "relative_x_change"]


def solved_pdhg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of the primal-dual method: metrics by iteration, and the voxels."""
    matrix, b, start, _ = _problem(spark, sf_dir)
    return _out(slice_solvers.pdhg(matrix, b, start, LAM, 2), BASE)


def solved_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes of ordered subsets, two batches of one view each."""
    matrix, b, start, _ = _problem(spark, sf_dir)
    return _out(slice_solvers.subset_tv(matrix, b, start, VIEWS, LAM, 2, batch=1, subsets=2), BASE)


def solved_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep over two subsets with weighted views, drawn to half the true volume."""
    matrix, b, start, truth = _problem(spark, sf_dir)
    prior = truth.select("volume_id", "z", F.transform("data", lambda v: v / 2).alias("prior"), F.transform("data", lambda _, k: (k % 5) / 4).alias("trust"))
    weighted = b.withColumn("weight", 1 / (1 + F.col("view_idx")))
    return _out(slice_solvers.anchored(matrix, weighted, start, prior, VIEWS, LAM, 0.5, 1, batch=2, subsets=2, weighted=True), [*BASE, "prior_term"])


def solved_admm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two iterations of the alternating direction method, two of conjugate gradients in each."""
    matrix, b, start, _ = _problem(spark, sf_dir)
    return _out(slice_solvers.admm(matrix, b, start, LAM, 0.2, 2, 2), [*BASE, "primal_residual", "dual_residual", "cg_residual", "cg_iterations"])


def _list(body: str) -> str:
    return f"list_transform(range(0, 64), lambda k: {body})"


def _a(v: str, views: list[int] | None = None) -> str:
    """Projections of a list of 64 voxels; rays of other views give 0."""
    seen = "1" if views is None else f"CASE WHEN vw[i] IN ({', '.join(map(str, views))}) THEN 1 ELSE 0 END"
    return f"list_transform(rw, lambda r, i: {seen} * list_dot_product(r, {v}))"


def _at(y: str) -> str:
    return f"list_transform(cl, lambda c: list_dot_product(c, {y}))"


def _grad(v: str, out: str) -> dict[str, str]:
    return {f"{out}x": _list(f"CASE WHEN k % 4 < 3 THEN {v}[k + 2] - {v}[k + 1] ELSE 0.0 END"), f"{out}y": _list(f"CASE WHEN k // 4 % 4 < 3 THEN {v}[k + 5] - {v}[k + 1] ELSE 0.0 END"), f"{out}z": _list(f"CASE WHEN k // 16 < 3 THEN {v}[k + 17] - {v}[k + 1] ELSE 0.0 END")}


def _adjoint(g: str) -> str:
    return _list(f"CASE WHEN k % 4 > 0 THEN {g}x[k] ELSE 0.0 END - {g}x[k + 1] + CASE WHEN k // 4 % 4 > 0 THEN {g}y[k - 3] ELSE 0.0 END - {g}y[k + 1] + CASE WHEN k // 16 > 0 THEN {g}z[k - 15] ELSE 0.0 END - {g}z[k + 1]")


def _size(g: str, epsilon: float) -> str:
    return _list(f"sqrt({g}x[k + 1] ** 2 + {g}y[k + 1] ** 2 + {g}z[k + 1] ** 2 + {epsilon!r}::DOUBLE ** 2)")


def _norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}, {v}))"


class _Sql:
    """Common table expressions, each with the former's columns and some more; a volume is a row."""

    def __init__(self) -> None:
        rows = [(view, int(p), int(v), float(w)) for view in range(VIEWS) for p, v, w in zip(*ray_weights(PHANTOM, view * (np.pi / VIEWS)), strict=True)]
        values = ", ".join(f"({a}, {b}, {c}, {w!r}::DOUBLE)" for a, b, c, w in rows)
        self.parts = [
            f"m(vi, px, vx, w) AS (VALUES {values})",
            "dense AS (SELECT vi, px, v AS vx, coalesce(sum(w) FILTER (WHERE m.vx = v), 0.0) AS w FROM m, (SELECT unnest(range(0, 64)) AS v) GROUP BY ALL)",
            "ra AS MATERIALIZED (SELECT list(row ORDER BY vi, px) AS rw, list(vi ORDER BY vi, px) AS vw FROM (SELECT vi, px, list(w ORDER BY vx) AS row FROM dense GROUP BY vi, px))",
            "ca AS MATERIALIZED (SELECT list(col ORDER BY vx) AS cl FROM (SELECT vx, list(w ORDER BY vi, px) AS col FROM dense GROUP BY vx))",
            "bound AS MATERIALIZED (SELECT (SELECT max(s) FROM (SELECT sum(w) AS s FROM m GROUP BY vi, px)) * (SELECT max(s) FROM (SELECT sum(w) AS s FROM m GROUP BY vx)) AS nb)",
            f"t0 AS MATERIALIZED (SELECT vec_id, t, {_a('t')} AS b, list_transform(t, lambda v: 0.1::DOUBLE) AS x0, list_transform(t, lambda v: 0.0::DOUBLE) AS z0, nb FROM (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS t FROM embeddings), ra, bound)",
        ]
        self.n, self.rows = 0, []

    def add(self, **columns: str) -> None:
        cells = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        self.parts.append(f"t{self.n + 1} AS MATERIALIZED (SELECT p.*, {cells} FROM t{self.n} p, ra, ca)")
        self.n += 1

    def metrics(self, k: int, x: str, epsilon: float, weight: str = "1.0", prior: str = "0.0", **more: str) -> None:
        self.add(**{f"left{k}": f"list_transform({_a(x)}, lambda v, i: {weight} * (v - b[i]))"}, **_grad(x, f"tv{k}"))
        self.add(**{f"fit{k}": f"0.5 * list_dot_product(left{k}, left{k})", f"tv{k}": f"{LAM!r} * list_sum({_size(f'tv{k}', epsilon)})"})
        self.rows.append((k, {"objective": f"fit{k} + tv{k} + {prior}", "data_fidelity": f"fit{k}", "tv_term": f"tv{k}", **more}))

    def text(self, x: str) -> str:
        names = list(self.rows[0][1])
        number = lambda e: f"round({e}, 4) + 0.0"
        out = [f"SELECT vec_id AS volume_id, {k} AS iteration, -1 AS voxel, NULL::DOUBLE AS value, " + ", ".join(f"{number(e)} AS {c}" for c, e in row.items()) + f" FROM t{self.n}" for k, row in self.rows]
        out.append(f"SELECT vec_id, 0, (j - 1)::INTEGER, {number(f'{x}[j]')}, {', '.join('NULL' for _ in names)} FROM t{self.n}, (SELECT unnest(range(1, 65)) AS j)")
        return f"WITH {', '.join(self.parts)} " + " UNION ALL ".join(out)


def _pdhg_sql() -> str:
    s = _Sql()
    s.add(tau="0.95 / sqrt(nb + 12.0)", a0="x0", px0="z0", py0="z0", pz0="z0", y0="list_transform(b, lambda v: 0.0::DOUBLE)")
    for k in (1, 2):
        o = k - 1
        s.add(**{f"y{k}": f"list_transform({_a(f'a{o}')}, lambda v, i: (y{o}[i] + tau * (v - b[i])) / (1 + tau))"}, **_grad(f"a{o}", f"g{k}"))
        s.add(**{f"q{k}{c}": _list(f"p{c}{o}[k + 1] + tau * g{k}{c}[k + 1]") for c in "xyz"})
        s.add(**{f"m{k}": _size(f"q{k}", 0.0)})
        s.add(**{f"p{c}{k}": _list(f"q{k}{c}[k + 1] / greatest(m{k}[k + 1] / {LAM!r}, 1.0)") for c in "xyz"})
        s.add(**{f"f{k}{c}": f"p{c}{k}" for c in "xyz"})
        s.add(**{f"w{k}": _adjoint(f"f{k}"), f"d{k}": _at(f"y{k}")})
        s.add(**{f"x{k}": _list(f"greatest(x{o}[k + 1] - tau * (d{k}[k + 1] + w{k}[k + 1]), 0.0)")})
        s.add(**{f"a{k}": _list(f"2.0 * x{k}[k + 1] - x{o}[k + 1]"), f"e{k}": _list(f"x{k}[k + 1] - x{o}[k + 1]")})
        s.metrics(k, f"x{k}", 1e-8, relative_x_change=f"{_norm(f'e{k}')} / greatest({_norm(f'x{o}')}, 1e-12)")
    return s.text("x2")


def _descent_sql(passes: list[list[list[int]]], safety: float, rho: float = 0.0) -> str:
    """passes: the batches of views of each pass, with the factor that makes a batch stand for all views, n / batch."""
    s, n = _Sql(), 0
    weight = "1.0 / (1 + vw[i])" if rho else "1.0"
    s.add(tau=f"{safety!r} / (nb + {rho!r})")
    for k, used in enumerate(passes, 1):
        start, moved = n, []
        for views in used:
            x, n = f"x{n}", n + 1
            s.add(**{f"r{n}": f"list_transform({_a(x, views)}, lambda v, i: CASE WHEN vw[i] IN ({', '.join(map(str, views))}) THEN ({weight}) ** 2 * (v - b[i]) ELSE 0.0 END)"}, **_grad(x, f"g{n}"))
            s.add(**{f"m{n}": _size(f"g{n}", 1e-4), f"d{n}": _at(f"r{n}")})
            s.add(**{f"u{n}{c}": _list(f"g{n}{c}[k + 1] / m{n}[k + 1]") for c in "xyz"})
            s.add(**{f"w{n}": _adjoint(f"u{n}")})
            pull = f" + {rho!r} * (k % 16 % 5) / 4 * ({x}[k + 1] - t[k + 1] / 2)" if rho else ""
            s.add(**{f"h{n}": _list(f"{VIEWS / len(views)!r} * d{n}[k + 1] + {LAM!r} * w{n}[k + 1]{pull}")})
            s.add(**{f"x{n}": _list(f"greatest({x}[k + 1] - tau / {len(used)} * h{n}[k + 1], 0.0)")})
            moved.append(f"(tau / {len(used)}) ** 2 * list_dot_product(h{n}, h{n})")
        prior = f"0.5 * {rho!r} * list_sum({_list(f'(k % 16 % 5) / 4 * (x{n}[k + 1] - t[k + 1] / 2) ** 2')})"
        more = {"prior_term": prior} if rho else {}
        s.metrics(k, f"x{n}", 1e-4, weight, prior if rho else "0.0", relative_x_change=f"sqrt({' + '.join(moved)}) / greatest({_norm(f'x{start}')}, 1e-12)", **more)
    return s.text(f"x{n}")


def _admm_sql(rho: float = 0.2, iterations: int = 2, inner: int = 2) -> str:
    s = _Sql()
    s.add(whole=_at("b"), **{f"{f}0{c}": "z0" for f in "du" for c in "xyz"})

    def normal(v: str, out: str) -> None:
        s.add(**_grad(v, f"{out}g"), **{f"{out}a": _a(v)})
        s.add(**{f"{out}w": _adjoint(f"{out}g"), f"{out}d": _at(f"{out}a")})
        s.add(**{out: _list(f"{out}d[k + 1] + {rho!r} * {out}w[k + 1]")})

    for k in range(1, iterations + 1):
        o, c0 = k - 1, f"c{k}_0"
        s.add(**{f"b{k}{c}": _list(f"d{o}{c}[k + 1] - u{o}{c}[k + 1]") for c in "xyz"})
        s.add(**{f"bw{k}": _adjoint(f"b{k}")})
        s.add(**{f"rhs{k}": _list(f"whole[k + 1] + {rho!r} * bw{k}[k + 1]"), f"{c0}x": f"x{o}"})
        normal(f"{c0}x", f"{c0}m")
        s.add(**{f"{c0}r": _list(f"rhs{k}[k + 1] - {c0}m[k + 1]")})
        s.add(**{f"{c0}p": f"{c0}r", f"{c0}s": f"list_dot_product({c0}r, {c0}r)", f"{c0}n": "0", f"size{k}": f"greatest({_norm(f'rhs{k}')}, 1e-30)"})
        for j in range(inner):
            a, z = f"c{k}_{j}", f"c{k}_{j + 1}"
            normal(f"{a}p", f"{a}q")
            s.add(**{f"{a}c": f"list_dot_product({a}p, {a}q)"})
            s.add(**{f"{a}go": f"sqrt({a}s) / size{k} > 1e-4 AND abs({a}c) > 1e-30"})
            s.add(**{f"{a}al": f"CASE WHEN {a}go THEN {a}s / {a}c ELSE 0.0 END"})
            s.add(**{f"{z}x": _list(f"{a}x[k + 1] + {a}al * {a}p[k + 1]"), f"{z}r": _list(f"{a}r[k + 1] - {a}al * {a}q[k + 1]"), f"{z}n": f"{a}n + {a}go::INTEGER"})
            s.add(**{f"{z}s": f"list_dot_product({z}r, {z}r)"})
            s.add(**{f"{z}p": f"CASE WHEN {a}go THEN {_list(f'{z}r[k + 1] + {z}s / greatest({a}s, 1e-30) * {a}p[k + 1]')} ELSE {a}p END"})
        end = f"c{k}_{inner}"
        s.add(**{f"x{k}": _list(f"greatest({end}x[k + 1], 0.0)")})
        s.add(**_grad(f"x{k}", f"g{k}"), **{f"e{k}": _list(f"x{k}[k + 1] - x{o}[k + 1]")})
        s.add(**{f"z{k}{c}": _list(f"g{k}{c}[k + 1] + u{o}{c}[k + 1]") for c in "xyz"})
        s.add(**{f"sz{k}": _size(f"z{k}", 0.0)})
        s.add(**{f"d{k}{c}": _list(f"greatest(1 - {LAM / rho!r} / greatest(sz{k}[k + 1], 1e-12), 0.0) * z{k}{c}[k + 1]") for c in "xyz"})
        s.add(**{f"u{k}{c}": _list(f"u{o}{c}[k + 1] + g{k}{c}[k + 1] - d{k}{c}[k + 1]") for c in "xyz"}, **{f"t{k}{c}": _list(f"d{k}{c}[k + 1] - d{o}{c}[k + 1]") for c in "xyz"}, **{f"gap{k}": _list(" + ".join(f"(g{k}{c}[k + 1] - d{k}{c}[k + 1]) ** 2" for c in "xyz"))})
        s.add(**{f"turn{k}": _adjoint(f"t{k}")})
        s.metrics(k, f"x{k}", 1e-8, relative_x_change=f"{_norm(f'e{k}')} / greatest({_norm(f'x{o}')}, 1e-12)", primal_residual=f"sqrt(list_sum(gap{k}))", dual_residual=f"{rho!r} * {_norm(f'turn{k}')}", cg_residual=f"sqrt({end}s) / size{k}", cg_iterations=f"{end}n")
    return s.text(f"x{iterations}")


QUERIES = {
    "solved_pdhg": (solved_pdhg, _pdhg_sql()),
    "solved_subsets": (solved_subsets, _descent_sql([[[0], [2]], [[1], [3]]], 0.7)),
    "solved_anchored": (solved_anchored, _descent_sql([[[0, 2], [1, 3]]], 0.5, 0.5)),
    "solved_admm": (solved_admm, _admm_sql()),
}
