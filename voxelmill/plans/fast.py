"""Composite plans over processed views: stack building, filter sweep, prior, quality report, centre search, solver choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.geometry import FILTERS, Geometry
from voxelmill.operators import arrays, kernels, linear, merge, select, stats


#: Candidate shifts that a copy of a view's lines is reconstructed with.
SHIFTS = 16


def anchor_weights(views: DataFrame, main_exposure: float | None = None, anchor_exposure: float | None = None, multiplier: float = 1.0, ratio: float = 10.0) -> DataFrame:
    """views (dataset main or anchor, mean_raw) with normalised ``weight``; the main median scales both."""
    parts = []
    for name, exposure, factor in (("main", main_exposure, 1.0), ("anchor", anchor_exposure, multiplier)):
        part = views.where(F.col("dataset") == name).withColumn("__e", F.lit(exposure).cast("double"))
        parts.append(stats.view_weights(part, "mean_raw", "__e", factor).drop("__e"))
    return stats.normalise_weights(merge.stack(parts), "weight", F.col("dataset") == "main", ratio)


def build_stack(main: DataFrame, anchors: DataFrame | None = None, use: Sequence[str] = ("recon", "tune"), combine: bool = True, tolerance_deg: float = 0.01, sort: bool = True) -> DataFrame:
    """One stack (view_idx, angle_rad, data, weight) of main views and the anchors of the splits in use; near-equal angles merged."""
    parts = [main] if anchors is None else [main, anchors.where(F.col("split").isin(*use))]
    if anchors is not None and parts[1].isEmpty():
        parts = parts[:1]
    weighted = all("weight" in p.columns for p in parts)
    columns = ["angle_rad", "rows", "cols", "data", *(["weight"] if weighted else [])]
    one = merge.stack([p.select(F.lit(k).alias("part"), "view_idx", *columns) for k, p in enumerate(parts)])
    numbered = select.numbered(one.select("part", "view_idx"), ["part", "view_idx"], "place")
    one = one.join(numbered, ["part", "view_idx"]).drop("part", "view_idx").withColumnRenamed("place", "view_idx")
    if combine:
        clusters = merge.angle_clusters(one, "angle_rad", "view_idx", np.deg2rad(tolerance_deg))
        size = one.select("rows", "cols").limit(1)
        merged = merge.merge_clusters(one.join(clusters.select("view_idx", "cluster"), "view_idx"), "data", "angle_rad", "weight" if weighted else None, ["cluster"])
        one = merged.crossJoin(F.broadcast(size)).withColumnRenamed("cluster", "view_idx")
    if sort:
        order = select.by_angle(one.select("view_idx", "angle_rad"), "angle_rad", "view_idx", wrapped=False).select("view_idx", "rank")
        one = one.join(order, "view_idx").drop("view_idx").withColumnRenamed("rank", "view_idx")
    return one.select("view_idx", "angle_rad", "rows", "cols", "data", *(["weight"] if weighted else []))


def collect_stack(views: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(images, angles, weights) in view order, for a solver on the driver; check its size with ``solver_choice`` first."""
    rows = views.orderBy("view_idx").collect()
    images = np.stack([np.asarray(r["data"], np.float32).reshape(r["rows"], r["cols"]) for r in rows])
    weights = np.array([r["weight"] for r in rows], np.float32) if "weight" in views.columns else None
    return images, np.array([r["angle_rad"] for r in rows]), None if weights is None or not np.isfinite(weights).all() else weights


def low_resolution(views: DataFrame, g: Geometry, factor: int) -> tuple[DataFrame, Geometry]:
    """Views and geometry coarser by a factor; as they are if a size does not divide by it."""
    low = g.low_resolution(factor)
    if low is g:
        return views, g
    data = arrays.block_mean(F.col("data"), F.col("rows"), F.col("cols"), factor, factor)
    return views.withColumn("data", data).withColumns({"rows": F.floor(F.col("rows") / factor).cast("int"), "cols": F.floor(F.col("cols") / factor).cast("int")}), low


def volume_scores(x: np.ndarray) -> dict[str, float]:
    """Roughness and negative energy of a volume."""
    g, size = kernels.grad3(x), max(float(np.abs(x).sum()), 1e-12)
    return {"tv_roughness": float(np.abs(g).sum()) / size, "negative_penalty": float((np.minimum(x, 0) ** 2).sum()) / max(float((x.astype(float) ** 2).sum()), 1e-12)}


def filter_sweep(spark: SparkSession, recon: DataFrame, tune: DataFrame | None, g: Geometry, filters: Sequence[str] = FILTERS, cutoffs: Sequence[float] = (1.0,), factor: int = 2, weights: tuple[float, float, float] = (1.0, 0.10, 0.10), manual: str | None = None, reconstruct: Callable[[DataFrame, Geometry, str], np.ndarray] | None = None, projector: Callable[[Geometry, np.ndarray], object] | None = None) -> tuple[DataFrame, str, np.ndarray]:
    """(scores, winner, volume): every filter on the coarse grid against the tune views, the winner (or the manual choice) on the fine one."""
    names = [f.strip().lower() for f in filters]
    chosen = (manual or "auto").strip().lower()
    if chosen != "auto" and chosen not in names:
        names.append(chosen)
    make = reconstruct or (lambda views, geo, name: _volume(linear.fdk(views, geo, name), geo))
    low, g_low = low_resolution(recon, g, factor)
    images, angles, w = (None, None, None) if tune is None or tune.isEmpty() else collect_stack(low_resolution(tune, g, factor)[0])
    op = None if images is None else (projector or (lambda geo, a: linear.RayProjector(spark, geo, a)))(g_low, angles)
    rows = []
    for k, (name, _) in enumerate((n, c) for n in dict.fromkeys(names) for c in cutoffs if c == 1.0):
        x = make(low, g_low, name)
        residual = 0.0
        if op is not None:
            ww = 1.0 if w is None else w[:, None, None]
            residual = float(((ww * (op.forward(x) - images)) ** 2).sum() / max(float(((ww * images) ** 2).sum()), 1e-12))
        rows.append((k, name, residual, *volume_scores(x).values()))
    table = spark.createDataFrame(rows, "candidate int, filter string, anchor_residual double, tv_roughness double, negative_penalty double")
    scored = select.robust_z_score(table, dict(zip(("anchor_residual", "tv_roughness", "negative_penalty"), weights, strict=True)))
    best = select.select_min(scored, "score_total", "candidate") if chosen == "auto" else select.select_named(scored, "filter", chosen)
    winner = best.first()["filter"]
    return scored, winner, make(recon, g, winner)


def _volume(slices: DataFrame, g: Geometry) -> np.ndarray:
    out = np.zeros(g.volume_voxels, np.float32)
    for r in slices.toLocalIterator():
        out[r["z"]] = np.asarray(r["data"], np.float32).reshape(g.volume_voxels[1:])
    return out


def prior_candidates(spark: SparkSession, x: np.ndarray, residual: Callable[[np.ndarray], float], tv_weights: Sequence[float] = (0.005, 0.01, 0.02, 0.04), percentiles: tuple[float, float] = (0.5, 99.5), limits: tuple[float, float] = (-0.1, 1.2), sigma: float = 2.0, dilation: int = 8, noise_sigma: float = 1.5, epsilon: float = 1e-4, iterations: int = 50, slab: int = 96, overlap: int = 12, max_ratio: float = 1.10, min_edges: float = 0.85, max_correction: float = 0.15, by_noise: bool = True, confidence: tuple[float, float, float, float] = (0.35, 1.5, 0.05, 1.0)) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(prior, confidence, scores): denoised candidates of rising strength, the accepted one of least background noise.

    Every slab is a task of its own, which is given just its slices and denoises them at each strength.
    """
    mask = kernels.support_mask(x, sigma, dilation)
    low, high = np.percentile(x[mask], percentiles)
    span = max(float(high - low), 1e-12)
    z = np.clip((x - low) / span, *limits)
    background = ~mask
    noise = kernels.mad((z - kernels.gaussian(z, noise_sigma))[background] if background.any() else z - kernels.gaussian(z, noise_sigma))
    base = residual(z)
    edges = np.sqrt((kernels.grad3(z) ** 2).sum(axis=0))
    strong = mask & (edges >= np.percentile(edges[mask], 95))
    cuts, (ny, nx) = kernels.slabs(len(z), slab, overlap), x.shape[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, raw in zip(pdf["a"], pdf["raw"], strict=True):
                part = np.frombuffer(raw).reshape(-1, ny, nx)
                for k, w in enumerate(tv_weights):
                    yield pd.DataFrame({"candidate": [k], "a": [a], "raw": [kernels.tv_denoise(part, float(w), epsilon, iterations).tobytes()]})

    parts = spark.createDataFrame([(a, z[a:b].tobytes()) for a, b in cuts], "a int, raw binary").repartition(len(cuts), "a")
    made, total = {k: np.zeros(z.shape) for k in range(len(tv_weights))}, np.zeros(len(z))
    for a, b in cuts:
        total[a:b] += 1
    for r in parts.mapInPandas(run, "candidate int, a int, raw binary").toLocalIterator():
        done = np.frombuffer(bytes(r["raw"])).reshape(-1, ny, nx)
        made[r["candidate"]][r["a"] : r["a"] + len(done)] += done
    made = {k: v / total[:, None, None] for k, v in made.items()}
    rows = []
    for k, w in enumerate(tv_weights):
        c = made[k]
        after = residual(c)
        ratio = after / base if np.isfinite(after) and np.isfinite(base) and base > 0 else 1.0
        correction = float(np.abs(c - z)[mask].sum() / max(float(np.abs(z)[mask].sum()), 1e-12))
        kept = float(np.median(np.sqrt((kernels.grad3(c) ** 2).sum(axis=0))[strong]) / max(float(np.median(edges[strong])), 1e-12))
        left = kernels.mad(c[background]) if background.any() else kernels.mad(c - kernels.gaussian(c, noise_sigma))
        rows.append((k, float(w), ratio, kept, correction, left, noise, bool(ratio <= max_ratio and kept >= min_edges and correction <= max_correction)))
    table = spark.createDataFrame(rows, "candidate int, tv_weight double, residual_ratio double, edge_retention double, correction_fraction double, background_noise double, input_noise double, accepted boolean")
    best = select.select_accepted(table, "accepted", "background_noise", "tv_weight", "candidate", by_noise).first()
    c = made[best["candidate"]]
    loss = np.maximum(edges - np.sqrt((kernels.grad3(c) ** 2).sum(axis=0)), 0) / np.maximum(edges, 1e-12)
    trust = kernels.confidence(np.abs(c - z), loss, mask, *confidence)
    scores = table.withColumns({"chosen": F.col("candidate") == best["candidate"], "chosen_by_fallback": (F.col("candidate") == best["candidate"]) & F.lit(bool(best["fallback"]))})
    return (c * span + low).astype(np.float32), trust, scores


def qc_table(spark: SparkSession, volumes: dict[str, np.ndarray], sets: dict[str, tuple[object, np.ndarray, np.ndarray | None]]) -> DataFrame:
    """(position, volume, split, residual): every volume against every held-out set (operator, images, weights)."""
    rows = []
    for split, (op, images, w) in sets.items():
        ww = 1.0 if w is None else w.reshape(-1, 1, 1)
        for name, x in volumes.items():
            value = float(((ww * (op.forward(x) - images)) ** 2).sum() / max(float(((ww * images) ** 2).sum()), 1e-12)) if len(images) else float("nan")
            rows.append((len(rows), name, split, value))
    return spark.createDataFrame(rows, "position int, volume string, split string, residual double")


def residual_images(spark: SparkSession, volumes: dict[str, np.ndarray], held_out: tuple[object, np.ndarray, np.ndarray | None]) -> DataFrame:
    """(volume, view, rows, cols, data): predicted less measured images of the qc set, weighted, for every volume."""
    op, images, w = held_out
    ww, rows = 1.0 if w is None else w.reshape(-1, 1, 1), []
    for name, x in volumes.items():
        left = np.asarray(ww * (op.forward(x) - images), np.float32)
        rows += [(name, k, *image.shape, image.reshape(-1).tolist()) for k, image in enumerate(left)]
    return spark.createDataFrame(rows, "volume string, view int, rows int, cols int, data array<float>")


def centre_search(views: DataFrame, g: Geometry, shifts: Sequence[float], name: str = "ram_lak", metric: str = "combined_score") -> tuple[DataFrame, float | None]:
    """(scores, best shift): a one-slice reconstruction for each candidate shift, scored by sharpness.

    Views stay where they are: each task filters its views' middle detector rows once for each shift and adds up its part of the slice;
    the parts of a candidate are added slice row by slice row.
    """
    rows, cols = g.detector_pixels
    low, high = max(0, rows // 2 - 2), min(rows, rows // 2 + 3)
    line = F.slice("data", low * cols + 1, (high - low) * cols)
    ny, nx = g.volume_voxels[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from dataclasses import replace

        from voxelmill.functions import geometry

        for pdf in batches:
            for group, part in pdf.groupby("group"):
                for k in range(group, min(len(shifts), group + SHIFTS)):
                    flat = replace(g, detector_pixels=(high - low, cols), volume_voxels=(1, ny, nx), centre_offset_px=float(shifts[k]), detector_offset_px=(0.0, g.detector_offset_px[1]))
                    image = np.zeros((ny, nx))
                    for angle, lines in zip(part["angle_rad"], part["line"], strict=True):
                        f = geometry.filter_projection(np.asarray(lines, np.float64).reshape(high - low, cols), flat, name)
                        image += geometry.backproject_filtered(f, flat, float(flat.angles(np.array([angle]))[0]), np.array([0]))[0]
                    yield pd.DataFrame({"candidate": k, "row": np.arange(ny), "data": list(image)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"candidate": [pdf["candidate"].iloc[0]], "row": [pdf["row"].iloc[0]], "data": [np.sum(np.stack(pdf["data"].to_list()), axis=0)]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        k, image = int(pdf["candidate"].iloc[0]), np.concatenate(pdf.sort_values("row")["data"].to_list()).astype(np.float32)
        return pd.DataFrame({"candidate": [k], "shift_px": [float(shifts[k])], "rows": [ny], "cols": [nx], "data": [image]})

    groups = F.array(*[F.lit(k) for k in range(0, len(shifts), SHIFTS)])
    each = views.select("angle_rad", line.alias("line"), F.explode(groups).alias("group"))
    summed = each.mapInPandas(run, "candidate int, row int, data array<double>").groupBy("candidate", "row").applyInPandas(add, "candidate int, row int, data array<double>")
    images = summed.groupBy("candidate").applyInPandas(whole, "candidate int, shift_px double, rows int, cols int, data array<float>")
    return score_images(images, metric)


def score_images(images: DataFrame, metric: str = "combined_score", margin: float = 0.1) -> tuple[DataFrame, float | None]:
    """(scores, best shift) of candidate images (candidate, shift_px, rows, cols, data)."""

    def run(batches):
        for pdf in batches:
            rows = [kernels.focus_metrics(kernels.metric_image(np.asarray(d).reshape(r, c), margin)) for d, r, c in zip(pdf["data"], pdf["rows"], pdf["cols"], strict=True)]
            yield pd.DataFrame([(k, s, *m) for k, s, m in zip(pdf["candidate"], pdf["shift_px"], rows, strict=True)], columns=["candidate", "shift_px", "gradient_energy", "laplacian_variance", "entropy"])

    # a few numbers per candidate; cached, as the score needs the extremes over all of them
    scored = images.mapInPandas(run, "candidate int, shift_px double, gradient_energy double, laplacian_variance double, entropy double").cache()
    table = stats.focus_scores(scored)
    best = select.select_best(table, metric, "candidate").first()
    return table, None if best is None else best["shift_px"]


def solver_choice(views: int, detector: tuple[int, int], volume: tuple[int, int, int], ram_gib: float, free_gib: float, fraction: float = 0.85, pdhg_fraction: float = 0.65) -> str:
    """admm, pdhg or subset_tv by the memory model, least memory last; an error if none fits."""
    v = 4.0 * volume[0] * volume[1] * volume[2] / 2**30
    p = 4.0 * views * detector[0] * detector[1] / 2**30
    need = {"admm": 18 * v + 3 * p, "pdhg": 5.5 * v + 3 * p, "subset_tv": 2.35 * v + 1.25 * p}
    if need["admm"] <= fraction * ram_gib and free_gib >= max(4.0, 2 * v + p):
        return "admm"
    if need["pdhg"] <= pdhg_fraction * ram_gib:
        return "pdhg"
    if need["subset_tv"] > fraction * ram_gib:
        raise MemoryError(f"{need['subset_tv']:.1f} GiB are needed, {fraction * ram_gib:.1f} may be used")
    return "subset_tv"


def recommended_batch(views: int, detector: tuple[int, int], volume: tuple[int, int, int], free_gib: float, devices: int = 1) -> int:
    """Views of a call that fit beside the volume, 1 at least; memory for 32 views or all is always reckoned."""
    v = 4.0 * volume[0] * volume[1] * volume[2] / 2**30
    view = 4.0 * detector[0] * detector[1] / 2**30
    floor = np.ceil(min(views, 32) / devices) * view
    room = max(0.0, 0.70 * free_gib - 1.35 * v - 2 * floor)
    return int(min(max(1, devices * np.floor(room / 2 / view)), views))


def call_memory(views: int, detector: tuple[int, int], volume: tuple[int, int, int], batch: int | None = None, devices: int = 1) -> float:
    """GiB of one projector call."""
    v = 4.0 * volume[0] * volume[1] * volume[2] / 2**30
    view = 4.0 * detector[0] * detector[1] / 2**30
    n = views if batch is None else min(views, max(batch, min(views, 32)))
    return 1.35 * v + 2.0 * np.ceil(n / devices) * view
