"""Masks, smoothing and resampling by slices, spline shifts, upsampled drift: against NumPy on whole volumes and images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import kernels, linear, masks, quality, volumes
from voxelmill.plans.preprocess import pair_shifts


def slices(spark, cubes):
    rows = [(v, z, *a.shape[1:], [None if x is None else float(x) for x in a[z].reshape(-1)]) for v, a in enumerate(cubes) for z in range(a.shape[0])]
    return spark.createDataFrame(rows, "volume_id long, z int, ny int, nx int, data array<double>")


def back(df, column, n=1):
    rows = sorted(df.select("volume_id", "z", "ny", "nx", column).collect(), key=lambda r: (r["volume_id"], r["z"]))
    return [np.stack([np.asarray(r[column]).reshape(r["ny"], r["nx"]) for r in rows if r["volume_id"] == v]) for v in range(n)]


@pytest.mark.parametrize("slab", [1, 2, 32])
def test_morphology(spark, slab):
    cubes = [np.random.default_rng(sum(shape)).uniform(size=shape) for shape in ((5, 4, 3), (9, 3, 61), (4, 2, 60), (3, 2, 121), (1, 1, 1))]
    df = masks.pack(slices(spark, cubes), lambda v: v > 0.6)

    def same(m, want):
        shown = back(m.withColumn("mask", masks.unpack(F.col("bits"), F.col("ny"), F.col("nx"))), "mask", len(cubes))
        return all((x == want(a > 0.6)).all() for x, a in zip(shown, cubes, strict=True))

    assert same(df, lambda m: m) and same(masks.morph(df, [], slab), lambda m: m)
    assert same(masks.dilate(df, 2, slab), lambda m: kernels.dilate(m, 2)) and same(masks.close(df, slab), kernels.close)


def test_support(spark):
    rng = np.random.default_rng(2)
    block = rng.normal(0, 0.01, (8, 7, 9))
    block[2:6, 2:5, 3:7] += 1
    holed = block.copy()
    holed[0, 0, 0], holed[4, 3, 4] = np.nan, np.inf
    holed[4, 3, 4] = np.nan
    cubes = [block, holed, np.full((8, 7, 9), np.nan), np.zeros((8, 7, 9))]
    got = back(masks.support(slices(spark, cubes), 8, 0.7, 1, slab=3).withColumn("mask", masks.unpack(F.col("bits"), F.col("ny"), F.col("nx"))), "mask", 4)
    for a, m in zip(cubes, got, strict=True):
        assert (m == kernels.support_mask(a, 0.7, 1)).all()
    assert got[2].all() and not got[0].all()


@pytest.mark.parametrize("sigma", [0.0, 0.5, 1.3])
def test_gaussian(spark, sigma):
    a = np.random.default_rng(3).normal(size=(5, 4, 6))
    assert np.allclose(back(volumes.gaussian(slices(spark, [a]), 5, sigma), "data")[0], kernels.gaussian(a, sigma))


@pytest.mark.parametrize("shape", [(4, 6, 5), (2, 3, 5), (4, 3, 5), (3, 5, 2), (1, 1, 1), (7, 6, 9)])
def test_resampling(spark, shape):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(4, 6, 5)), rng.normal(size=(8, 6, 10))
    got = back(volumes.resample(slices(spark, [a, b]), shape), "data", 2)
    for x, y in zip((a, b), got, strict=True):
        if all(n % m == 0 for n, m in zip(x.shape, shape, strict=True)):
            want = kernels.block_mean(x, tuple(n // m for n, m in zip(x.shape, shape, strict=True)))
        else:
            want = linear.resample_volume(x, shape)
        assert y.shape == shape and np.allclose(y, want, atol=1e-6)


def plain_spline(a, by, order, mode):
    """One axis by the definition: all pixels times the spline of their distance, ends repeated or folded far enough."""
    n, pad = len(a), 40
    wide = np.pad(a, pad, mode={"nearest": "edge", "reflect": "symmetric", "mirror": "reflect", "wrap": "wrap", "constant": "reflect"}[mode])
    pieces = {2: lambda d: np.where(d < 0.5, 0.75 - d**2, np.where(d < 1.5, (1.5 - d) ** 2 / 2, 0)), 3: lambda d: np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))}
    out = []
    for i in range(n):
        at = i - by
        outside = at < 0 or at > n - 1
        if mode == "nearest":
            at = min(max(at, 0), n - 1)
        d = np.abs(at - (np.arange(len(wide)) - pad))
        w = pieces[order](d) if order in pieces else kernels.bspline(d, order)
        out.append(0.0 if mode == "constant" and outside else float((w * wide).sum()))
    return np.array(out)


@pytest.mark.parametrize("mode", ["nearest", "reflect", "mirror", "wrap", "constant"])
@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_spline_shifts(mode, order):
    a = np.random.default_rng(5).normal(size=(9, 8)).astype(np.float32)
    for rows, cols in ((0.25, -0.5), (1.0, -2.3), (-3.75, 0.0)):
        want = np.stack([plain_spline(c, rows, order, mode) for c in a.astype(float).T]).T
        want = np.stack([plain_spline(r, cols, order, mode) for r in want])
        assert np.allclose(kernels.shift_image(a, rows, cols, order, mode), want, atol=1e-5)
    assert np.allclose(sum(kernels.bspline(np.array([0.3 - k]), order) for k in range(-5, 6)), 1)
    with pytest.raises(ValueError):
        kernels.shift_image(a, 1, 1, 6)


def test_drift_to_a_tenth_of_a_pixel(spark):
    rng = np.random.default_rng(6)
    a = kernels.gaussian(rng.normal(size=(32, 24)), 1.0)
    fy, fx = np.fft.fftfreq(32)[:, None], np.fft.fftfreq(24)
    moved = lambda dy, dx: np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (fy * dy + fx * dx))).real
    known = [(0.0, 0.0), (0.3, -0.7), (2.4, 5.1), (-11.6, -3.0), (15.9, 0.5)]
    rows = [(k, 32, 24, moved(*s).reshape(-1).tolist(), a.reshape(-1).tolist()) for k, s in enumerate(known)]
    got = pair_shifts(spark.createDataFrame(rows, "k long, rows int, cols int, reference array<double>, data array<double>"), "k").orderBy("k").collect()
    assert np.allclose([(r["y_shift_px"], r["x_shift_px"]) for r in got], known, atol=0.051)
    assert kernels.phase_shift(a, a, 1) == (0.0, 0.0) and kernels.phase_shift(a[:1], a[:1])[0] == 0.0


def test_confidence_over_a_support(spark):
    rng = np.random.default_rng(8)
    delta, loss, inside = rng.uniform(0, 1, (4, 3, 5)), rng.uniform(0, 1, (4, 3, 5)), rng.integers(0, 2, (4, 3, 5))
    rows = [(v, z, 3, 5, delta[z].reshape(-1).tolist(), loss[z].reshape(-1).tolist(), (inside[z] * (1 - v)).reshape(-1).tolist()) for v in range(2) for z in range(4)]
    df = spark.createDataFrame(rows, "volume_id long, z int, ny int, nx int, delta array<double>, loss array<double>, support array<int>")
    got = back(quality.confidence(df, 4, 0.35, 0.6, 0.05, 1.0), "data", 2)
    assert np.allclose(got[0], kernels.confidence(delta, loss, inside == 1, 0.35, 0.6, 0.05, 1.0), atol=1e-6)
    assert np.allclose(got[1], 0.05)  # nothing is support
