import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import kernels, volumes

SLICES = "volume_id int, z int, ny int, nx int, data array<double>"


def table(spark, *cubes):
    return spark.createDataFrame([(v, z, *x.shape, x.reshape(-1).tolist()) for v, c in enumerate(cubes) for z, x in enumerate(c)], SLICES)


def cube(df, column="data", volume=0):
    rows = df.where(F.col("volume_id") == volume).orderBy("z").collect()
    return np.stack([np.array(r[column]).reshape(r["ny"], r["nx"]) for r in rows])


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(123).normal(size=(4, 5, 6))


def test_gradient_and_adjoint(spark, x):
    y = np.random.default_rng(7).normal(size=(3, 2, 4))
    df = volumes.gradient(table(spark, x, y))
    for v, c in ((0, x), (1, y)):
        g = kernels.grad3(c)
        assert all(np.allclose(cube(df, n, v), g[k]) for k, n in enumerate(("gx", "gy", "gz")))
        assert np.allclose(cube(volumes.gradient_adjoint(df), "adjoint", v), kernels.grad3_adjoint(g))
    p = np.random.default_rng(8).normal(size=(3, *x.shape))
    assert abs((kernels.grad3(x) * p).sum() - (x * kernels.grad3_adjoint(p)).sum()) < 1e-9
    assert np.allclose(cube(volumes.laplacian(table(spark, x)), "laplacian"), -kernels.grad3_adjoint(kernels.grad3(x)))


def test_total_variation(spark, x):
    df = table(spark, x)
    assert volumes.tv_norm(df, 0.1).first()["tv"] == pytest.approx(kernels.tv_norm(x, 0.1))
    assert volumes.tv_roughness(df).first()["roughness"] == pytest.approx(np.abs(kernels.grad3(x)).sum() / np.abs(x).sum())
    assert np.allclose(cube(volumes.tv_gradient(df, 0.1), "tv_gradient"), kernels.tv_gradient(x, 0.1))
    small = volumes.shrink(df.withColumns({g: F.transform("data", lambda _: F.lit(0.1)) for g in ("gx", "gy", "gz")}), 1.0)
    assert not cube(small, "gx").any()
    ball = volumes.project_ball(volumes.gradient(df), 0.5)
    size = np.sqrt(sum(cube(ball, g) ** 2 for g in ("gx", "gy", "gz")))
    assert size.max() <= 0.5 + 1e-9 and not cube(volumes.project_ball(volumes.gradient(df), 0), "gy").any()


def test_block_mean_resize_and_planes(spark):
    a = np.arange(64.0).reshape(4, 4, 4)
    df = table(spark, a)
    assert np.allclose(cube(volumes.block_mean(df, 2)), a.reshape(2, 2, 2, 2, 2, 2).mean((1, 3, 5)))
    with pytest.raises(Exception, match="divide"):
        volumes.block_mean(table(spark, np.zeros((3, 3, 3))), 2).collect()
    want = np.zeros((5, 3, 6))
    want[:4, :, :4] = a[:, :3]
    assert np.allclose(cube(volumes.resize(df, 5, 3, 6)), want)
    assert np.allclose(volumes.axial(df).first()["data"], a[2].reshape(-1)) and volumes.axial(df, 99).first()["z"] == 3
    assert np.allclose(volumes.across(df, "coronal", 1).first()["data"], a[:, 1].reshape(-1))
    assert np.allclose(volumes.across(df, "sagittal").first()["data"], a[:, :, 2].reshape(-1))
    with pytest.raises(ValueError):
        volumes.across(df, "oblique")
    back = volumes.from_voxels(volumes.voxels(df), 4, 4)
    assert np.allclose(cube(back), a)


def test_slabs_and_smoothing(spark, x):
    assert kernels.slabs(10, 4, 1) == [(0, 4), (3, 7), (6, 10)] and kernels.slabs(3, 96, 12) == [(0, 3)] and kernels.slabs(5, 4, 3) == [(0, 4), (1, 5)]
    total, count = np.zeros(x.shape), np.zeros(4)
    for a, b in kernels.slabs(4, 3, 1):
        total[a:b] += kernels.tv_denoise(x[a:b], 0.1, 1e-2, 5)
        count[a:b] += 1
    got = volumes.tv_denoise(table(spark, x), 4, 0.1, 1e-2, 5, slab=3, overlap=1)
    assert np.allclose(cube(got), total / count[:, None, None], atol=1e-5)
    assert np.allclose(cube(volumes.smooth(table(spark, x), 4, 0.6, slab=2)), kernels.gaussian(x, 0.6), atol=1e-5)


def test_masks_noise_and_confidence():
    a = np.zeros((8, 8, 8))
    a[2:6, 2:6, 2:6] = 1
    m = kernels.support_mask(a, 0.2, 1)
    assert m[2:6, 2:6, 2:6].all() and not m[0].any() and kernels.support_mask(np.zeros((3, 3, 3)), 1, 1).all()
    assert kernels.mad(np.array([1, 2, 3, np.nan])) == pytest.approx(1.4826) and kernels.mad(np.array([np.nan])) == 0
    c = kernels.confidence(np.abs(a), np.zeros_like(a), m, 0.35, 0.5, 0.05, 1.0)
    assert c.min() >= 0.05 and c.max() <= 1.0
    hole = np.ones((5, 5), bool)
    hole[2, 2] = False
    assert kernels.close(hole)[2, 2]


def test_percentiles(spark, x):
    assert np.allclose(volumes.percentiles(table(spark, x), [0.05, 0.5]).first()["p"], np.percentile(x, [5, 50]))
