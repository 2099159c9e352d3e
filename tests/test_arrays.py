import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from voxelmill.operators import arrays, kernels, stats
from voxelmill.plans.preprocess import Preprocessing, preprocess, projection_range

VIEWS = "view_idx long, angle_rad double, rows int, cols int, data array<float>, x_shift_px float, y_shift_px float"


def views(spark, stack, shifts=None):
    shifts = shifts or [(None, None)] * len(stack)
    rows = [(k, 0.1 * k, a.shape[0], a.shape[1], [float(v) for v in a.reshape(-1)], *s) for k, (a, s) in enumerate(zip(stack, shifts, strict=True))]
    return spark.createDataFrame(rows, VIEWS)


def images(df, column="data"):
    return [np.array(r[column]).reshape(r["rows"], r["cols"]) for r in df.orderBy("view_idx").collect()]


def test_block_mean_of_a_stack(spark):
    stack = [np.arange(16.0).reshape(4, 4) + k for k in range(5)]
    df = views(spark, stack).withColumn("data", arrays.block_mean(F.col("data"), F.col("rows"), F.col("cols"), 2, 2)).withColumns({"rows": F.lit(2), "cols": F.lit(2)})
    for k, got in enumerate(images(df)):
        assert np.allclose(got, np.array([[2.5, 4.5], [10.5, 12.5]]) + k) and np.allclose(got, kernels.block_mean(stack[k], (2, 2)))
    with pytest.raises(Exception, match="leave nothing"):
        views(spark, stack).select(arrays.block_mean(F.col("data"), F.col("rows"), F.col("cols"), 5, 1)).collect()
    with pytest.raises(ValueError):
        kernels.block_mean(stack[0], (5, 1))
    with pytest.raises(ValueError):
        kernels.crop(stack[0], 2, 2, 0, 0)


def test_mean_field(spark):
    df = views(spark, [np.full((2, 3), float(k)) for k in range(1, 6)])
    row = stats.mean_field(df).first()
    assert row["data"] == [3.0] * 6 and row["count"] == 5


@pytest.mark.parametrize("raw,flat,dark", [(10, 20, None), (12, 22, 2)])
def test_flat_and_dark(spark, raw, flat, dark):
    df = views(spark, [np.full((4, 4), float(raw))] * 2)
    make = lambda v: views(spark, [np.full((4, 4), float(v))])
    out = images(preprocess(df, Preprocessing(use_drift=False), make(flat), None if dark is None else make(dark)))
    assert np.allclose(out, -np.log(0.5))
    d = None if dark is None else F.array([F.lit(float(dark))] * 16)
    t = df.select(arrays.attenuation(arrays.flat_dark(F.col("data"), F.array([F.lit(float(flat))] * 16), d)).alias("a")).first()["a"]
    assert np.allclose(t, -np.log(0.5))


def test_without_flat_the_dark_field_is_not_used(spark):
    df = views(spark, [np.full((2, 2), 0.25)])
    c = Preprocessing(negative_log=False, clip_transmission=False, clip_negative_attenuation_to_zero=False)
    assert np.allclose(images(preprocess(df, c, None, views(spark, [np.ones((2, 2))]))), 0.25)
    assert df.select(arrays.flat_dark(F.col("data"), None, F.array([F.lit(1.0)] * 4), limits=(0.3, 2.0)).alias("t")).first()["t"] == pytest.approx([0.3] * 4)


def test_flips_transpose_and_order(spark):
    a = np.arange(12.0).reshape(3, 4)
    c = Preprocessing(negative_log=False, clip_transmission=False, flip_horizontal=True, flip_vertical=True, transpose=True, crop=(1, 0, 0, 1))
    assert np.allclose(images(preprocess(views(spark, [a]), c))[0], a[1:, :3][::-1, ::-1].T)


@pytest.mark.parametrize("stage", ["transmission", "attenuation"])
def test_shifts_move_rows_by_y_and_columns_by_x(spark, stage):
    a = np.zeros((6, 6))
    a[2:4, 2:4] = 1.0
    shifts = [(0.0, 0.0), (1.0, -1.0), (0.5, 0.0), (None, 1.0)]
    c = Preprocessing(negative_log=False, clip_transmission=False, drift_stage=stage, y_shift_sign=-1)
    got = images(preprocess(views(spark, [a] * 4, shifts), c))
    assert np.allclose(got[0], a) and np.allclose(got[3], a)
    assert np.allclose(got[1], np.roll(a, (1, 1), (0, 1)))
    assert np.allclose(got[2][2], [0, 0, 0.5, 1, 0.5, 0])
    other = views(spark, [a] * 3, shifts[:3]).withColumn("data", arrays.shift(F.col("data"), F.col("rows"), F.col("cols"), -F.col("y_shift_px"), F.col("x_shift_px")))
    assert all(np.allclose(x, y) for x, y in zip(images(other), got, strict=False))
    with pytest.raises(ValueError):
        Preprocessing(x_shift_sign=2)


@pytest.mark.parametrize("mode", ["nearest", "wrap", "reflect", "mirror", "constant"])
@pytest.mark.parametrize("order", [0, 1])
def test_whole_shifts_in_every_mode(mode, order):
    """Higher orders smooth, as there is no filter before: tests/test_slices.py."""
    a = np.random.default_rng(0).normal(size=(5, 6)).astype(np.float32)
    pad = {"nearest": "edge", "wrap": "wrap", "reflect": "symmetric", "mirror": "reflect", "constant": "constant"}[mode]
    want = np.pad(a, 2, mode=pad)[2 - 1 : 2 - 1 + 5, 2 + 2 : 2 + 2 + 6]
    assert np.allclose(kernels.shift_image(a, 1, -2, order, mode), want, atol=1e-6)


def test_truncation_padding(spark):
    a = np.arange(1.0, 21.0).reshape(2, 10)
    want = np.pad(a, ((0, 0), (3, 3)), mode="symmetric")
    want[:, :3] *= [0, 0.5, 1]
    want[:, -3:] *= [1, 0.5, 0]
    assert np.allclose(kernels.truncation_pad(a, 0.3), want)
    got = views(spark, [a]).select(arrays.truncation_pad(F.col("data"), F.col("rows"), F.col("cols"), 0.3).alias("d")).first()["d"]
    assert np.allclose(np.array(got).reshape(2, 16), want)
    for f in (0.0, 0.01):
        with pytest.raises(ValueError):
            kernels.truncation_pad(a, f)


def test_shape_mismatch_and_range(spark):
    with pytest.raises(PythonException):
        preprocess(views(spark, [np.ones((2, 2))]), Preprocessing(), views(spark, [np.ones((3, 2))])).collect()
    with pytest.raises(ValueError):
        preprocess(views(spark, [np.ones((2, 2))]), Preprocessing(), views(spark, [np.ones((3, 2)), np.ones((2, 2))]))
    assert tuple(projection_range(views(spark, [np.array([[1.0, np.nan]]), np.array([[-2.0, 5.0]])])).first()) == (-2.0, 5.0)


def test_focus_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 1, (7, 9))
    a[0, 0] = 1.0
    df = views(spark, [a]).withColumn("data", F.col("data").cast("array<double>"))
    x = np.array(df.first()["data"]).reshape(7, 9)
    gy, gx = np.gradient(x)
    lap = np.zeros_like(x)
    lap[1:-1, 1:-1] = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    p = np.histogram(x, 256, (0, 1))[0] / x.size
    p = p[p > 0]
    got = df.select(stats.gradient_energy(F.col("data"), 7, 9), stats.laplacian_variance(F.col("data"), 7, 9), stats.shannon_entropy(F.col("data"))).first()
    assert np.allclose(tuple(got), [np.mean(gx**2 + gy**2), lap.var(), -(p * np.log(p + 1e-12)).sum()])
    ready = df.select(arrays.metric_image(F.col("data"), F.col("rows"), F.col("cols"), 0.2).alias("m")).first()["m"]
    inner = x[1:-1, 1:-1]
    lo, hi = np.percentile(inner, [1, 99])
    assert np.allclose(ready, ((np.clip(inner, lo, hi) - lo) / (hi - lo)).reshape(-1))


def test_non_finite_and_pixel_weights(spark):
    df = spark.createDataFrame([([1.0, float("nan"), float("inf"), None], [2.0, 1.0, 1.0, 1.0])], "data array<float>, w array<float>")
    got = df.select(arrays.replace_non_finite(F.col("data")).alias("a"), arrays.scale(F.array(F.lit(2.0)), F.lit(3.0), True).alias("b"), arrays.scale_pixels(F.array(F.lit(2.0)), F.array(F.lit(3.0)), True).alias("c")).first()
    assert got["a"] == [1.0, 0.0, 0.0, 0.0] and got["b"] == [18.0] and got["c"] == [18.0]


def test_phase_shift_and_ssim():
    rng = np.random.default_rng(2)
    a = kernels.gaussian(rng.normal(size=(32, 32)), 2)
    rows, cols = kernels.phase_shift(np.roll(a, (3, -2), (0, 1)), a)
    assert abs(rows - 3) < 0.2 and abs(cols + 2) < 0.2
    assert kernels.ssim(a, a) == pytest.approx(1.0) and kernels.ssim(a, rng.normal(size=(32, 32))) < 0.5


def test_drift_estimate(spark):
    from voxelmill.plans.preprocess import estimate_drift

    a = kernels.gaussian(np.random.default_rng(3).normal(size=(24, 24)), 1.5)
    df = views(spark, [np.roll(a, (-dy, -dx), (0, 1)) for dx, dy in ((0, 0), (2, -1), (-3, 4))])
    got = estimate_drift(df).orderBy("view_idx").collect()
    assert np.allclose([(r["x_shift_px"], r["y_shift_px"]) for r in got], [(0, 0), (2, -1), (-3, 4)], atol=0.2)
    assert np.allclose([r["x_shift_px"] for r in estimate_drift(df, 3).orderBy("view_idx").collect()], [0, 0, -3], atol=0.2)
