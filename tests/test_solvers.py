import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import geometry
from voxelmill.functions.geometry import Geometry
from voxelmill.operators import kernels, linear, solvers
from voxelmill.plans import fast

G = Geometry(200.0, 100.0, (4, 12), (2.0, 2.0), (4, 10, 10), (1.0, 1.0, 1.0), invert_angles=False)


def phantom(n=6):
    x = np.zeros((n, n, n))
    x[2:4, 2:4, 2:4] = 1.0
    return x


def test_conjugate_gradient(spark):
    d, b = np.array([2.0, 4.0, 8.0, 16.0]), np.array([2.0, -8.0, 24.0, -64.0])
    x, left, n = solvers.conjugate_gradient(lambda v: d * v, b, np.zeros(4), 20, 1e-8)
    assert np.allclose(x, [1, -2, 3, -4], atol=1e-5) and left <= 1e-8 and n <= 5
    assert solvers.conjugate_gradient(lambda v: d * v, b, x, 20, 1e-6)[2] == 0
    from voxelmill.session import checkpoint_folder

    checkpoint_folder(spark)
    m = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(d)], "i long, j long, w double")
    got, left, _ = solvers.conjugate_gradient_tables(m, spark.createDataFrame(list(enumerate(b.tolist())), "i long, value double"), 20, 1e-8)
    assert np.allclose([r["value"] for r in got.orderBy("i").collect()], [1, -2, 3, -4], atol=1e-5) and left <= 1e-8


@pytest.mark.parametrize("solve", [lambda op, b, x: solvers.admm(op, b, x, 1e-3, 0.1, 15), lambda op, b, x: solvers.pdhg(op, b, x, 1e-3, 60), lambda op, b, x: solvers.subset_tv(op, b, x, 1e-4, 60, 2)])
def test_solvers_find_the_cube(solve):
    b = phantom()
    seen = []
    got = solve(linear.Identity(6), b, np.zeros_like(b))
    assert got.x.shape == b.shape and got.x.min() >= 0 and np.abs(got.x - b).max() < 0.1
    assert got.rows[-1].objective < got.rows[0].objective and not seen
    assert all(np.isfinite(r.relative_x_change) for r in got.rows)


def test_solvers_reach_the_same_optimum():
    b, x0 = phantom(), np.zeros((6, 6, 6))
    a = solvers.admm(linear.Identity(6), b, x0, 0.05, 0.5, 200, tolerances=(1e-7, 1e-7, 1e-8))
    p = solvers.pdhg(linear.Identity(6), b, x0, 0.05, 1500, tolerance=1e-9)
    assert np.abs(a.x - p.x).max() < 2e-3


def test_parameters_and_subsets():
    b = phantom()
    for lam, rho in ((-1, 1), (1, 0)):
        with pytest.raises(ValueError):
            solvers.admm(linear.Identity(6), b, b, lam, rho, 1)
    got = solvers.admm(linear.Identity(6), b, np.zeros_like(b), 0.0, 0.01, 4, subsets=lambda k: np.arange((k - 1) % 2, 6, 2))
    assert len(got.rows) == 4
    assert [v.tolist() for v in solvers.view_batches(5, 2, 2)] == [[0, 2], [4], [1, 3]]
    assert linear.subset_scale(12, 6, 2) == 6.0


def test_anchored_prior():
    b, prior = np.ones((3, 3, 3)), np.zeros((3, 3, 3))
    run = lambda trust: solvers.anchored(linear.Identity(3), b, prior, prior, np.full(b.shape, trust), lam=0.0, rho=1.0, sweeps=40, batch=3, subsets=1)
    assert 0.3 < run(1.0).x.mean() < 0.7 and run(0.0).x.mean() > 0.7
    with pytest.raises(ValueError):
        solvers.anchored(linear.Identity(3), b, prior, np.zeros((2, 3, 3)), b)
    qc = solvers.residual_of(linear.Identity(3), b, np.array([0, 1]))
    assert qc(b) == 0 and qc(prior) == 1 and np.isnan(solvers.residual_of(linear.Identity(3), b, np.array([], int))(b))


def test_rays():
    pixel, voxel, w = geometry.ray_weights(G, 0.0)
    centre = w[pixel == 1 * 12 + 5].sum()
    assert 9.9 < centre < 10.2  # ten voxels along the axis
    for angle in (0.3, 2.0, -1.1):
        p, v, w = geometry.ray_weights(G, angle)
        assert w.min() > 0 and v.max() < 400 and p.max() < 48
    with pytest.raises(ValueError):
        Geometry(1.0, 2.0, (1, 1), (1, 1), (1, 1, 1), (1, 1, 1))


def test_relation_and_projector_agree_and_are_adjoint(spark):
    angles = np.array([0.0, 0.7, 1.9])
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=G.volume_voxels), rng.normal(size=(3, *G.detector_pixels))
    op = linear.RayProjector(spark, G, angles)
    ax, aty = op.forward(x), op.backproject(y)
    assert abs((ax * y).sum() - (x * aty).sum()) < 1e-6 * abs((ax * y).sum())
    assert np.allclose(op.forward(x, np.array([2])), ax[2:]) and np.allclose(op.backproject(y[1:2], np.array([1])), linear.RayProjector(spark, G, angles[1:2]).backproject(y[1:2]))
    m = linear.system_matrix(spark.createDataFrame(list(enumerate(angles.tolist())), "view_idx long, angle_rad double"), G).cache()
    xs = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x.reshape(-1))], "voxel long, value double")
    ys = spark.createDataFrame([(k // 48, k % 48, float(v)) for k, v in enumerate(y.reshape(-1))], "view_idx long, pixel long, value double")
    f = np.zeros(144)
    for r in linear.forward(m, xs).collect():
        f[r["view_idx"] * 48 + r["pixel"]] = r["value"]
    assert np.allclose(f, ax.reshape(-1))
    t = np.zeros(400)
    for r in linear.backproject(m, ys).collect():
        t[r["voxel"]] = r["value"]
    assert np.allclose(t, aty.reshape(-1))
    grad = np.zeros(400)
    for r in linear.batch_gradient(m, xs, ys, F.col("view_idx") == 1, 3.0).collect():
        grad[r["voxel"]] = r["value"]
    assert np.allclose(grad, 3.0 * op.backproject(ax[1:2] - y[1:2], np.array([1])).reshape(-1))
    assert linear.normal(m, xs).count() == 400 - (aty.reshape(-1) == 0).sum()
    m.unpersist()
    with pytest.raises(ValueError):
        linear.RayProjector(spark, G, angles, max_broadcast=1).forward(x)


def test_low_resolution_and_binning():
    g = Geometry(200.0, 100.0, (100, 300), (0.02, 0.02), (100, 200, 300), (0.01, 0.01, 0.01))
    low = g.binned(2, 3, 2)
    assert low.detector_pixel == pytest.approx((0.04, 0.06)) and low.volume_voxels == (50, 100, 150) and low.detector_pixels == (50, 100)
    assert g.low_resolution(7) is g and g.low_resolution(2).voxel == pytest.approx((0.02,) * 3)
    r = geometry.resolve(200.0, 100.0, (4, 6), effective_um=11.0)
    assert r.detector_pixel == pytest.approx((0.022, 0.022)) and r.volume_voxels == (4, 6, 6)
    with pytest.raises(ValueError):
        geometry.resolve(200.0, 100.0, (4, 6))
    c = Geometry(200.0, 100.0, (4, 6), (2.0, 2.0), (1, 1, 1), (1, 1, 1), centre_offset_px=3.0)
    assert c.detector_offset == (0.0, 6.0) and c.image_shift == 0.0


def scan(spark, g, n, x):
    angles = np.linspace(0, 2 * np.pi, n, endpoint=False)
    y = linear.RayProjector(spark, g, angles).forward(x)
    rows = [(k, float(a), *g.detector_pixels, v.reshape(-1).tolist()) for k, (a, v) in enumerate(zip(angles, y, strict=True))]
    return spark.createDataFrame(rows, "view_idx long, angle_rad double, rows int, cols int, data array<float>")


@pytest.fixture(scope="module")
def scanned(spark):
    g = Geometry(400.0, 200.0, (16, 24), (2.0, 2.0), (16, 16, 16), (1.0, 1.0, 1.0), invert_angles=False)
    x = np.zeros(g.volume_voxels)
    x[5:11, 4:9, 6:12] = 1.0
    return g, x, scan(spark, g, 48, x).cache()


def test_fdk_recovers_a_block(spark, scanned):
    g, x, views = scanned
    got = np.zeros(g.volume_voxels)
    for r in linear.fdk(views, g, slab=5).collect():
        got[r["z"]] = np.array(r["data"]).reshape(16, 16)
    assert np.corrcoef(got.reshape(-1), x.reshape(-1))[0, 1] > 0.9 and 0.8 < got[7:9, 5:8, 7:11].mean() < 1.2
    assert {n: geometry.ramp_filter(32, 1.0, n)[-1] for n in geometry.FILTERS}["hann"] == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(ValueError):
        geometry.ramp_filter(32, 1.0, "none")


def test_starts(spark, scanned):
    g, x, views = scanned
    assert not linear.initial_volume("zeros", g).any() and linear.initial_volume("constant", g, constant=2.0).mean() == 2.0
    assert np.allclose(linear.initial_volume("existing", g, existing=np.repeat(np.repeat(np.repeat(x, 2, 0), 2, 1), 2, 2)), x)
    assert linear.initial_volume("existing", g, existing=np.ones((5, 5, 5))).mean() == pytest.approx(1.0)
    assert linear.initial_volume("fdk", g, views).max() > 0.5


def test_sweep_selects_and_obeys(spark, scanned):
    g, x, views = scanned
    tune = views.where("view_idx % 12 = 3")
    scores, winner, volume = fast.filter_sweep(spark, views, tune, g, ["hann", "ram_lak"], [1.0, 0.8])
    assert scores.count() == 2 and winner in ("hann", "ram_lak") and volume.shape == g.volume_voxels
    _, manual, _ = fast.filter_sweep(spark, views, None, g, ["ram_lak"], manual=" Hann ")
    assert manual == "hann"
    shape = lambda v, geo, name: np.full(geo.volume_voxels, 1.0 if name == "ram_lak" else 3.0)
    flat = lambda geo, a: type("Op", (), {"forward": lambda self, v: np.full((len(a), *geo.detector_pixels), v.mean())})()
    ones = views.withColumn("data", F.transform("data", lambda _: F.lit(1.0).cast("float")))
    assert fast.filter_sweep(spark, ones, ones.where("view_idx = 1"), g, ["hann", "ram_lak"], reconstruct=shape, projector=flat)[1] == "ram_lak"


def test_prior_and_quality(spark):
    x = np.zeros((6, 6, 6))
    x[2:4, 2:4, 2:4] = 1.0
    x[3, 3, 3] = 1.5
    prior, trust, scores = fast.prior_candidates(spark, x, lambda _: float("nan"), tv_weights=(0.005, 0.02), sigma=0.5, dilation=1, iterations=5, slab=4, overlap=2, confidence=(0.35, 0.5, 0.2, 1.0))
    rows = scores.orderBy("candidate").collect()
    assert np.isfinite(prior).all() and prior.shape == x.shape and trust.min() >= 0.2 - 1e-6 and trust.max() <= 1.0
    assert [r["residual_ratio"] for r in rows] == [1.0, 1.0] and sum(r["chosen"] for r in rows) == 1
    op = linear.Identity(6)
    qc = fast.qc_table(spark, {"fdk": x, "final": 0 * x}, {"tune": (op, x, None), "qc": (op, x, np.ones(6))})
    from voxelmill.operators.stats import qc_pivot

    assert [tuple(r) for r in qc_pivot(qc).collect()] == [("fdk", 0.0, 0.0), ("final", 1.0, 1.0)]


def test_stack(spark):
    make = lambda n, a, w: spark.createDataFrame([(k, a + 0.1 * k, 1, 2, [float(k), 1.0], w, s) for k, s in zip(range(n), ["recon", "tune", "qc", "unused"], strict=False)], "view_idx long, angle_rad double, rows int, cols int, data array<float>, weight double, split string")
    main, anchors = make(3, 1.0, 1.0), make(4, 1.0, 3.0)
    got = fast.build_stack(main, anchors).orderBy("view_idx").collect()
    assert [round(r["angle_rad"], 6) for r in got] == [1.0, 1.1, 1.2] and [r["view_idx"] for r in got] == [0, 1, 2]
    assert got[0]["weight"] == pytest.approx(10**0.5) and got[2]["weight"] == pytest.approx(1.0)
    assert fast.build_stack(main, anchors, combine=False).count() == 5 and "weight" not in fast.build_stack(main.drop("weight"), anchors).columns
    w = fast.anchor_weights(main.withColumns({"dataset": F.lit("main"), "mean_raw": F.lit(4.0)}).unionByName(anchors.withColumns({"dataset": F.lit("anchor"), "mean_raw": F.lit(400.0)})).drop("weight"))
    assert {(r["dataset"], round(r["weight"], 5)) for r in w.collect()} == {("main", 1.0), ("anchor", 10.0)}


def test_centre_search(spark):
    from dataclasses import replace

    g = Geometry(400.0, 200.0, (4, 80), (1.0, 1.0), (4, 32, 32), (1.0, 1.0, 1.0), invert_angles=False)
    x = np.zeros(g.volume_voxels)
    x[:, 8:18, 10:24], x[:, 12:14, 14:18] = 1.0, 2.0
    views = scan(spark, replace(g, centre_offset_px=3.0), 60, x)
    table, best = fast.centre_search(views, g, [-6.0, -3.0, 0.0, 3.0, 6.0], metric="entropy")
    assert table.count() == 5 and best == 3.0 and table.where("combined_score BETWEEN 0 AND 1").count() == 5


def test_memory_model():
    # 400 views of 1024 x 1024, a volume of 1024 cubed
    args = (400, (1024, 1024), (1024,) * 3)
    assert fast.call_memory(*args, batch=1) == pytest.approx(5.65) and fast.call_memory(*args) == pytest.approx(8.525)
    assert fast.recommended_batch(*args, free_gib=7.77) == 1 and fast.recommended_batch(*args, free_gib=24.0) > 64
    assert fast.solver_choice(*args, 200, 100) == "admm" and fast.solver_choice(*args, 60, 30) == "pdhg" and fast.solver_choice(*args, 20, 10) == "subset_tv"
    with pytest.raises(MemoryError):
        fast.solver_choice(*args, 8, 8)
