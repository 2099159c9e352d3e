"""Saved stages, coarser runs, number formats, shift tables, nested folders, supports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import scalars
from voxelmill.functions.geometry import Geometry
from voxelmill.operators import kernels
from voxelmill.plans import iterative, metadata, preprocess
from voxelmill.sources import resume, sinks, tables, tiff


def volume(spark, value, nz=2):
    return spark.createDataFrame([(z, [float(value)] * 4) for z in range(nz)], "z int, data array<float>")


def test_required_and_optional_volumes(spark, tmp_path):
    path = str(tmp_path / "v")
    assert resume.optional_volume(spark, path) is None
    with pytest.raises(FileNotFoundError):
        resume.required_volume(spark, path)
    (tmp_path / "v").mkdir()  # begun, not whole
    assert resume.optional_volume(spark, path) is None
    sinks.write_volume(volume(spark, 2), path)
    assert resume.required_volume(spark, path).count() == 2


def test_saved_stages(spark, tmp_path):
    run = str(tmp_path / "run")
    assert resume.saved_sweep(spark, run) is None and resume.saved_prior(spark, run) is None and resume.saved_final(spark, run) is None
    with pytest.raises(FileNotFoundError):
        resume.saved_prior(spark, run, required=True)
    sinks.write_volume(volume(spark, 1), f"{run}/fast_recon/fdk_sweep/fdk_best")
    assert (resume.saved_sweep(spark, run).filter, resume.saved_sweep(spark, run).cutoff) == ("unknown", 1.0)
    sinks.write_text(spark, f"{run}/fast_recon/fdk_sweep/best_filter.yaml", "best_filter: hann\nbest_cutoff: 0.8\n")
    assert (resume.saved_sweep(spark, f"{run}/fast_recon").filter, resume.saved_sweep(spark, run).cutoff) == ("hann", 0.8)
    sinks.write_volume(volume(spark, 3), f"{run}/fast_recon/prior/prior_selected")
    assert resume.saved_prior(spark, run) is None  # no confidence
    sinks.write_volume(volume(spark, 0.5), f"{run}/fast_recon/prior/prior_confidence")
    prior = resume.saved_prior(spark, run)
    assert {v for r in prior.support.collect() for v in r["data"]} == {1.0}
    sinks.write_volume(volume(spark, 0), f"{run}/fast_recon/prior/support_mask")
    assert {v for r in resume.saved_prior(spark, run).support.collect() for v in r["data"]} == {0.0}
    fdk = volume(spark, 9)
    assert resume.first_volume(spark, run, prior.volume, fdk)[1] == "fdk" and resume.first_volume(spark, run, prior.volume)[1] == "prior"
    with pytest.raises(FileNotFoundError):
        resume.first_volume(spark, run, prior.volume, fdk, resume=True)
    sinks.write_volume(volume(spark, 4, 3), f"{run}/fast_recon/mbir_lite/mbir_lite_final")
    with pytest.raises(ValueError):
        resume.first_volume(spark, run, prior.volume, fdk, resume=True)
    sinks.write_volume(volume(spark, 4), f"{run}/fast_recon/mbir_lite/mbir_lite_final")
    assert resume.first_volume(spark, run, prior.volume, fdk, resume=True)[1] == "final"


def test_coarser_runs(spark, tmp_path):
    rows = [(f"p{k}.tif", str(10.0 * k), str(4.0 * k), str(2.0 * k)) for k in range(5)]
    for name, *_ in rows:
        (tmp_path / name).write_bytes(b"")
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_index long, filename string, angle_deg string, x string, y string")
    v = metadata.validate(spark, frame, str(tmp_path), angle="angle_deg", x_shift="x", y_shift="y")
    out = metadata.coarser_views(v, (2, 4), 2)
    assert [(r["view_idx"], r["x_shift_px"], r["y_shift_px"]) for r in out.views.collect()] == [(0, 0.0, 0.0), (2, 2.0, 2.0), (4, 4.0, 4.0)]
    assert (out.summary["views"], out.summary["angle_max_deg"], v.summary["views"]) == (3, 40.0, 5)
    last = metadata.every_nth(v, 4).summary
    assert (last["views"], last["angle_min_deg"], last["angle_max_deg"]) == (2, 0.0, 40.0)
    assert metadata.every_nth(v, 3).summary["angle_max_deg"] == 30.0
    p = preprocess.coarser(preprocess.Preprocessing(binning=(2, 1), crop=(3, 4, 5, 0)), 2, 3)
    assert p.binning == (4, 3) and p.crop == (2, 2, 2, 0)
    g = Geometry(200.0, 100.0, (100, 300), (0.02, 0.02), (100, 200, 300), (0.01, 0.01, 0.01), detector_offset_px=(4.0, 6.0), centre_offset_px=3.0).coarser(2, 3, (50, 100))
    assert g.detector_pixel == pytest.approx((0.04, 0.06)) and g.volume_voxels == (50, 66, 100) and g.voxel == pytest.approx((0.02, 0.03, 0.03))
    assert g.detector_offset_px == (2.0, 2.0) and g.centre_offset_px == 1.0 and g.detector_pixels == (50, 100)


@pytest.mark.parametrize("digits", [6, 8, 10])
def test_general_numbers(spark, digits):
    values = [0.0, -0.0, 1.0, -1.5, 100.0, 123456.0, 1234567.0, 0.0001, 0.00001234, 99999.75, 999999.5, 1e-300, 1e300, 1 / 3, -2 / 3, 1e10, 123456789.123, math.pi * 1e-5, 12.5e20, math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r[0] for r in df.select(scalars.general_number(F.col("v"), digits)).collect()]
    assert got == [f"%.{digits}g" % v for v in values] + [None]


def test_shift_table_round_trip(spark, tmp_path):
    views = spark.createDataFrame([(2, 0.25, -1.0), (0, 1.5, 2.0), (1, -0.5, 0.0)], "view_idx int, x_shift_px double, y_shift_px double")
    sinks.write_shifts(views, str(tmp_path / "s"))
    back = tables.read_shifts(spark, tables.find_csv(spark, str(tmp_path / "s"))).orderBy("row_index").collect()
    assert [(r["x_shift_px"], r["y_shift_px"]) for r in back] == [(1.5, 2.0), (-0.5, 0.0), (0.25, -1.0)]


def test_nested_projection_folders(spark, tmp_path):
    for k, name in enumerate(["a/p0.tif", "b/p0.tif", "p2.tif"]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(tiff.encode(np.full((2, 3), float(k), np.float32)))
    views = spark.createDataFrame([(0, "b/p0.tif"), (1, "a/p0.tif"), (2, "p2.tif")], "view_idx int, filename string")
    got = tiff.read_stack(spark, views, str(tmp_path)).orderBy("view_idx").collect()
    assert [r["data"][0] for r in got] == [1.0, 0.0, 2.0]
    with pytest.raises(FileNotFoundError):
        tiff.read_stack(spark, views.union(spark.createDataFrame([(3, "c/p9.tif")], views.schema)), str(tmp_path))
    flat = tiff.read_stack(spark, views.where("view_idx = 2"), str(tmp_path)).collect()
    assert len(flat) == 1 and flat[0]["data"][0] == 2.0


def test_support_takes_its_threshold_from_the_input():
    x = np.random.default_rng(0).normal(size=(12, 12, 12))
    x[4:8, 4:8, 4:8] += 3
    low, high = np.percentile(x, [5, 95])
    want = kernels.dilate(kernels.close(kernels.gaussian(x, 2) > low + 0.02 * (high - low)), 1)
    assert (kernels.support_mask(x, 2, 1) == want).all()
    holed = x.copy()
    holed[0, 0, 0] = np.nan
    low, high = np.percentile(holed[np.isfinite(holed)], [5, 95])
    want = kernels.close(kernels.gaussian(np.nan_to_num(holed), 1) > low + 0.02 * (high - low))
    assert (kernels.support_mask(holed, 1, 0) == want).all() and not want.all()
    assert kernels.support_mask(np.full((3, 3, 3), np.nan), 1, 1).all()


def test_solvers_of_every_volume(spark, tmp_path):
    rng = np.random.default_rng(4)
    volumes = {k: rng.normal(size=64).astype(np.float32) for k in (0, 5, 700)}
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in volumes.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["volume_id"], r["solver"], r["iteration"]): r["objective"] for r in iterative.solver_metrics(spark, str(tmp_path)).collect()}
    want = {(k, r.solver, r.iteration): r.objective for k, v in volumes.items() for s in iterative.solve_volume(np.abs(v.astype(float)).reshape(4, 4, 4)) for r in s.rows}
    assert got.keys() == want.keys() and all(np.isclose(got[k], v) for k, v in want.items())
