import math

import numpy as np
import pytest

from voxelmill.plans import metadata
from voxelmill.sources import tables


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "img").mkdir()
    for k in range(4):
        (tmp_path / "img" / f"p{k}.tif").write_bytes(b"x")
    return tmp_path


def frame(spark, folder, text, name="geometry.csv"):
    (folder / name).write_text(text)
    return tables.read_csv(spark, str(folder / name))


def check(spark, folder, text, **more):
    return metadata.validate(spark, frame(spark, folder, text), str(folder / "img"), **more)


def test_find_csv(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.find_csv(spark, str(tmp_path / "no"))
    with pytest.raises(FileNotFoundError):
        tables.find_csv(spark, str(tmp_path))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "z.csv").write_text("a\n1\n")
    assert tables.find_csv(spark, str(tmp_path)).endswith("deep/z.csv")
    (tmp_path / "b.csv").write_text("a\n1\n")
    (tmp_path / "c.csv").write_text("a\n1\n")
    assert tables.find_csv(spark, str(tmp_path)).endswith("b.csv")
    (tmp_path / "projection_geometry.csv").write_text("a\n1\n")
    assert tables.find_csv(spark, str(tmp_path)).endswith("projection_geometry.csv")
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "empty.csv"))


def test_columns():
    assert tables.match_column(["A", " Theta_Deg "], tables.ANGLE_HINTS) == " Theta_Deg "
    assert tables.match_column(["my_angle_x", "theta"], tables.ANGLE_HINTS) == "theta"
    assert tables.match_column(["x"], tables.ANGLE_HINTS) is None and tables.required_column(["x", "y"], tables.ANGLE_HINTS) == "x"
    with pytest.raises(ValueError):
        tables.aliased_column(["x"], tables.X_SHIFT_HINTS, "x shift")


def test_minimal(spark, folder):
    v = check(spark, folder, "filename,angle_deg\np0.tif,0.0\n")
    row = v.views.collect()
    assert len(row) == 1 and row[0]["exists"] and v.summary["direction"] == "single angle" and not v.summary["has_x"]
    v.check()


def test_paths_duplicates_and_missing(spark, folder):
    v = check(spark, folder, "filename,angle_deg\n sub/p1.tif ,0\np9.tif,10\np2.tif,20\np2.tif,30\n")
    rows = {r["view_idx"]: r for r in v.views.collect()}
    assert rows[0]["path"] == "p1.tif" and rows[0]["exists"] and not rows[1]["exists"] and rows[1]["path"] == "p9.tif"
    assert [r[0] for r in v.duplicates.collect()] == ["p2.tif"] and [r[0] for r in v.missing.collect()] == ["p9.tif"]
    with pytest.raises(ValueError, match="duplicate"):
        v.check()


@pytest.mark.parametrize("text", ["filename,angle_deg\n,0\n", "filename,angle_deg\np0.tif,x\n", "filename,angle_deg,angle_rad\np0.tif,0,0\np1.tif,1,\n", "filename,angle_deg,x_shift_px\np0.tif,0,1\np1.tif,1,q\n"])
def test_errors(spark, folder, text):
    with pytest.raises(ValueError):
        check(spark, folder, text, angle_rad="angle_rad", x_shift="x_shift_px")


def test_missing_columns_and_folder(spark, folder):
    df = frame(spark, folder, "filename,angle_deg\np0.tif,0\n")
    for more in ({"filename": "no"}, {"angle": "no"}):
        with pytest.raises(ValueError):
            metadata.validate(spark, df, str(folder / "img"), **more)
    with pytest.raises(FileNotFoundError):
        metadata.validate(spark, df, str(folder / "none"))


def test_radians_shifts_and_warnings(spark, folder):
    v = check(spark, folder, "filename,angle_deg,angle_rad,x_shift_px,y_shift_px\np0.tif,0,1.5,1,\np1.tif,10,1.6,2,\n", angle_rad="angle_rad", x_shift="x_shift_px", y_shift="y_shift_px")
    rows = v.views.collect()
    assert [r["angle_deg"] for r in rows] == [0.0, 10.0] and np.allclose([r["angle_rad"] for r in rows], [1.5, 1.6])
    assert v.summary["has_x"] and v.summary["x_found"] and v.summary["y_found"] and not v.summary["has_y"]
    assert any("y shift" in w for w in v.warnings) and rows[0]["y_shift_px"] is None
    w = check(spark, folder, "filename,angle_deg,angle_rad\np0.tif,90,\n", angle_rad="angle_rad", x_shift="nope")
    assert math.isclose(w.views.first()["angle_rad"], math.pi / 2, rel_tol=1e-6) and len(w.warnings) == 2


def test_endpoint_reverse_and_stride(spark, folder):
    text = "filename,angle_deg\np0.tif,0\np1.tif,120\np2.tif,240\np3.tif,360\n"
    v = check(spark, folder, text, reverse=True)
    assert v.summary["endpoint_removed"] and [r["view_idx"] for r in v.views.collect()] == [2, 1, 0] and v.summary["direction"] == "descending"
    kept = check(spark, folder, text, remove_endpoint=False)
    assert kept.summary["endpoint_detected"] and kept.views.count() == 4
    assert [r["view_idx"] for r in metadata.every_nth(kept, 2).views.collect()] == [0, 2]
    assert kept.preview().count() == 4


def test_shift_tables(spark, folder):
    (folder / "d.csv").write_text("shift_x,row_shift_px\n1,-1\n2,-2\n3,-3\n4,-4\n")
    shifts = tables.read_shifts(spark, str(folder / "d.csv"))
    v = check(spark, folder, "filename,angle_deg\np0.tif,0\np1.tif,120\np2.tif,240\np3.tif,360\n")
    got = metadata.apply_shifts(v, shifts)
    assert [(r["x_shift_px"], r["y_shift_px"]) for r in got.views.collect()] == [(1, -1), (2, -2), (3, -3)]
    with pytest.raises(ValueError):
        metadata.apply_shifts(check(spark, folder, "filename,angle_deg\np0.tif,0\n"), shifts)
    (folder / "bad.csv").write_text("shift_x,shift_y\n1,\n")
    with pytest.raises(ValueError):
        tables.read_shifts(spark, str(folder / "bad.csv"))
    with pytest.raises(ValueError):
        tables.read_shifts(spark, str(folder / "d.csv"), "no", "row_shift_px")


def test_telemetry(spark):
    lines = ["0, gpu a, 50, 10, 1024, 2048, 60, 100.5", "1,b,N/A,[Not Supported],512,1024,,unknown", "short,1", "x,b,1,1,1,1,1,1", ""]
    got = tables.parse_telemetry(spark.createDataFrame([(x,) for x in lines], "line string")).orderBy("gpu_id").collect()
    assert len(got) == 2 and got[0]["memory_used_gb"] == 1.0 and got[0]["memory_percent"] == 50.0 and got[0]["power_w"] == 100.5
    assert got[1]["utilization_gpu_pct"] is None and got[1]["utilization_memory_pct"] is None and got[1]["temperature_c"] is None and got[1]["power_w"] is None and got[1]["memory_percent"] == 50.0
    gpus = tables.parse_inventory(spark.createDataFrame([("0, a, 8192, 4096",), ("1, b, 1024, 512",), ("bad",)], "line string"))
    from voxelmill.operators.stats import gpu_totals

    assert tuple(gpu_totals(gpus).first()) == (2, 0.5, 1.0, 4.5, 9.0) and gpu_totals(gpus, [0]).first()["n"] == 1


def test_small_sources(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("filter: hann\nnote: a: b\nno line\nfilter: ram_lak\n")
    assert {r["key"]: r["value"] for r in tables.key_values(spark, str(tmp_path / "m.yaml")).collect()} == {"filter": "ram_lak", "note": "a: b"}
    cache = tables.CachedCsv(spark)
    assert cache.read(str(tmp_path / "c.csv")) is None
    (tmp_path / "c.csv").write_text("a\n1\n")
    first = cache.read(str(tmp_path / "c.csv"))
    assert cache.read(str(tmp_path / "c.csv")) is first
    (tmp_path / "c.csv").write_text("a\n1\n22\n")
    assert cache.read(str(tmp_path / "c.csv")).count() == 2
    (tmp_path / "a.txt").write_text("0\n90, 180\n")
    assert np.allclose([r["angle_rad"] for r in tables.angles(spark, path=str(tmp_path / "a.txt"), clockwise=True).orderBy("view_idx").collect()], [0, -np.pi / 2, -np.pi])
    assert np.allclose([r["angle_rad"] for r in tables.angles(spark, 4).orderBy("view_idx").collect()], np.arange(4) * np.pi / 2)


def test_config_round_trip(monkeypatch):
    from voxelmill.plans.preprocess import Preprocessing

    made = tables.load_config(Preprocessing, "epsilon: 0.5\nbinning: [2, 4]\nunknown: 1\nflip_vertical: true\nshift_mode: wrap # note\n")
    assert made.epsilon == 0.5 and made.binning == (2, 4) and made.flip_vertical and made.shift_mode == "wrap" and made.crop == (0, 0, 0, 0)
    text = tables.dump_config(made)
    assert tables.load_config(Preprocessing, text) == made
    assert tables._fill(Preprocessing, tables._plain_yaml(text)) == made
    assert tables._plain_yaml("a:\n  b: [1, x]\n  c: 'q'\nd: 2.5\n# no\n") == {"a": {"b": [1, "x"], "c": "q"}, "d": 2.5}
