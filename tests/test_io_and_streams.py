import struct
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import scalars
from voxelmill.operators import select
from voxelmill.sources import sinks, tables, tiff
from voxelmill.streaming import monitors


def tiff_bytes(a, order="<", compression=1, strips=2, predictor=1):
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    rows = [-(-a.shape[0] // strips) * k for k in range(strips)]
    parts = []
    for r in rows:
        part = a[r : r + -(-a.shape[0] // strips)]
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
        raw = part.astype(a.dtype.newbyteorder(order)).tobytes()
        parts.append(zlib.compress(raw) if compression == 8 else bytes([b for k in range(0, len(raw), 100) for b in [len(raw[k : k + 100]) - 1, *raw[k : k + 100]]]) if compression == 32773 else raw)
    head = 8
    offsets = [head + sum(map(len, parts[:k])) for k in range(len(parts))]
    end = head + sum(map(len, parts))
    tags = [(256, 3, [a.shape[1]]), (257, 3, [a.shape[0]]), (258, 3, [a.dtype.itemsize * 8]), (259, 3, [compression]), (273, 4, offsets), (277, 3, [1]), (279, 4, [len(p) for p in parts]), (317, 3, [predictor]), (339, 3, [kind])]
    table, extra = b"", b""
    at = end + 2 + 12 * len(tags) + 4
    for t, k, v in tags:
        data = struct.pack(f"{order}{len(v)}{'H' if k == 3 else 'I'}", *v)
        if len(data) > 4:
            table += struct.pack(order + "HHII", t, k, len(v), at + len(extra))
            extra += data
        else:
            table += struct.pack(order + "HHI", t, k, len(v)) + data.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, end) + b"".join(parts) + struct.pack(order + "H", len(tags)) + table + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 8, 32773])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.int16, np.float32])
def test_tiff_decoding(order, compression, kind):
    a = (np.arange(35).reshape(5, 7) * 3).astype(kind)
    assert np.array_equal(tiff.decode(tiff_bytes(a, order, compression)), a.astype(np.float32))


def test_tiff_more():
    a = np.arange(12, dtype=np.uint16).reshape(3, 4)
    assert np.array_equal(tiff.decode(tiff_bytes(a, predictor=2, strips=1)), a)
    f = np.random.default_rng(0).normal(size=(3, 5)).astype(np.float32)
    assert np.array_equal(tiff.decode(tiff.encode(f)), f)
    for bad in (b"", b"II+\0", b"JPEG" * 4):
        with pytest.raises((ValueError, struct.error)):
            tiff.decode(bad)
    with pytest.raises(ValueError):
        tiff.image_2d(np.zeros((2, 3, 4)))


def test_stack_in_metadata_order(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"p{k}.tif").write_bytes(tiff.encode(np.arange(16.0).reshape(4, 4) + k))
    views = spark.createDataFrame([(i, f"p{4 - i}.tif") for i in range(5)], "view_idx long, filename string")
    got = tiff.read_stack(spark, views, str(tmp_path), (2, 2)).orderBy("view_idx").collect()
    assert [r["data"] for r in got] == [[v + 4 - i for v in (2.5, 4.5, 10.5, 12.5)] for i in range(5)]
    out = tiff.write_images(tiff.read_stack(spark, views, str(tmp_path)), str(tmp_path / "out"), "shifted").collect()
    assert sorted(r["path"].split("/")[-1] for r in out) == [f"shifted_{k:06d}.tif" for k in range(5)]
    assert np.array_equal(tiff.decode((tmp_path / "out" / "shifted_000001.tif").read_bytes()), np.arange(16.0).reshape(4, 4) + 3)
    with pytest.raises(FileNotFoundError):
        tiff.read_stack(spark, views.union(spark.createDataFrame([(9, "no.tif")], views.schema)), str(tmp_path))
    (tmp_path / "p9.tif").write_bytes(tiff.encode(np.ones((2, 2))))
    with pytest.raises(ValueError):
        tiff.read_stack(spark, views.union(spark.createDataFrame([(9, "p9.tif")], views.schema)), str(tmp_path))
    assert tiff.read_images(spark, str(tmp_path / "none")).count() == 0


def test_metric_and_row_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 8.0), (2, 1.5, 2.0), (3, 4.0, -1.0)], "iteration int, elapsed_s double, data_fidelity double")
    sinks.write_csv(sinks.iteration_times(df), str(tmp_path / "m"), ["iteration"])
    got = spark.read.csv(str(tmp_path / "m"), header=True, inferSchema=True).collect()
    assert [r["iteration_time_s"] for r in got] == [2.0, 0.0, 2.5] and [r["data_residual"] for r in got] == [4.0, 2.0, 0.0]
    assert sinks.write_rows(spark, [], str(tmp_path / "e.csv")) is None and (tmp_path / "e.csv").read_text() == ""
    assert sinks.write_rows(spark, [{"a": 1}, {"b": 2, "a": None}], str(tmp_path / "r")).columns == ["a", "b"]
    assert sinks.union_rows([df.select("iteration"), df]).count() == 6
    sinks.write_winner(spark, str(tmp_path / "best_filter.yaml"), df.where("iteration = 2"))
    assert {r["key"]: r["value"] for r in tables.key_values(spark, str(tmp_path / "best_filter.yaml")).collect()}["elapsed_s"] == "1.5"


def test_folders_logs_and_reports(spark, tmp_path):
    a, b = [sinks.create_run(spark, str(tmp_path), now=0) for _ in range(2)]
    assert a.root != b.root and a.fast_qc == f"{a.root}/fast_recon/qc" and "/run_" in a.root
    for tail in ("", "/fast_recon", "/fast_recon/qc", "/fast_recon/fast_recon"):
        assert sinks.run_root(a.root + tail) == a.root
    sinks.append_log(spark, f"{a.root}/log.txt", "one")
    sinks.append_log(spark, f"{a.root}/log.txt", "two")
    assert [line[20:] for line in sinks.read_small(spark, f"{a.root}/log.txt").splitlines()] == ["one", "two"]
    assert sinks.report("T", {"A": {"k": 1}, "B": ["x"]}).startswith("# T\n\n## A\n\n- k: 1\n")


def test_cached_stacks_and_previews(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(0, 1, 2, [1.0, 3.0])], "view_idx int, rows int, cols int, data array<float>")

    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        df = sinks.cached_stack(spark, str(tmp_path), "main", config, make)
    assert len(made) == 2 and sinks.preview(df, 0.0, 1.0).first()["gray"] == [0, 255]
    views = spark.createDataFrame([(3, "a.tif", 10.0, 0.1, 1.0, 2.0, "qc"), (4, "b.tif", 20.0, 0.2, None, None, None)], "view_idx int, filename string, angle_deg double, angle_rad double, x_shift_px double, y_shift_px double, split string")
    assert sinks.drift_manifest(views, "s", 1, -1).first().asDict()["y_shift_px"] == -2.0
    assert [r["split"] for r in sinks.split_table(views).orderBy("index").collect()] == ["qc", "unused"]


def test_scalars(spark):
    df = spark.createDataFrame([("0;2, 1,x,2,-3", " Hann ", 3661.4, "A"), ("", "RAM-LAK", -5.0, "z")], "ids string, f string, s double, m string")
    got = df.select(scalars.id_list(F.col("ids")).alias("i"), scalars.normal_label(F.col("f"), {"ram-lak": "ram_lak"}).alias("f"), scalars.clock(F.col("s")).alias("c"), scalars.shift_signs(F.col("m")).alias("m"), scalars.eta_seconds(F.lit(10.0), F.lit(0), F.lit(5)).alias("e")).collect()
    assert got[0]["i"] == [0, 2, 1] and got[1]["i"] == [] and got[0]["f"] == "hann" and got[1]["f"] == "ram_lak"
    assert got[0]["c"] == "01:01:01" and got[1]["c"] == "00:00:00" and tuple(got[0]["m"]) == (1, 1) and got[1]["m"] is None and got[0]["e"] is None


def stream_folder(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return monitors.event_stream(spark, str(tmp_path / "in"), "*.parquet", schema)


def test_windows_and_throttle(spark, tmp_path):
    schema = "ts timestamp, gpu int, v double"
    rows = [(f"2024-01-01 00:00:{s:02d}", s % 2, float(s)) for s in range(0, 40, 2)]
    base = spark.createDataFrame(rows, "t string, gpu int, v double").select(F.to_timestamp("t").alias("ts"), "gpu", "v")
    base.write.parquet(str(tmp_path / "in"))
    df = monitors.event_stream(spark, str(tmp_path / "in"), "*.parquet", schema)
    got = monitors.run_once(monitors.window_summary(df, "ts", ["gpu"], "v", "10 seconds", late="1 minute"), f"t{uuid.uuid4().hex}", "complete").orderBy("window_start").collect()
    assert [r["n"] for r in got] == [5, 5, 5, 5] and got[0]["mean"] == 4.0
    first = monitors.run_once(monitors.throttle(df, "ts", ["gpu"], 15), f"t{uuid.uuid4().hex}", "complete").orderBy("window_start").collect()
    assert [r["v"] for r in first] == [0.0, 16.0, 30.0]


def test_history_over_batches(spark, tmp_path):
    schema = "k int, i long, v double"
    stream_folder(spark, tmp_path, [(1, i, float(i)) for i in range(4)], schema)
    df = stream_folder(spark, tmp_path, [(1, i, float(i)) for i in range(4, 8)] + [(2, 0, 9.0)], schema)
    got = monitors.run_once(monitors.history(df, "k", "i", "v", 5), f"h{uuid.uuid4().hex}", "update").collect()
    last = max((r for r in got if r["k"] == 1), key=lambda r: r["last"])
    assert last["values"] == [3.0, 4.0, 5.0, 6.0, 7.0] and last["n"] == 5 and any(r["k"] == 2 for r in got)


def test_latest_request(spark, tmp_path):
    df = stream_folder(spark, tmp_path, [("a", 1, "old"), ("a", 3, "new"), ("a", 2, "late")], "key string, request int, result string")
    got = monitors.run_once(monitors.latest_only(df, "request", "key"), f"l{uuid.uuid4().hex}", "complete").collect()
    assert [r["result"] for r in got] == ["new"]
    static = spark.createDataFrame([(1, "x"), (2, "y")], "request int, result string")
    assert select.latest_request(static, "request").first()["result"] == "y"


def test_metric_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("iteration,objective\n1,2.5\n")
    df = monitors.metric_stream(spark, str(tmp_path / "csv"), "iteration int, objective double")
    assert [tuple(r) for r in monitors.run_once(df, f"m{uuid.uuid4().hex}").collect()] == [(1, 2.5)]
    (tmp_path / "gpu").mkdir()
    (tmp_path / "gpu" / "a.txt").write_text("0, a, 1, 2, 1024, 2048, 30, 40\nbad\n")
    rows = monitors.run_once(monitors.telemetry_stream(spark, str(tmp_path / "gpu")), f"g{uuid.uuid4().hex}").collect()
    assert len(rows) == 1 and rows[0]["memory_percent"] == 50.0 and rows[0]["ts"] is not None
    seen = []
    q = monitors.each_batch(df, lambda b, n: seen.append((n, b.count())), str(tmp_path / "cp"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 1)]
