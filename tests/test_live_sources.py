"""The image data source, changed files, the throttle by state, progress tables, resumed solvers and table functions."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import solvers, table_functions
from voxelmill.sources import changes, tiff, tiff_source
from voxelmill.streaming import monitors


def frames(spark, n=5):
    rows = [(k, f"set{k % 2}/p{k:03d}.tif", 6, 4, [float(k * 100 + j) for j in range(24)]) for k in range(n)]
    return spark.createDataFrame(rows, "view_idx long, name string, rows int, cols int, data array<float>")


def test_images_written_and_read_by_the_source(spark, tmp_path):
    tiff_source.register(spark)
    folder = str(tmp_path / "out")
    frames(spark).drop("view_idx").write.format("tiff_images").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["set0", "set1"]  # nothing temporary is left
    read = lambda **o: spark.read.format("tiff_images").options(recursive=True, **o).load(folder)
    got = {r["name"]: r for r in read().collect()}
    assert set(got) == {f"set{k % 2}/p{k:03d}.tif" for k in range(5)} and got["set0/p004.tif"]["data"] == [400.0 + j for j in range(24)]
    cut = read(bins="2,2", crop="1,0,0,1").where("name = 'set1/p001.tif'").collect()
    want = np.arange(100.0, 124.0).reshape(3, 2, 2, 2).mean(axis=(1, 3))[1:, :1]
    assert len(cut) == 1 and (cut[0]["rows"], cut[0]["cols"]) == (2, 1) and np.allclose(cut[0]["data"], want.reshape(-1))
    assert read(pixels=False).where("data IS NULL AND rows = 6").count() == 5
    assert read(files=2).rdd.getNumPartitions() == 3 and spark.read.format("tiff_images").load(folder).count() == 0  # not recursive
    # the same files by way of binaryFile
    assert tiff.read_images(spark, folder, recursive=True).count() == 5


def test_names_and_patterns_choose_files(spark, tmp_path):
    tiff_source.register(spark)
    folder = str(tmp_path / "out")
    frames(spark).drop("view_idx").write.format("tiff_images").mode("append").save(folder)
    with open(f"{folder}/set1/p001.tif", "wb") as f:
        f.write(b"no image")
    read = lambda **o: spark.read.format("tiff_images").options(recursive=True, **o).load(folder)
    assert read(pattern="set0/*").count() == 3 and read(names='["set0/p000.tif", "set1/p003.tif"]').count() == 2  # the broken one is not opened
    assert read(names="[]").count() == 0
    with pytest.raises(Exception, match="not a TIFF"):
        read().collect()


def test_commit_and_abort(spark, tmp_path):
    tiff_source.register(spark)
    folder = str(tmp_path / "out")
    frames(spark, 3).drop("name").write.format("tiff_images").option("prefix", "v").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["v_000000.tif", "v_000001.tif", "v_000002.tif"]
    bad = frames(spark, 40).repartition(4).withColumn("name", F.when(F.col("view_idx") == 33, F.lit("../x.tif")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no name below"):
        bad.write.format("tiff_images").mode("overwrite").save(folder)
    assert sorted(os.listdir(folder)) == ["v_000000.tif", "v_000001.tif", "v_000002.tif"]  # a failed job leaves and takes nothing
    with pytest.raises(Exception, match="same name"):
        frames(spark, 2).withColumn("name", F.lit("a.tif")).write.format("tiff_images").mode("append").save(folder)
    assert not os.path.exists(f"{folder}/a.tif")
    frames(spark, 1).drop("name").withColumn("view_idx", F.lit(7).cast("long")).write.format("tiff_images").option("prefix", "v").mode("overwrite").save(folder)
    assert os.listdir(folder) == ["v_000007.tif"]


def test_rewritten_files_replace_their_rows(spark, tmp_path):
    folder, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    os.makedirs(folder)

    def write(name, *rows):
        with open(f"{folder}/{name}", "w") as f:
            f.write("iteration,loss\n" + "".join(f"{i},{v}\n" for i, v in rows))
        at = time.time_ns() + write.n * 10**9
        write.n += 1
        os.utime(f"{folder}/{name}", ns=(at, at))

    write.n = 0
    rows = lambda: sorted((os.path.basename(r["path"]), r["place"], r["values"]["loss"]) for r in changes.current_rows(spark, table).collect())
    write("a.csv", (0, 5), (1, 4))
    write("b.csv", (0, 9))
    query = changes.keep_current(changes.changed_files(spark, folder), table, state)
    try:
        query.processAllAvailable()
        assert rows() == [("a.csv", 0, "5"), ("a.csv", 1, "4"), ("b.csv", 0, "9")]
        write("a.csv", (0, 5), (1, 4), (2, 3))  # grown
        write("b.csv", (0, 8))  # rewritten
        query.processAllAvailable()
        assert rows() == [("a.csv", 0, "5"), ("a.csv", 1, "4"), ("a.csv", 2, "3"), ("b.csv", 0, "8")]
    finally:
        query.stop()
    os.remove(f"{folder}/b.csv")
    write("c.csv")
    query = changes.keep_current(changes.changed_files(spark, folder), table, state)  # goes on from its checkpoint
    try:
        query.processAllAvailable()
        assert rows() == [("a.csv", 0, "5"), ("a.csv", 1, "4"), ("a.csv", 2, "3")]
    finally:
        query.stop()
    assert spark.read.format("metric_files").option("path", folder).load().where("place >= 0").count() == 3


def test_throttle_counts_from_the_last_that_passed(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "ts timestamp, k string, v long"

    def put(*rows):
        spark.createDataFrame([(f"2024-01-01 00:00:{s:02d}", k, v) for s, k, v in rows], "ts string, k string, v long").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "k", "v").coalesce(1).write.mode("append").parquet(folder)

    def passed():
        df = spark.readStream.schema(schema).parquet(folder)
        got = monitors.run_once(monitors.throttle_since(df, "ts", ["k"], 15, ["v"]), "throttle", "append", str(tmp_path / "state"))
        return sorted((r["k"], r["ts"].second, r["v"]) for r in got.collect())

    put((14, "a", 2), (0, "a", 1), (16, "a", 3), (29, "a", 4), (31, "a", 5), (3, "b", 6), (3, "b", 7))
    assert passed() == [("a", 0, 1), ("a", 16, 3), ("a", 31, 5), ("b", 3, 6)]
    put((45, "a", 8), (46, "a", 9), (2, "b", 10), (18, "b", 11))  # the next batch goes on from the state; what is older never passes
    assert passed() == [("a", 0, 1), ("a", 16, 3), ("a", 31, 5), ("a", 46, 9), ("b", 3, 6), ("b", 18, 11)]


def test_progress_becomes_a_table(spark, tmp_path):
    listener = monitors.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        spark.range(10).write.parquet(str(tmp_path / "in"))
        df = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        monitors.run_once(df, "watched", "append", str(tmp_path / "state"))
        for _ in range(100):
            if os.path.exists(tmp_path / "progress") and any("-end-" in f for f in os.listdir(tmp_path / "progress")):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = listener.rows().collect()
    batches = [r for r in rows if r["batch"] is not None]
    assert [(r["query"], r["batch"], r["rows_in"]) for r in batches if r["rows_in"]] == [("watched", 0, 10)] and len(rows) > len(batches) and not any(r["error"] for r in rows)


def test_a_solver_goes_on_where_it_was_stopped(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 8
    a = rng.normal(size=(n, n))
    m, b = a @ a.T + n * np.eye(n), rng.normal(size=n)
    matrix = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n)], "i int, j int, w double")
    right = spark.createDataFrame([(i, float(b[i])) for i in range(n)], "i int, value double")
    folder, calls = str(tmp_path / "cg"), []

    def cut(df):
        calls.append(1)
        if len(calls) > 7:  # one at the start, two an iteration: stopped in the fourth
            raise RuntimeError("lost")
        return spark.createDataFrame(df.collect(), df.schema)

    with pytest.raises(RuntimeError, match="lost"):
        solvers.conjugate_gradient_tables(matrix, right, 30, 1e-10, cut, folder)
    assert solvers._saved_iterations(spark, folder) == [2, 3]
    calls.clear()
    x, residual, done = solvers.conjugate_gradient_tables(matrix, right, 30, 1e-10, lambda df: (calls.append(1), spark.createDataFrame(df.collect(), df.schema))[1], folder)
    assert np.allclose([r["value"] for r in x.orderBy("i").collect()], np.linalg.solve(m, b)) and residual <= 1e-10
    assert len(calls) == 1 + 2 * (done - 3)  # the first three iterations are not run again
    again = solvers.conjugate_gradient_tables(matrix, right, 30, 1e-10, None, folder)
    assert again[2] == done


def test_table_functions(spark):
    table_functions.register(spark)
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("SELECT value FROM candidate_grid(1D, 0D, 0.4D)") == [(1.0,), (0.6,), (0.2,)]
    assert len(sql("SELECT * FROM fine_grid(0D, 1D)")) == 21
    assert sql("SELECT * FROM batch_list(7L, 3L)") == [(0, 0, 2), (1, 3, 5), (2, 6, 6)] and sql("SELECT * FROM batch_list(0L, 3L)") == []
    assert sql("SELECT * FROM shard_list(7L, 3L)") == [(0, 0, 2), (1, 3, 4), (2, 5, 6)] and len(sql("SELECT * FROM shard_list(2L, 5L)")) == 2
    assert sql("SELECT s.k, g.value FROM VALUES (1, 0D, 1D), (2, 5D, 5D), (3, NULL, 1D) s(k, a, b), LATERAL candidate_grid(s.a, s.b, 1D) g ORDER BY ALL") == [(1, 0.0), (1, 1.0), (2, 5.0)]
