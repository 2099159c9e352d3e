"""Folders of many small images: a task reads many, and Spark lists the folder."""

import numpy as np

from voxelmill.sources import tiff


def test_small_files_are_read_many_at_a_time(spark, tmp_path):
    for k in range(120):
        (tmp_path / f"v_{k:03d}.{('tif', 'TIF', 'tiff')[k % 3]}").write_bytes(tiff.encode(np.full((2, 2), k, np.float32)))
    (tmp_path / "notes.tifx").write_text("no image")
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "below.tif").write_bytes(tiff.encode(np.zeros((2, 2), np.float32)))
    (tmp_path / "_half.tif").write_bytes(b"II")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        got = tiff.read_images(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["data"][0] for r in rows) == list(range(120)) and got.columns == ["path", "rows", "cols", "data"]
    assert tiff.read_images(spark, str(tmp_path), recursive=True).count() == 121


def test_a_stack_is_decoded_once(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"v_{k}.tif").write_bytes(tiff.encode(np.full((2, 2), k, np.float32)))
    views = spark.createDataFrame([(k, f"v_{k}.tif") for k in range(3)], "view_idx int, filename string")
    stack = tiff.read_stack(spark, views, str(tmp_path))
    assert "MapInPandas" not in stack._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["view_idx"], r["data"][3]) for r in stack.collect()} == {(0, 0.0), (1, 1.0), (2, 2.0)}
