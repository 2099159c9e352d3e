"""Queries without SQL, against brute force over all rows of a small table."""

import numpy as np
from voxelmill.functions import geometry
from voxelmill.plans import iterative

def test_every_volume_is_projected(spark, tmp_path):
    rng = np.random.default_rng(4)
    volumes = {k: rng.normal(size=64).astype(np.float32) for k in (0, 3, 9, 10, 11, 700)}
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in volumes.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for view in range(12):
        for pixel, voxel, w in zip(*geometry.ray_weights(iterative.PHANTOM, view * np.pi / 6), strict=True):
            for k, v in volumes.items():
                at = (k, view, int(pixel))
                want[at] = want.get(at, 0.0) + w * abs(float(v[voxel]))
    got = {(r["volume_id"], r["view_idx"], r["pixel"]): r["value"] for r in iterative.forward_projection(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-3 for k, v in want.items())
    assert {voxel for view in range(12) for voxel in geometry.ray_weights(iterative.PHANTOM, view * np.pi / 6)[1].tolist()} == set(range(64))
