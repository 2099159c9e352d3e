import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import joins, merge, select, stats, windows


def test_robust_scores_and_first_minimum(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, 5.0), (3, 9.0, 5.0)], "k int, a double, b double")
    got = {r["k"]: r["score_total"] for r in select.robust_z_score(df, {"a": 1.0, "b": 0.1}).collect()}
    a = np.array([1.0, 2.0, 1.0, 9.0])
    want = (a - np.median(a)) / (np.percentile(a, 75) - np.percentile(a, 25))
    assert np.allclose([got[k] for k in range(4)], want)
    assert select.select_min(select.robust_z_score(df, {"a": 1.0}), "score_total", "k").first()["k"] == 0
    nan = df.withColumn("a", F.lit(float("nan")))
    assert select.select_min(nan, "a", "k").count() == 0 and select.select_best(nan, "a", "k").count() == 0
    assert select.select_best(df.withColumnRenamed("a", "entropy"), "entropy", "k").first()["k"] == 0
    assert select.select_best(df, "a", "k").first()["k"] == 3
    assert select.select_named(df.withColumn("f", F.lit(" Hann")), "f", "hann").count() == 4
    with pytest.raises(ValueError):
        select.select_named(df.withColumn("f", F.lit("x")), "f", "hann")


def test_accepted_or_weakest(spark):
    rows = [(0, True, 3.0, 0.1), (1, True, 2.0, 0.2), (2, False, 1.0, 0.05)]
    df = spark.createDataFrame(rows, "k int, ok boolean, noise double, strength double")
    assert select.select_accepted(df, "ok", "noise", "strength", "k").first()["k"] == 1
    assert select.select_accepted(df, "ok", "noise", "strength", "k", by_noise=False).first()["k"] == 0
    none = select.select_accepted(df.withColumn("ok", F.lit(False)), "ok", "noise", "strength", "k").first()
    assert none["k"] == 2 and none["fallback"]


def plain_split(angles, tune, qc, recon):
    order = np.argsort(np.mod(angles, 2 * np.pi), kind="stable").tolist()

    def pick(c, k):
        if k <= 0 or not c:
            return []
        k = min(k, len(c))
        at = list(dict.fromkeys(np.rint(np.linspace(0, len(c) - 1, k)).astype(int).tolist()))
        at += [i for i in range(len(c)) if i not in at][: k - len(at)]
        return [c[i] for i in at]

    out, rest = {}, order
    for name, k in (("tune", tune), ("qc", qc), ("recon", recon)):
        got = pick(rest, k)
        out |= dict.fromkeys(got, name)
        rest = [i for i in rest if i not in got]
    return out


@pytest.mark.parametrize("n,tune,qc,recon", [(12, 3, 2, 4), (5, 9, 1, None), (7, 0, 7, None), (20, 6, 6, None), (3, 1, 1, 0)])
def test_split(spark, n, tune, qc, recon):
    angles = np.random.default_rng(n).uniform(-9, 9, n)
    df = spark.createDataFrame(list(enumerate(angles.tolist())), "view_idx long, angle_rad double")
    got = {r["view_idx"]: r["split"] for r in select.split_views(df, "angle_rad", "view_idx", tune, qc, recon).collect()}
    t = min(tune, n)
    q = min(qc, n - t)
    want = plain_split(angles, t, q, n - t - q if recon is None else min(recon, n - t - q))
    assert got == {k: want.get(k, "unused") for k in range(n)}


def test_split_random_and_empty(spark):
    df = spark.createDataFrame([(k, 0.5 * k) for k in range(12)], "view_idx long, angle_rad double")
    one, two = [sorted(map(tuple, select.split_views(df, "angle_rad", "view_idx", 3, 2, 4, seed=23).select("view_idx", "split").collect())) for _ in range(2)]
    assert one == two and [s for _, s in one].count("tune") == 3
    assert select.split_views(df.limit(0), "angle_rad", "view_idx", 3, 2).count() == 0


def plain_clusters(a, tol):
    order, used, out = np.argsort(a, kind="stable"), set(), {}
    for k in order:
        if k in used:
            continue
        near = [j for j in order if j not in used and abs((a[j] - a[k] + np.pi) % (2 * np.pi) - np.pi) <= tol]
        used |= {k, *near}
        for j in {k, *near}:
            out[int(j)] = int(k)
    return out


def test_greedy_clusters_around_the_circle(spark):
    """Four sets of angles at once, and one of them without keys."""
    sets = [np.concatenate([np.random.default_rng(seed).uniform(-1, 14, 40), [0.0, 2 * np.pi, 2 * np.pi - 0.01, 0.01, 4 * np.pi]]) for seed in range(4)]
    df = spark.createDataFrame([(s, k, v) for s, a in enumerate(sets) for k, v in enumerate(a.tolist())], "dataset int, view_idx long, angle_rad double")
    got = merge.angle_clusters(df, "angle_rad", "view_idx", 0.1, ["dataset"]).collect()
    for s, a in enumerate(sets):
        assert {r["view_idx"]: r["seed"] for r in got if r["dataset"] == s} == plain_clusters(a, 0.1)
    alone = merge.angle_clusters(df.where("dataset = 0"), "angle_rad", "view_idx", 0.1).collect()
    assert {r["view_idx"]: r["seed"] for r in alone} == plain_clusters(sets[0], 0.1)


def test_weighted_merge(spark):
    rows = [(0, 0.0, [2.0] * 4, 1.0), (1, 1e-5, [10.0] * 4, 3.0), (2, 1.0, [5.0] * 4, 1.0)]
    df = spark.createDataFrame(rows, "view_idx long, angle_rad double, data array<float>, weight double")
    c = merge.angle_clusters(df, "angle_rad", "view_idx", 1e-4)
    got = merge.merge_clusters(df.join(c.select("view_idx", "cluster"), "view_idx"), "data", "angle_rad", "weight", ["cluster"]).orderBy("cluster").collect()
    assert len(got) == 2 and np.allclose(got[0]["data"], 9.2) and got[0]["weight"] == pytest.approx(10**0.5) and got[0]["merged"] == 2
    plain = merge.merge_clusters(df.join(c.select("view_idx", "cluster"), "view_idx"), "data", "angle_rad", None, ["cluster"]).orderBy("cluster").first()
    assert np.allclose(plain["data"], 6.0) and plain["weight"] is None


def test_weights(spark):
    df = spark.createDataFrame([("main", 1.0), ("main", 4.0), ("main", 9.0), ("anchor", 10000.0), ("main", float("nan"))], "dataset string, mean_raw double")
    w = stats.view_weights(df, "mean_raw", None, 2.0)
    got = sorted((r["mean_raw"], r["weight"]) for r in stats.normalise_weights(w, "weight", F.col("dataset") == "main", 5.0).where("NOT isnan(mean_raw)").collect())
    floor = np.percentile([1.0, 4.0, 9.0, 10000.0], 5)
    main = 2 * np.sqrt(np.maximum([1.0, 4.0, 9.0, 0.0], floor))  # NaN counts as 0
    want = np.clip(2 * np.sqrt(np.maximum([1.0, 4.0, 9.0, 10000.0], floor)) / np.median(main), 0.2, 5.0)
    assert np.allclose([v for _, v in got], want)
    e = stats.view_weights(df.withColumn("e", F.lit(4.0)), "mean_raw", "e", 3.0)
    assert {r["weight"] for r in e.collect()} == {6.0}


def test_grids():
    assert select.candidate_grid(-1, 1, 0.5) == [-1.0, -0.5, 0.0, 0.5, 1.0] and select.candidate_grid(1, 0, 0.4) == [1.0, 0.6, 0.2]
    assert select.candidate_grid(0, 0.3, 0.1)[-1] == 0.3 and select.candidate_grid(2, 2, 1) == [2.0]
    assert select.fine_grid(0.0, 1.0)[0] == -2.0 and len(select.fine_grid(0.0, 1.0)) == 21
    for bad in ((0, 1, 0), (0, float("nan"), 1), (0, 1e9, 1)):
        with pytest.raises(ValueError):
            select.candidate_grid(*bad)


def test_running_median_and_merge_of_sources(spark):
    x = [5.0, 1.0, 4.0, 2.0, 9.0]
    df = spark.createDataFrame(list(enumerate(x)), "k int, v double").withColumn("g", F.lit(1))
    for width in (1, 3, 5):
        h = width // 2
        padded = np.pad(x, h, mode="symmetric") if h else np.array(x)
        got = [r["median"] for r in windows.running_median(df, "v", "k", width, ["g"]).orderBy("k").collect()]
        assert np.allclose(got, [np.median(padded[k : k + width]) for k in range(5)])
    rows = [("fdk", 1, "run a", "s1"), ("fdk", 2, "run b", "s2"), ("fdk", 3, "run c", "s2"), ("fdk", 0, "run a", "s0"), ("final", 1, "x", "s9")]
    got = joins.merge_sources(spark.createDataFrame(rows, "id string, rank int, context string, signature string"), ["final", "fdk"])
    assert [r["source_id"] for r in got.collect()] == ["final", "fdk", "fdk@run_a#2", "fdk@run_a"]


def test_positional_join_errors(spark):
    a, b = spark.range(3).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")
    with pytest.raises(ValueError):
        joins.positional(a, b, "a", "b")
    with pytest.raises(ValueError):
        joins.positional(a, b, "a", "b", dropped_endpoint=True)
