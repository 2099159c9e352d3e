"""Row numbers, neighbours, order statistics and angle clusters over many tasks."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import clusters, joins, merge, ordering, select, stats


@pytest.mark.parametrize("hot", [False, True])
def test_row_numbers_follow_the_order_and_the_place_of_reading(spark, hot):
    rng = np.random.default_rng(1)
    rows = [(k, None if k % 31 == 0 else 7.0 if hot and k % 3 else float(rng.integers(40)), float(rng.normal())) for k in range(2000)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    got = sorted((r["rank"], r["k"]) for r in ordering.number_rows(df, [F.desc_nulls_last("a")]).collect())
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0)))  # stable
    assert got == [(n, r[0]) for n, r in enumerate(want)]


def test_no_task_has_all_rows_of_a_hot_value(spark):
    df = spark.range(4000).select(F.lit(1).alias("a"), "id")
    numbered = ordering.number_rows(df, ["a"])
    assert numbered.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (0, 3999, 4000)
    sizes = [r[0] for r in numbered.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < 3000


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([(5,)], "a int")
    assert ordering.number_rows(df.limit(0), ["a"]).count() == 0 and ordering.number_rows(df, ["a"]).first()["rank"] == 0
    assert ordering.with_previous(df, "a", ["a"], "b").first()["b"] is None
    assert ordering.order_statistics(df.limit(0), "a", [0.5]).count() == 0
    assert select.numbered(df.withColumn("g", F.lit(1)), ["a"], "n", ["g"]).first()["n"] == 0


def test_windows_have_keys():
    """Neither numbers nor clusters come from a window over a whole table."""
    for f in (select.numbered, joins.positional, stats.median_step, ordering.number_rows, ordering.order_statistics, clusters.angle_clusters, clusters._pointers):
        text = inspect.getsource(f)
        assert "Window.orderBy" not in text and "Window.partitionBy()" not in text and "applyInPandas" not in text


@pytest.mark.parametrize("case", ["normal", "ties", "wide", "one", "two", "signs", "huge"])
def test_order_statistics_equal_numpys(spark, monkeypatch, case):
    monkeypatch.setattr(ordering, "BINS", 16)
    rng = np.random.default_rng(4)
    x = {
        "normal": rng.normal(size=3001),
        "ties": rng.integers(0, 4, 2500).astype(float),
        "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 900), -(10.0 ** rng.uniform(-300, 300, 900)), [0.0] * 7]),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "signs": np.array([-0.0, 0.0, -1.0, 1.0] * 200),
        "huge": np.array([-1.7e308, 1.7e308, 1.0, 2.0]),
    }[case]
    ps = [0.0, 0.05, 0.25, 0.5, 0.501, 0.95, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    r = ordering.order_statistics(df, "v", ps).first()
    assert r["n"] == len(x)
    s = np.sort(x)
    for p, q in zip(ps, r["q"], strict=True):
        k = p * (len(s) - 1)
        a, b = s[int(np.floor(k))], s[int(np.ceil(k))]
        want = a if a == b else (np.ceil(k) - k) * a + (k - np.floor(k)) * b
        assert q == pytest.approx(want, rel=1e-12, abs=0)


def test_a_bracket_that_misses_is_made_good(spark, monkeypatch):
    """A sketch of one value tells nothing, and the result is still exact."""
    monkeypatch.setattr(ordering, "ACCURACY", 2)
    x = np.random.default_rng(5).exponential(size=4000)
    df = spark.createDataFrame([(float(v), k % 3) for k, v in enumerate(x)], "v double, g int")
    for r in ordering.order_statistics(df, "v", [0.1, 0.5, 0.99], ["g"]).collect():
        assert np.allclose(r["q"], np.quantile(x[np.arange(4000) % 3 == r["g"]], [0.1, 0.5, 0.99]), rtol=1e-12)


def test_statistics_built_on_them(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=500)
    df = spark.createDataFrame([(float(v), k % 2, k) for k, v in enumerate(x)] + [(float("nan"), 2, 500)], "v double, g int, k int")
    got = {r["g"]: r["mad"] for r in stats.mad_noise(df, "v", ["g"]).collect()}
    for g in (0, 1):
        part = x[np.arange(500) % 2 == g]
        assert got[g] == pytest.approx(1.4826 * np.median(np.abs(part - np.median(part))))
    assert got[2] == 0.0 and stats.mad_noise(df.where("g = 2"), "v").first()["mad"] == 0.0
    step = stats.median_step(df.where("g < 2"), "v", "k").first()["step"]
    assert step == pytest.approx(np.median(np.abs(np.diff(x))))
    scored = select.robust_z_score(df.where("g < 2"), {"v": 2.0, "k": -1.0}).orderBy("k").collect()
    k = np.arange(500)
    z = lambda a: (a - np.median(a)) / (np.quantile(a, 0.75) - np.quantile(a, 0.25))
    assert np.allclose([r["score_total"] for r in scored], 2 * z(x) - z(k))


def plain_clusters(a, tol):
    """The rule as it is said: in ascending order each angle left is a seed and takes what is left within the tolerance."""
    order, taken, out = np.argsort(a, kind="stable"), np.zeros(len(a), bool), np.zeros(len(a), int)
    for k in order:
        if not taken[k]:
            near = ~taken & (np.abs(np.mod(a - a[k] + np.pi, 2 * np.pi) - np.pi) <= tol)
            near[k] = True
            taken |= near
            out[near] = k
    return out


@pytest.mark.parametrize("tol", [0.0, 0.013, 0.4, 3.0, 4.0])
def test_clusters_of_keys_turns_and_odd_angles(spark, tol):
    rng = np.random.default_rng(7)
    a = [np.concatenate([rng.uniform(-7, 7, 60), np.repeat(rng.uniform(0, 6, 3), 5), [0.0, 2 * np.pi, -2 * np.pi]]) for _ in range(2)]
    rows = [(g, k, float(v)) for g in range(2) for k, v in enumerate(a[g])] + [(0, 900, float("nan")), (1, 901, None)]
    df = spark.createDataFrame(rows, "g int, k long, a double")
    got = merge.angle_clusters(df, "a", "k", tol, ["g"]).collect()
    for g in range(2):
        want = plain_clusters(a[g], tol)
        mine = {r["k"]: r for r in got if r["g"] == g}
        assert [mine[k]["seed"] for k in range(len(a[g]))] == want.tolist()
        seeds = sorted({int(s) for s in want}, key=lambda s: (a[g][s], s))
        assert all(mine[k]["cluster"] == seeds.index(want[k]) for k in range(len(want)))
    assert all(r["seed"] is None and r["cluster"] is None for r in got if r["k"] >= 900)
    assert merge.angle_clusters(df.limit(0), "a", "k", tol).count() == 0


def test_a_hundred_thousand_angles_in_one_arc(spark):
    n, tol = 100_000, 0.01
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 6e-5).alias("a"))
    got = merge.angle_clusters(df, "a", "k", tol).toPandas().sort_values("k")
    a, seeds, s = np.arange(n) * 6e-5, [], -1.0
    want = np.empty(n, int)
    wrapped = np.abs(np.mod(a - a[0] + np.pi, 2 * np.pi) - np.pi) <= tol
    want[wrapped] = 0
    for k in np.flatnonzero(~wrapped):
        if not seeds or a[k] > s + tol:
            seeds.append(k)
            s = a[k]
        want[k] = seeds[-1]
    assert (got["seed"].to_numpy() == want).all() and got["cluster"].max() == len(seeds) and len(seeds) > 500
