"""Relational and time-series queries: events as telemetry, keys as angles, line items as views."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions import scalars
from voxelmill.operators import joins, merge, select, stats
from voxelmill.plans.images import rounded
from voxelmill.sources import sinks


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mad_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.mad_noise(_t(spark, sf_dir, "events"), "value", ["event_type"])
    return got.select("event_type", rounded(F.col("mad"), 6).alias("mad"))


def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.summary(_t(spark, sf_dir, "events"), "value", ["event_type"])
    return got.select("event_type", *[rounded(F.col(c), 4).alias(c) for c in ("min", "max", "mean", "std")])


def weight_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as views: weight from the mean value; the first hundred users are the main set."""
    views = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.greatest("value", F.lit(0.0))).alias("mean_raw"))
    weighted = stats.view_weights(views, "mean_raw", None, 2.0)
    return stats.normalise_weights(weighted, "weight", F.col("user_id") < 100, 1.2).select("user_id", rounded(F.col("weight"), 6).alias("weight"))


def weighted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merge.weighted_mean(_t(spark, sf_dir, "lineitem").withColumn("w", 1.0 + F.col("l_tax") * 10), ["l_partkey"], "l_quantity", "w")
    return got.select("l_partkey", rounded(F.col("l_quantity"), 5).alias("l_quantity"), rounded(F.col("w"), 5).alias("weight"))


def merge_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images merged by data set, weighted by 1 + vec_id % 3; angle is vec_id in degrees."""
    e = _t(spark, sf_dir, "embeddings").select("label", F.radians(F.col("vec_id").cast("double")).alias("angle_rad"), (1.0 + F.col("vec_id") % 3).alias("weight"), F.col("embedding").cast("array<double>").alias("data"))
    got = merge.merge_clusters(e, "data", "angle_rad", "weight", ["label"])
    return got.select("label", rounded(F.col("angle_rad"), 6).alias("angle_rad"), rounded(F.col("weight"), 6).alias("weight"), "merged", F.posexplode("data").alias("i", "v")).select("label", "angle_rad", "weight", "merged", F.col("i").cast("long").alias("i"), rounded(F.col("v").cast("double"), 4).alias("value"))


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("view_idx"), (F.col("s_suppkey") * 2.399963).alias("angle_rad"))


def angle_sort_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.split_views(_angles(spark, sf_dir), "angle_rad", "view_idx", 6, 6, 30).select("view_idx", "split")


def tolerance_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of suppliers in clusters of 0.05: greedy from ascending seeds, around the circle."""
    views = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("view_idx"), (F.col("s_suppkey") * 0.37 % 6.2831).alias("angle_rad"))
    return merge.angle_clusters(views, "angle_rad", "view_idx", 0.05)


def wrapped_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _angles(spark, sf_dir).withColumn("angle_rad", F.col("angle_rad") - 100.0)
    return a.select("view_idx", rounded(scalars.wrap_angle(F.col("angle_rad")), 6).alias("wrapped"), rounded(scalars.circular_distance(F.col("angle_rad"), F.lit(1.0)), 6).alias("distance"), rounded(F.degrees(F.col("angle_rad")), 4).alias("degrees"))


def dup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicates(_t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name")), "name")


def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no line item is of, both tables over all rows."""
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return joins.missing(o, li, "o_orderkey").select("o_orderkey", "o_custkey")


def semi_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    return joins.semi(c, s, "c_nationkey").select("c_custkey")


def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files dir/order.tif for even customers, order.tif for the others; every 5th is missing."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("dir/"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("filename"), "o_custkey")
    files = o.where("o_orderkey % 5 <> 0").select(F.when(F.col("o_custkey") % 2 == 0, F.col("filename")).otherwise(F.substring_index("filename", "/", -1)).alias("path"))
    return joins.resolve_files(o.select("o_orderkey", "filename"), files).select("o_orderkey", "path", "exists")


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts by key, joined by place with all parts by price, reversed."""
    p = _t(spark, sf_dir, "part")
    priced = p.select(F.struct("p_retailprice", "p_partkey").alias("k"), F.col("p_partkey").alias("priced_partkey"), "p_size")
    return joins.positional(p.select("p_partkey"), priced, "p_partkey", "k", reverse=True)


def direction_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return stats.direction(e, "value", ["ts", "event_id"], ["user_id", "d"]).select("user_id", F.col("d").cast("string").alias("day"), "direction")


def endpoint_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user as angles; users whose first and last value coincide on a circle of 360 within 5 lose the last."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    ends = stats.endpoint_repeats(e, "value", "event_id", ["user_id"], 5.0)
    return merge.drop_endpoint(e, ends, "event_id", ["user_id"]).select("user_id", "event_id")


def iter_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("iteration"), F.col("value").alias("elapsed_s"), (F.col("value") - 100.0).alias("data_fidelity"))
    got = sinks.iteration_times(e, ["user_id"])
    return got.select("user_id", "iteration", rounded(F.col("iteration_time_s"), 4).alias("iteration_time_s"), rounded(F.col("data_residual"), 4).alias("data_residual"))


def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of five neighbours per user, edges mirrored."""
    from voxelmill.operators.windows import running_median as run

    got = run(_t(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", "event_id", 5, ["user_id"])
    return got.select("user_id", "event_id", rounded(F.col("median"), 4).alias("median"))


def history_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.recent(_t(spark, sf_dir, "events").select("user_id", "event_id"), ["event_id"], 30, ["user_id"])


def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.stride(_t(spark, sf_dir, "events").select("event_id"), "event_id", 7, 3)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.batches(_t(spark, sf_dir, "events").select("event_id"), "event_id", 64).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.shards(_t(spark, sf_dir, "events").select("event_id"), "event_id", 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.head_and_tail(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5)


def first_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_offenders(_t(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") % 13 == 5, "o_orderkey")


def top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.desc("o_orderkey")])


def _qc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual rows: volume by event type, split by parity, last ones count."""
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("position"), F.concat(F.lit(" "), F.upper("event_type")).alias("volume"), F.when(F.col("event_id") % 2 == 0, "tune").otherwise("qc").alias("split"), F.when(F.col("event_id") % 7 < 5, F.col("value")).alias("residual"))


def qc_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.qc_pivot(_qc_rows(spark, sf_dir)).select("volume", rounded(F.col("tune"), 4).alias("tune"), rounded(F.col("qc"), 4).alias("qc"))


def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.qc_pivot(_qc_rows(spark, sf_dir))
    return p.select("volume", rounded(scalars.percent_change(F.col("tune"), F.col("qc")), 3).alias("change"))


def histogram96(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_t(spark, sf_dir, "events"), "value", 96).select(F.col("bin").cast("long").alias("bin"), "n")


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ordered_distinct(_t(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" "), F.col("event_type")).alias("t")), "t", "event_id").select("value", F.col("position").alias("event_id"))


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return merge.stack([a, b]).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.union_distinct([_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))])


def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all customers without those of all suppliers."""
    return merge.difference(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")


def fill_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers have weights, suppliers none: ones for all."""
    parts = [_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 100).alias("weight")), _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))]
    return merge.stack(merge.fill_weights(parts, "weight", ones=True)).groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


def telemetry_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry lines made of events: every 11th reading is missing, every 17th line is short."""
    from voxelmill.sources.tables import parse_telemetry

    e = _t(spark, sf_dir, "events")
    used = F.when(F.col("event_id") % 11 == 0, F.lit("[N/A]")).otherwise(F.floor(F.col("value") * 10).cast("string"))
    full = F.concat_ws(", ", (F.col("user_id") % 8).cast("string"), F.lit("gpu"), F.lit("50"), F.lit("7"), used, F.lit("8192"), F.lit("Not Supported"), F.lit("99.5"))
    lines = e.select("event_id", F.when(F.col("event_id") % 17 == 0, F.lit("0, gpu, 1")).otherwise(full).alias("line"))
    got = parse_telemetry(lines)
    return got.select("event_id", "gpu_id", "utilization_gpu_pct", rounded(F.col("memory_used_gb"), 6).alias("memory_used_gb"), "temperature_c", "power_w", rounded(F.col("memory_percent"), 4).alias("memory_percent"))


def nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return joins.nearest(e, "value", F.lit(250.0), "event_id", ["user_id"]).select("user_id", "event_id", rounded(F.col("value"), 4).alias("value"))


def best_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(rounded(F.avg("l_extendedprice"), 4).alias("m"))
    return select.select_best(m, "m", "l_suppkey", lowest=False)


def accepted_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(rounded(F.avg("l_discount"), 6).alias("noise"), rounded(F.avg("l_quantity"), 6).alias("strength"))
    got = select.select_accepted(m.withColumn("accepted", F.col("strength") > 25.5), "accepted", "noise", "strength", "l_suppkey")
    return got.select("l_suppkey", "noise", "strength", "fallback")


def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of orders: id by priority, ranked by order key, signature by status."""
    o = _t(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("id"), F.col("o_orderkey").alias("rank"), F.lower("o_orderstatus").alias("context"), F.col("o_orderstatus").alias("signature"))
    return joins.merge_sources(o, ["3", "1"]).select("source_id", "id", "context", "rank")


def _clocks(e: DataFrame) -> DataFrame:
    s = F.floor(F.col("value") * 50)
    return e.select("event_id", scalars.clock(s.cast("double")).alias("clock"), rounded(scalars.eta_seconds(F.col("value"), F.col("event_id") % 9, F.lit(10)), 4).alias("eta"))


def clock_and_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clocks(_t(spark, sf_dir, "events"))


def _typed(e: DataFrame) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, " TRUE ").when(F.col("event_id") % 5 == 2, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).when(F.col("event_id") % 5 == 3, F.lit("2.5")).otherwise(F.col("event_type"))
    return e.select("event_id", scalars.typed_text(text).alias("t")).groupBy("t.kind").agg(F.count(F.lit(1)).alias("n"), F.min("t.value").alias("least"))


def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(_t(spark, sf_dir, "events"))


def safe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.safe_key(F.concat(F.lit("--"), F.col("p_name"), F.lit("/ "), F.col("p_brand"), F.lit("!"))).alias("key"), scalars.normal_label(F.concat(F.lit(" "), F.upper("p_type"))).alias("label"))


def id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    text = F.concat_ws(";", F.col("c_nationkey").cast("string"), F.lit(" 3"), F.lit("-1,x"), (F.col("c_custkey") % 4).cast("string"))
    return c.select("c_custkey", F.concat_ws(",", F.transform(scalars.id_list(text), lambda i: i.cast("string"))).alias("ids"))


def memory_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("v"), (F.col("p_retailprice") / 1000.0).alias("p"))
    m = p.select("p_partkey", scalars.memory_model_gib(F.col("v"), F.col("p")).alias("m"), scalars.batches_per_sweep(F.col("p_partkey"), F.lit(8), F.lit(32)).alias("batches"), rounded(scalars.detector_pixel_mm(F.col("p"), F.lit(200.0), F.lit(100.0)), 7).alias("pixel_mm"))
    return m.select("p_partkey", *[rounded(F.col(f"m.{c}"), 9).alias(c) for c in ("admm", "pdhg", "subset_tv", "mbir_lite", "min_free")], F.col("batches").cast("long").alias("batches"), "pixel_mm")


def matvec_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forward and a back projection with the relation (order, part, quantity), and the inner products that must agree."""
    from voxelmill.operators import linear

    a = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("view_idx"), F.col("l_suppkey").alias("pixel"), F.col("l_partkey").alias("voxel"), (F.col("l_quantity") / 50).alias("w"))
    x = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"), (F.col("p_size") / 10.0).alias("value"))
    return linear.forward(a, x).select("view_idx", "pixel", rounded(F.col("value"), 4).alias("value"))


def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted residual of each data set against its mean image."""
    e = _t(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("m"), (1.0 + F.col("vec_id") % 3).alias("w"))
    means = stats.mean_field(e, "m", ["label"]).select("label", F.col("m").cast("array<double>").alias("p"))
    got = stats.weighted_residual(e.join(means, "label"), "p", "m", "w", ["label"])
    half = stats.squared_residual(e.join(means, "label"), "p", "m", ["label"])
    return got.join(half, "label").select("label", rounded(F.col("residual"), 5).alias("residual"), rounded(F.col("data_term"), 3).alias("data_term"))


_EVENT_W = "lag(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)"
_QC = "q AS (SELECT event_id, lower(event_type) AS volume, CASE WHEN event_id % 2 = 0 THEN 'tune' ELSE 'qc' END AS split, CASE WHEN event_id % 7 < 5 THEN value END AS r FROM events), p AS (SELECT volume, arg_max(r, event_id) FILTER (WHERE split = 'tune' AND r IS NOT NULL) AS tune, arg_max(r, event_id) FILTER (WHERE split = 'qc' AND r IS NOT NULL) AS qc FROM q GROUP BY volume)"
_SPLIT = f"""
WITH o AS (SELECT s_suppkey AS view_idx, row_number() OVER (ORDER BY s_suppkey * 2.399963 - floor(s_suppkey * 2.399963 / {2 * math.pi!r}) * {2 * math.pi!r}, s_suppkey) - 1 AS k FROM supplier),
n AS (SELECT count(*) AS n FROM o),
t AS (SELECT view_idx, k FROM o, n WHERE k IN (SELECT round_even(i * (n - 1) / 5.0, 0) FROM (SELECT unnest(range(6)) AS i), n)),
o2 AS (SELECT view_idx, row_number() OVER (ORDER BY k) - 1 AS k FROM o WHERE view_idx NOT IN (SELECT view_idx FROM t)),
n2 AS (SELECT count(*) AS n FROM o2),
q AS (SELECT view_idx, k FROM o2, n2 WHERE k IN (SELECT round_even(i * (n - 1) / 5.0, 0) FROM (SELECT unnest(range(6)) AS i), n2)),
o3 AS (SELECT view_idx, row_number() OVER (ORDER BY k) - 1 AS k FROM o2 WHERE view_idx NOT IN (SELECT view_idx FROM q)),
n3 AS (SELECT count(*) AS n FROM o3),
r AS (SELECT view_idx, k FROM o3, n3 WHERE k IN (SELECT round_even(i * (n - 1) / 29.0, 0) FROM (SELECT unnest(range(30)) AS i), n3))
SELECT o.view_idx, CASE WHEN t.view_idx IS NOT NULL THEN 'tune' WHEN q.view_idx IS NOT NULL THEN 'qc' WHEN r.view_idx IS NOT NULL THEN 'recon' ELSE 'unused' END AS split
FROM o LEFT JOIN t USING (view_idx) LEFT JOIN q USING (view_idx) LEFT JOIN r USING (view_idx)"""

QUERIES = {
    "mad_noise": (mad_noise, "SELECT event_type, round(1.4826 * mad(value), 6) + 0.0 AS mad FROM events GROUP BY 1"),
    "event_summary": (event_summary, "SELECT event_type, round(min(value), 4) + 0.0 AS min, round(max(value), 4) + 0.0 AS max, round(avg(value), 4) + 0.0 AS mean, round(stddev_pop(value), 4) + 0.0 AS std FROM events GROUP BY 1"),
    "weight_normalise": (
        weight_normalise,
        "WITH v AS (SELECT user_id, avg(greatest(value, 0)) AS m FROM events GROUP BY 1), w AS (SELECT user_id, 2 * sqrt(greatest(m, (SELECT quantile_cont(m, 0.05) FROM v WHERE m > 0), 1e-6)) AS w FROM v) SELECT user_id, round(least(greatest(w / greatest((SELECT median(w) FROM w WHERE user_id < 100), 1e-6), 1 / 1.2), 1.2), 6) + 0.0 AS weight FROM w",
    ),
    "weighted_merge": (weighted_merge, "SELECT l_partkey, round(sum(l_quantity * v) / greatest(sum(v), 1e-12), 5) + 0.0 AS l_quantity, round(sqrt(sum(v)), 5) + 0.0 AS weight FROM (SELECT *, pow(greatest(1 + l_tax * 10, 1e-6), 2) AS v FROM lineitem) GROUP BY 1"),
    "merge_views": (
        merge_views,
        "WITH e AS (SELECT label, vec_id, pow(1 + vec_id % 3, 2) AS w, embedding FROM embeddings), a AS (SELECT label, round(sum(radians(vec_id) * w) / sum(w), 6) + 0.0 AS angle_rad, round(sqrt(sum(w)), 6) + 0.0 AS weight, count(*) AS merged FROM e GROUP BY 1), p AS (SELECT label, w, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM e) SELECT label, angle_rad, weight, merged, i, round(CAST(CAST(sum(v * w) / sum(w) AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM p JOIN a USING (label) GROUP BY ALL",
    ),
    "angle_sort_split": (angle_sort_split, _SPLIT),
    "tolerance_cluster": (
        tolerance_cluster,
        # each step takes the first angle left as a seed, with all angles left within the tolerance around the circle
        """WITH RECURSIVE a AS (SELECT list(s_suppkey ORDER BY angle, s_suppkey) AS ids, list(angle ORDER BY angle, s_suppkey) AS l
             FROM (SELECT s_suppkey, s_suppkey * CAST(0.37 AS DOUBLE) % CAST(6.2831 AS DOUBLE) AS angle FROM supplier)),
           r AS (SELECT -1 AS cluster, CAST(NULL AS BIGINT) AS seed, range(1, len(l) + 1) AS rest, CAST([] AS BIGINT[]) AS members FROM a
             UNION ALL
             SELECT cluster + 1, rest[1], list_filter(rest, lambda p: p <> rest[1] AND abs((l[p] - l[rest[1]] + pi()) - 2 * pi() * floor((l[p] - l[rest[1]] + pi()) / (2 * pi())) - pi()) > 0.05),
                    list_filter(rest, lambda p: p = rest[1] OR abs((l[p] - l[rest[1]] + pi()) - 2 * pi() * floor((l[p] - l[rest[1]] + pi()) / (2 * pi())) - pi()) <= 0.05)
             FROM r, a WHERE len(rest) > 0),
           m AS (SELECT cluster, seed, unnest(members) AS p FROM r WHERE cluster >= 0)
           SELECT ids[p] AS view_idx, cluster, ids[seed] AS seed FROM m, a""",
    ),
    "wrapped_angles": (
        wrapped_angles,
        f"WITH a AS (SELECT s_suppkey AS view_idx, s_suppkey * 2.399963 - 100.0 AS a FROM supplier) SELECT view_idx, round(a - floor(a / {2 * math.pi!r}) * {2 * math.pi!r}, 6) + 0.0 AS wrapped, round(abs((a - 1 + {math.pi!r}) - floor((a - 1 + {math.pi!r}) / {2 * math.pi!r}) * {2 * math.pi!r} - {math.pi!r}), 6) + 0.0 AS distance, round(degrees(a), 4) + 0.0 AS degrees FROM a",
    ),
    "dup_names": (dup_names, "SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1"),
    "missing_anti": (
        missing_anti,
        'SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)',
    ),
    "semi_views": (semi_views, "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "fallback_lookup": (fallback_lookup, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_custkey % 2 <> 0 THEN '' ELSE 'dir/' END || o_orderkey || '.tif' AS path, o_orderkey % 5 <> 0 AS exists FROM orders"),
    "positional_zip": (
        positional_zip,
        'WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part), b AS (SELECT p_partkey AS priced_partkey, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey DESC) AS k FROM part) SELECT p_partkey, priced_partkey, p_size FROM a JOIN b USING (k)',
    ),
    "direction_class": (
        direction_class,
        f"WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value - {_EVENT_W} AS d FROM events) SELECT user_id, day, CASE WHEN count(*) < 2 THEN 'single angle' WHEN count(*) FILTER (WHERE d > 0) > 0 AND count(*) FILTER (WHERE d < 0) = 0 THEN 'ascending' WHEN count(*) FILTER (WHERE d < 0) > 0 AND count(*) FILTER (WHERE d > 0) = 0 THEN 'descending' WHEN count(*) FILTER (WHERE d <> 0) = 0 THEN 'constant' ELSE 'mixed/non-monotonic' END AS direction FROM d GROUP BY 1, 2",
    ),
    "endpoint_drop": (
        endpoint_drop,
        "WITH e AS (SELECT user_id, arg_min(value, event_id) AS a, arg_max(value, event_id) AS b, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1), r AS (SELECT user_id, last, n > 1 AND (abs((b - a + 180) - floor((b - a + 180) / 360) * 360 - 180) <= 5 OR abs(abs(b - a) - 360) <= 5) AS rep FROM e) SELECT user_id, event_id FROM events JOIN r USING (user_id) WHERE NOT (rep AND event_id = last)",
    ),
    "iter_time": (iter_time, "SELECT user_id, event_id AS iteration, round(greatest(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0), 0), 4) + 0.0 AS iteration_time_s, round(sqrt(greatest(2 * (value - 100), 0)), 4) + 0.0 AS data_residual FROM events"),
    "running_median": (
        running_median,
        "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), t AS (SELECT user_id, event_id, k, n, k + unnest([-2, -1, 0, 1, 2]) AS j FROM n), m AS (SELECT user_id, event_id, CASE WHEN j < 0 THEN -j - 1 WHEN j >= n THEN 2 * n - 1 - j ELSE j END AS k FROM t) SELECT m.user_id, m.event_id, round(median(n.value), 4) + 0.0 AS median FROM m JOIN n ON n.user_id = m.user_id AND n.k = m.k GROUP BY 1, 2",
    ),
    "history_n": (history_n, "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30"),
    "stride": (stride, "SELECT event_id FROM events WHERE event_id % 7 = 3"),
    "batches": (batches, "SELECT event_id // 64 AS batch, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1"),
    "shards": (shards, "SELECT ntile(7) OVER (ORDER BY event_id) - 1 AS shard, event_id FROM events".join(["SELECT shard, count(*) AS n, min(event_id) AS first FROM (", ") GROUP BY 1"])),
    "head_tail": (head_tail, "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 5 OR row_number() OVER (ORDER BY o_orderkey DESC) <= 5"),
    "first_bad": (first_bad, "SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 5 ORDER BY 1 LIMIT 10"),
    "top50": (top50, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50"),
    "qc_pivot": (qc_pivot, f"WITH {_QC} SELECT volume, round(tune, 4) + 0.0 AS tune, round(qc, 4) + 0.0 AS qc FROM p"),
    "pct_change": (pct_change, f"WITH {_QC} SELECT volume, round(100 * (tune - qc) / tune, 3) + 0.0 AS change FROM p"),
    "histogram96": (histogram96, "SELECT CAST(least(floor((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) * 96), 95) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1"),
    "ordered_distinct": (ordered_distinct, "SELECT event_type AS value, min(event_id) AS event_id FROM events WHERE event_type <> '' GROUP BY 1"),
    "union_all": (union_all, "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1"),
    "union_distinct": (union_distinct, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "except": (
        except_keys,
        'SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier',
    ),
    "fill_weights": (fill_weights, "SELECT CAST(1.0 AS DOUBLE) AS weight, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n"),
    "telemetry_parse": (
        telemetry_parse,
        "SELECT event_id, CAST(user_id % 8 AS INTEGER) AS gpu_id, CAST(50 AS DOUBLE) AS utilization_gpu_pct, round(CASE WHEN event_id % 11 <> 0 THEN floor(value * 10) / 1024 END, 6) + 0.0 AS memory_used_gb, CAST(NULL AS DOUBLE) AS temperature_c, CAST(99.5 AS DOUBLE) AS power_w, round(CASE WHEN event_id % 11 <> 0 THEN 100 * floor(value * 10) / 8192 END, 4) + 0.0 AS memory_percent FROM events WHERE event_id % 17 <> 0",
    ),
    "nearest_candidate": (nearest_candidate, "SELECT user_id, event_id, round(value, 4) + 0.0 AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 250), event_id) = 1"),
    "best_finite": (best_finite, "SELECT l_suppkey, round(avg(l_extendedprice), 4) + 0.0 AS m FROM lineitem GROUP BY 1 ORDER BY m DESC, 1 LIMIT 1"),
    "accepted_prior": (
        accepted_prior,
        "WITH m AS (SELECT l_suppkey, round(avg(l_discount), 6) + 0.0 AS noise, round(avg(l_quantity), 6) + 0.0 AS strength FROM lineitem GROUP BY 1) SELECT l_suppkey, noise, strength, strength <= 25.5 AS fallback FROM m ORDER BY strength <= 25.5, CASE WHEN strength > 25.5 THEN noise ELSE strength END, l_suppkey LIMIT 1",
    ),
    "merge_sources": (
        merge_sources,
        "WITH o AS (SELECT o_orderpriority[1:1] AS id, lower(o_orderstatus) AS context, max(o_orderkey) AS rank FROM orders GROUP BY 1, 2) SELECT CASE WHEN row_number() OVER (PARTITION BY id ORDER BY rank DESC) = 1 THEN id ELSE id || '@' || context END AS source_id, id, context, rank FROM o",
    ),
    "clock_and_eta": (
        clock_and_eta,
        "WITH e AS (SELECT *, CAST(floor(value * 50) AS BIGINT) AS s FROM events) SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, round(value / nullif(event_id % 9, 0) * greatest(10 - event_id % 9, 0), 4) + 0.0 AS eta FROM e",
    ),
    "typed_fields": (
        typed_fields,
        "WITH e AS (SELECT event_id % 5 AS m, event_id, event_type FROM events), t AS (SELECT ['empty', 'bool', 'int', 'float', 'text'][m + 1] AS kind, CASE m WHEN 0 THEN '' WHEN 1 THEN 'true' WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN '2.5' ELSE event_type END AS v FROM e) SELECT kind, count(*) AS n, min(v) AS least FROM t GROUP BY 1",
    ),
    "safe_keys": (safe_keys, "SELECT p_partkey, trim(regexp_replace('--' || p_name || '/ ' || p_brand || '!', '[^a-zA-Z0-9]+', '_', 'g'), '_') AS key, lower(p_type) AS label FROM part"),
    "memory_model": (
        memory_model,
        "SELECT p_partkey, round(18 * v + 3 * p, 9) + 0.0 AS admm, round(5.5 * v + 3 * p, 9) + 0.0 AS pdhg, round(2.35 * v + 1.25 * p, 9) + 0.0 AS subset_tv, round(4.85 * v + 1.25 * p, 9) + 0.0 AS mbir_lite, round(greatest(4, 2 * v + p), 9) + 0.0 AS min_free, CAST(ceil(ceil(p_partkey / 8) / 32) AS BIGINT) AS batches, round(p * 1e-3 * 200 / 100, 7) + 0.0 AS pixel_mm FROM (SELECT p_partkey, p_size / 4.0 AS v, p_retailprice / 1000.0 AS p FROM part)",
    ),
    "matvec_sparse": (matvec_sparse, "SELECT l_orderkey % 50 AS view_idx, l_suppkey AS pixel, round(sum(l_quantity / 50 * p_size / 10.0), 4) + 0.0 AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
    "residual": (
        residual,
        "WITH e AS (SELECT label, 1 + vec_id % 3 AS w, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, CAST(CAST(avg(v) AS FLOAT) AS DOUBLE) AS p FROM e GROUP BY 1, 2) SELECT label, round(sum(w * w * pow(p - v, 2)) / greatest(sum(w * w * v * v), 1e-12), 5) + 0.0 AS residual, round(0.5 * sum(pow(p - v, 2)), 3) + 0.0 AS data_term FROM e JOIN m USING (label, i) GROUP BY 1",
    ),
}
QUERIES["id_lists"] = (
    id_lists,
    "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || CASE WHEN c_nationkey <> 3 THEN ',3' ELSE '' END || CASE WHEN c_custkey % 4 NOT IN (c_nationkey, 3) THEN ',' || CAST(c_custkey % 4 AS VARCHAR) ELSE '' END AS ids FROM customer",
)
