"""Scoring and selection queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators.select import robust_z_score, select_min


def robust_z_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates: robust z-scores of three metrics, weighted sum, best flagged."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    metrics = lines.groupBy("l_suppkey").agg(F.avg("l_discount").alias("residual"), F.stddev_pop("l_quantity").alias("roughness"), F.avg(F.pow(F.least(F.col("l_tax") - 0.04, F.lit(0.0)), 2)).alias("penalty"))
    scored = robust_z_score(metrics, {"residual": 1.0, "roughness": 0.10, "penalty": 0.10}, "score_total")
    best = select_min(scored, "score_total", "l_suppkey").select(F.col("l_suppkey").alias("best_key"))
    return scored.crossJoin(F.broadcast(best)).select("l_suppkey", F.round("score_total", 6).alias("score_total"), (F.col("l_suppkey") == F.col("best_key")).alias("selected"))


ROBUST_Z_SQL = """
WITH m AS (SELECT l_suppkey, avg(l_discount) AS residual, stddev_pop(l_quantity) AS roughness,
                  avg(pow(least(l_tax - 0.04, 0.0), 2)) AS penalty FROM lineitem GROUP BY 1),
q AS (SELECT quantile_cont(residual, 0.25) a25, quantile_cont(residual, 0.5) a50, quantile_cont(residual, 0.75) a75,
             quantile_cont(roughness, 0.25) b25, quantile_cont(roughness, 0.5) b50, quantile_cont(roughness, 0.75) b75,
             quantile_cont(penalty, 0.25) c25, quantile_cont(penalty, 0.5) c50, quantile_cont(penalty, 0.75) c75 FROM m),
s AS (SELECT l_suppkey, 1.0 * (residual - a50) / greatest(a75 - a25, 1e-12)
             + 0.1 * (roughness - b50) / greatest(b75 - b25, 1e-12)
             + 0.1 * (penalty - c50) / greatest(c75 - c25, 1e-12) AS score FROM m, q)
SELECT l_suppkey, round(score, 6) AS score_total,
       l_suppkey = (SELECT arg_min(l_suppkey, score) FROM s) AS selected FROM s
"""

QUERIES = {"robust_z_select": (robust_z_select, ROBUST_Z_SQL)}
