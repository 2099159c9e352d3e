"""Image queries: each embedding is an 8 x 8 image (row i div 8, column i % 8) of data set ``label``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators import arrays, stats

SIDE = 8
PIXELS = "px AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, data) in double."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("data"))


def rounded(x: Column, digits: int = 5) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def long_form(df: DataFrame, data: Column) -> DataFrame:
    """(vec_id, i, value)."""
    return df.select("vec_id", F.posexplode(data).alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), rounded(F.col("value").cast("double")).alias("value"))


def _over_pixels(expr) -> callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long_form(images(spark, sf_dir), expr(F.col("data")))

    return query


def mean_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean image of each data set."""
    pixels = images(spark, sf_dir).select("label", F.posexplode("data").alias("i", "v"))
    return pixels.groupBy("label", F.col("i").cast("long").alias("i")).agg(rounded(F.avg("v")).alias("value"), F.count(F.lit(1)).alias("n"))


def flat_dark_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attenuation of |image| with the mean of all absolute images as flat field and a tenth of it as dark field."""
    df = images(spark, sf_dir).withColumn("data", F.transform("data", lambda v: F.abs(v)))
    flat = stats.mean_field(df).select(F.col("data").cast("array<double>").alias("flat")).withColumn("dark", F.transform("flat", lambda v: v * 0.1))
    both = df.crossJoin(F.broadcast(flat))  # one row
    t = arrays.flat_dark(F.col("data"), F.col("flat"), F.col("dark"), 1e-6, (1e-6, 2.0))
    return both.select("vec_id", arrays.attenuation(t).alias("a")).select("vec_id", F.posexplode("a").alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), rounded(F.col("value"), 4).alias("value"))


def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image between its percentiles 1 and 99, scaled to [0, 1]."""
    df = images(spark, sf_dir).withColumns({"a": arrays.percentile(F.col("data"), 0.01), "b": arrays.percentile(F.col("data"), 0.99)})
    return long_form(df, arrays.normalise(F.col("data"), F.col("a"), F.col("b"), (0.0, 1.0)))


def _focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness metrics of the images scaled by their own extremes."""
    df = images(spark, sf_dir).withColumns({"a": F.array_min("data"), "b": F.array_max("data")})
    scaled = df.select("vec_id", arrays.normalise(F.col("data"), F.col("a"), F.col("b")).alias("image"))
    image = F.col("image")
    return scaled.select("vec_id", stats.gradient_energy(image, SIDE, SIDE).alias("gradient_energy"), stats.laplacian_variance(image, SIDE, SIDE).alias("laplacian_variance"), stats.shannon_entropy(image).alias("entropy"))


def focus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _focus(spark, sf_dir).select("vec_id", *[rounded(F.col(c)).alias(c) for c in ("gradient_energy", "laplacian_variance", "entropy")])


def combined_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combined scores, the best flagged (rounded first, so that a tie goes to the lower id in either engine)."""
    scored = stats.focus_scores(_focus(spark, sf_dir)).select("vec_id", rounded(F.col("combined_score"), 6).alias("combined_score"))
    best = scored.agg(F.min_by("vec_id", F.struct(-F.col("combined_score"), F.col("vec_id"))).alias("best"))
    return scored.crossJoin(F.broadcast(best)).select("vec_id", "combined_score", (F.col("vec_id") == F.col("best")).alias("selected"))


def image_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms, negative energy, and distance to the mean image of the data set."""
    df = images(spark, sf_dir)
    means = stats.mean_field(df, keys=["label"]).select("label", F.col("data").cast("array<double>").alias("mean"))
    joined = df.join(means, "label")
    n = stats.array_norms("data", "mean")
    got = joined.select("vec_id", *[e.alias(k) for k, e in n.items()])
    return got.select("vec_id", rounded(F.col("sum_sq"), 4).alias("sum_sq"), rounded(F.col("sum_abs"), 4).alias("sum_abs"), rounded(F.col("dot"), 3).alias("dot_mean"), rounded(stats.negative_energy(F.col("neg_sq"), F.col("sum_sq")), 4).alias("negative_energy"), rounded(stats.rmse(F.col("diff_sq"), F.lit(64.0)), 4).alias("rmse"), rounded(stats.relative_change(F.col("diff_sq"), F.col("sum_sq")), 4).alias("relative_change"))


def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three neighbouring pixels taken as red, green and blue."""
    from voxelmill.functions.scalars import gray

    df = images(spark, sf_dir)
    return long_form(df, F.transform(F.sequence(F.lit(0), F.lit(61)), lambda k: gray(F.get("data", k), F.get("data", k + 1), F.get("data", k + 2))))


def preprocess_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preprocessing kernel over |image| in 2 x 2 bins, with the mean absolute image as flat field."""
    from voxelmill.plans.preprocess import Preprocessing, preprocess

    df = images(spark, sf_dir).select(F.col("vec_id").alias("view_idx"), F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), F.transform("data", lambda v: F.abs(v).cast("float")).alias("data"))
    got = preprocess(df, Preprocessing(binning=(2, 2), use_drift=False), flat=df)
    return got.select(F.col("view_idx").alias("vec_id"), F.posexplode("data").alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), rounded(F.col("value").cast("double"), 3).alias("value"))


def confidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp(-(d / tau)^2) of the distance to the data set's mean image, tau twice the image's median distance."""
    df = images(spark, sf_dir)
    means = stats.mean_field(df, keys=["label"]).select("label", F.col("data").cast("array<double>").alias("mean"))
    d = df.join(means, "label").select("vec_id", F.zip_with("data", "mean", lambda a, b: F.abs(a - b)).alias("d")).withColumn("tau", 2 * arrays.percentile(F.col("d"), 0.5) + 1e-12)
    return d.select("vec_id", F.posexplode(F.transform("d", lambda v: F.greatest(F.exp(-(v / F.col("tau")) * (v / F.col("tau"))), F.lit(0.05)))).alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), rounded(F.col("value"), 3).alias("value"))


def _sql(select: str, ctes: str = PIXELS) -> str:
    return f"WITH {ctes} {select}"


_RC = "p AS (SELECT vec_id, v, i, i // 8 AS r, i % 8 AS c FROM px)"
_SCALED = f"{PIXELS}, s AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, (v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-12) AS v FROM px WINDOW w AS (PARTITION BY vec_id))"
_METRICS = (
    _SCALED
    + """,
g AS (SELECT a.vec_id, avg(pow((h.v - l.v) / (h.c - l.c), 2) + pow((d.v - u.v) / (d.r - u.r), 2)) AS gradient_energy
      FROM s a JOIN s l ON l.vec_id = a.vec_id AND l.r = a.r AND l.c = greatest(a.c - 1, 0)
      JOIN s h ON h.vec_id = a.vec_id AND h.r = a.r AND h.c = least(a.c + 1, 7)
      JOIN s u ON u.vec_id = a.vec_id AND u.c = a.c AND u.r = greatest(a.r - 1, 0)
      JOIN s d ON d.vec_id = a.vec_id AND d.c = a.c AND d.r = least(a.r + 1, 7) GROUP BY 1),
l AS (SELECT a.vec_id, var_pop(CASE WHEN a.r BETWEEN 1 AND 6 AND a.c BETWEEN 1 AND 6
             THEN l.v + h.v + u.v + d.v - 4 * a.v ELSE 0 END) AS laplacian_variance
      FROM s a JOIN s l ON l.vec_id = a.vec_id AND l.r = a.r AND l.c = greatest(a.c - 1, 0)
      JOIN s h ON h.vec_id = a.vec_id AND h.r = a.r AND h.c = least(a.c + 1, 7)
      JOIN s u ON u.vec_id = a.vec_id AND u.c = a.c AND u.r = greatest(a.r - 1, 0)
      JOIN s d ON d.vec_id = a.vec_id AND d.c = a.c AND d.r = least(a.r + 1, 7) GROUP BY 1),
b AS (SELECT vec_id, least(floor(v * 256), 255) AS bin, count(*) / 64.0 AS p FROM s GROUP BY 1, 2),
e AS (SELECT vec_id, greatest(-sum(p * ln(p + 1e-12)), 0) AS entropy FROM b GROUP BY 1),
m AS (SELECT * FROM g JOIN l USING (vec_id) JOIN e USING (vec_id))"""
)
_OUT = "round(v, 5) + 0.0 AS value"
_MEAN = f"{PIXELS}, mf AS (SELECT label, i, CAST(CAST(avg(v) AS FLOAT) AS DOUBLE) AS m FROM px GROUP BY 1, 2)"

QUERIES = {
    "block_mean_2d": (_over_pixels(lambda d: arrays.block_mean(d, SIDE, SIDE, 2, 2).cast("array<double>")), _sql("SELECT vec_id, (r // 2) * 4 + c // 2 AS i, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM p GROUP BY ALL", f"{PIXELS}, {_RC}").replace("GROUP BY ALL", "GROUP BY vec_id, (r // 2) * 4 + c // 2")),
    "block_mean_trim": (_over_pixels(lambda d: arrays.block_mean(d, SIDE, SIDE, 3, 3)), _sql("SELECT vec_id, (r // 3) * 2 + c // 3 AS i, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM p WHERE r < 6 AND c < 6 GROUP BY vec_id, (r // 3) * 2 + c // 3", f"{PIXELS}, {_RC}")),
    "crop": (_over_pixels(lambda d: arrays.crop(d, SIDE, SIDE, 1, 2, 0, 3)), _sql(f"SELECT vec_id, (r - 1) * 5 + c AS i, {_OUT} FROM p WHERE r >= 1 AND r < 6 AND c < 5", f"{PIXELS}, {_RC}")),
    "bin_and_crop": (_over_pixels(lambda d: arrays.bin_and_crop(d, SIDE, SIDE, (2, 2), (1, 0, 0, 1))), _sql("SELECT vec_id, (r // 2 - 1) * 3 + c // 2 AS i, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM p WHERE r >= 2 AND c < 6 GROUP BY vec_id, (r // 2 - 1) * 3 + c // 2", f"{PIXELS}, {_RC}")),
    "flip_horizontal": (_over_pixels(lambda d: arrays.flip_horizontal(d, SIDE, SIDE)), _sql(f"SELECT vec_id, r * 8 + 7 - c AS i, {_OUT} FROM p", f"{PIXELS}, {_RC}")),
    "flip_vertical": (_over_pixels(lambda d: arrays.flip_vertical(d, SIDE, SIDE)), _sql(f"SELECT vec_id, (7 - r) * 8 + c AS i, {_OUT} FROM p", f"{PIXELS}, {_RC}")),
    "transpose": (_over_pixels(lambda d: arrays.transpose(d, SIDE, SIDE)), _sql(f"SELECT vec_id, c * 8 + r AS i, {_OUT} FROM p", f"{PIXELS}, {_RC}")),
    "truncation_pad": (
        _over_pixels(lambda d: arrays.truncation_pad(d, SIDE, SIDE, 0.3).cast("array<double>")),
        _sql("SELECT vec_id, r * 12 + k AS i, round(CAST(CAST(v * CASE WHEN k < 2 THEN k WHEN k > 9 THEN 11 - k ELSE 1 END AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM p JOIN (SELECT unnest(range(12)) AS k) ON c = CASE WHEN k < 2 THEN 1 - k WHEN k > 9 THEN 17 - k ELSE k - 2 END", f"{PIXELS}, {_RC}"),
    ),
    "mean_field": (mean_field, _sql("SELECT label, i, round(avg(v), 5) + 0.0 AS value, count(*) AS n FROM px GROUP BY label, i")),
    "flat_dark_log": (
        flat_dark_log,
        _sql(
            "SELECT vec_id, i, round(greatest(-ln(least(greatest(least(greatest((abs(v) - 0.1 * f) / greatest(f - 0.1 * f, 1e-6), 1e-6), 2.0), 1e-6), 2.0)), 0), 4) + 0.0 AS value FROM px JOIN ff USING (i)",
            f"{PIXELS}, ff AS (SELECT i, CAST(CAST(avg(abs(v)) AS FLOAT) AS DOUBLE) AS f FROM px GROUP BY 1)",
        ),
    ),
    "percentile_stretch": (percentile_stretch, _sql("SELECT vec_id, i, round(least(greatest((v - a) / greatest(b - a, 1e-12), 0.0), 1.0), 5) + 0.0 AS value FROM px JOIN (SELECT vec_id, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b FROM px GROUP BY 1) USING (vec_id)")),
    "focus_metrics": (focus_metrics, f"WITH {_METRICS} SELECT vec_id, round(gradient_energy, 5) + 0.0 AS gradient_energy, round(laplacian_variance, 5) + 0.0 AS laplacian_variance, round(entropy, 5) + 0.0 AS entropy FROM m"),
    "combined_focus": (
        combined_focus,
        f"""WITH {_METRICS}, c AS (SELECT vec_id, round(
            0.4 * (gradient_energy - min(gradient_energy) OVER ()) / (max(gradient_energy) OVER () - min(gradient_energy) OVER () + 1e-12)
            + 0.4 * (laplacian_variance - min(laplacian_variance) OVER ()) / (max(laplacian_variance) OVER () - min(laplacian_variance) OVER () + 1e-12)
            + 0.2 * (1 - (entropy - min(entropy) OVER ()) / (max(entropy) OVER () - min(entropy) OVER () + 1e-12)), 6) + 0.0 AS combined_score FROM m)
            SELECT vec_id, combined_score, vec_id = (SELECT vec_id FROM c ORDER BY combined_score DESC, vec_id LIMIT 1) AS selected FROM c""",
    ),
    "image_norms": (
        image_norms,
        _sql(
            "SELECT vec_id, round(sum(v * v), 4) + 0.0 AS sum_sq, round(sum(abs(v)), 4) + 0.0 AS sum_abs, round(sum(v * m), 3) + 0.0 AS dot_mean, round(sum(pow(least(v, 0), 2)) / greatest(sum(v * v), 1e-12), 4) + 0.0 AS negative_energy, round(sqrt(sum(pow(v - m, 2)) / 64), 4) + 0.0 AS rmse, round(sqrt(sum(pow(v - m, 2))) / greatest(sqrt(sum(v * v)), 1e-12), 4) + 0.0 AS relative_change FROM px JOIN mf USING (label, i) GROUP BY vec_id",
            _MEAN,
        ),
    ),
    "gray_pixels": (gray_pixels, _sql("SELECT r.vec_id, r.i, round(0.299 * r.v + 0.587 * g.v + 0.114 * b.v, 5) + 0.0 AS value FROM px r JOIN px g ON g.vec_id = r.vec_id AND g.i = r.i + 1 JOIN px b ON b.vec_id = r.vec_id AND b.i = r.i + 2")),
    "preprocess_views": (
        preprocess_views,
        _sql(
            "SELECT vec_id, i, round(greatest(-ln(least(greatest(b / greatest(f, 1e-6), 1e-6), 2.0)), 0), 3) + 0.0 AS value FROM b JOIN (SELECT i, avg(b) AS f FROM b GROUP BY 1) USING (i)",
            f"{PIXELS}, {_RC}, b AS (SELECT vec_id, (r // 2) * 4 + c // 2 AS i, avg(abs(v)) AS b FROM p GROUP BY vec_id, (r // 2) * 4 + c // 2)",
        ),
    ),
    "confidence_map": (
        confidence_map,
        _sql("SELECT vec_id, i, round(greatest(exp(-pow(d / tau, 2)), 0.05), 3) + 0.0 AS value FROM dd JOIN (SELECT vec_id, 2 * quantile_cont(d, 0.5) + 1e-12 AS tau FROM dd GROUP BY 1) USING (vec_id)", f"{_MEAN}, dd AS (SELECT vec_id, i, abs(v - m) AS d FROM px JOIN mf USING (label, i))"),
    ),
}
