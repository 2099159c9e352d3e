"""Results of former runs: volumes that must be there or may be missing, and the saved stages of a fast run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.sources import sinks, tables

# Names of saved results in a run's folders.
BEST, BEST_NOTE, PRIOR, CONFIDENCE, SUPPORT, FINAL = "fdk_best", "best_filter.yaml", "prior_selected", "prior_confidence", "support_mask", "mbir_lite_final"


def _there(spark: SparkSession, path: str) -> bool:
    fs, p = tables.hadoop_path(spark, path)
    return fs.exists(p)


def optional_volume(spark: SparkSession, path: str) -> DataFrame | None:
    """A volume that ``sinks.write_volume`` wrote whole, or None."""
    return spark.read.parquet(path) if _there(spark, f"{path}/_SUCCESS") else None


def required_volume(spark: SparkSession, path: str) -> DataFrame:
    found = optional_volume(spark, path)
    if found is None:
        raise FileNotFoundError(f"the volume {path} is missing")
    return found


@dataclass
class Sweep:
    volume: DataFrame
    filter: str
    cutoff: float


@dataclass
class Prior:
    volume: DataFrame
    confidence: DataFrame
    support: DataFrame  # data of 1.0 or 0.0


def saved_sweep(spark: SparkSession, run: str) -> Sweep | None:
    """The winner of a saved sweep; its filter is "unknown" where no note names it."""
    folder = sinks.fast_folder(spark, run, "fdk_sweep")
    volume = optional_volume(spark, f"{folder}/{BEST}")
    if volume is None:
        return None
    note = f"{folder}/{BEST_NOTE}"
    said = {r["key"]: r["value"] for r in tables.key_values(spark, note).collect()} if _there(spark, note) else {}
    return Sweep(volume, said.get("best_filter", "unknown"), float(said.get("best_cutoff", 1.0)))


def saved_prior(spark: SparkSession, run: str, required: bool = False) -> Prior | None:
    """The saved prior and its confidence; without a saved support mask all of the volume is support."""
    folder = sinks.fast_folder(spark, run, "prior")
    volume, confidence = (optional_volume(spark, f"{folder}/{n}") for n in (PRIOR, CONFIDENCE))
    if volume is None or confidence is None:
        if required:
            raise FileNotFoundError(f"no prior in {folder}")
        return None
    support = optional_volume(spark, f"{folder}/{SUPPORT}")
    return Prior(volume, confidence, volume.withColumn("data", F.transform("data", lambda _: F.lit(1.0).cast("float"))) if support is None else support)


def saved_final(spark: SparkSession, run: str) -> DataFrame | None:
    return optional_volume(spark, f"{sinks.fast_folder(spark, run, 'mbir_lite')}/{FINAL}")


def first_volume(spark: SparkSession, run: str, prior: DataFrame, fdk: DataFrame | None = None, resume: bool = False) -> tuple[DataFrame, str]:
    """Where the last solver starts, and what that is: the saved final volume if it is to go on, else the FDK volume, else the prior."""
    if not resume:
        return (fdk, "fdk") if fdk is not None else (prior, "prior")
    final = saved_final(spark, run)
    if final is None:
        raise FileNotFoundError(f"{run} has no final volume to go on from")
    size = lambda df: df.agg(F.count(F.lit(1)).alias("slices"), F.max(F.size("data")).alias("voxels")).first()
    if size(final) != size(prior):
        raise ValueError("the saved final volume and the prior differ in size")
    return final, "final"
