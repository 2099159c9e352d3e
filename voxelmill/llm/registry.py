"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelmill.llm import audio, decontaminate, divergence, langid, licenses, line_dedup, packing, secrets, simhash, suffix_dedup, timestamps, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_simhash": simhash.query,
        "op4_line_dedup": line_dedup.query,
        "op5_decontaminate": decontaminate.query,
        "op6_toxicity": toxicity.query,
        "op7_language_id": langid.query,
        "op8_audio": audio.query,
        "op9_warc": warc.query,
        "op10_secret_scan": secrets.query,
        "op11_license_scan": licenses.query,
        "op12_timestamps": timestamps.query,
        "op13_divergence": divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": suffix_dedup.SQL, "op4_line_dedup": line_dedup.SQL, "op5_decontaminate": decontaminate.SQL, "op9_warc": warc.SQL, "op11_license_scan": licenses.SQL, "op12_timestamps": timestamps.SQL, "op13_divergence": divergence.SQL}
