"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, packing.

Each stage works on all rows that its predecessor kept, whole texts; all but the last return the columns that they were given, of any
name. Null and empty texts, and texts without letters, go with the first stage; a null doc_id counts as one document, smaller than all
others, and keeps its row; of rows that share a doc_id near-dedup keeps one; of near copies the least doc_id stays; a text of any
length is one row throughout; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxelmill.llm import decontaminate, langid, line_dedup, packing, simhash
from voxelmill.llm._base import checkpoint_dir, delete_folder, read_table

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", simhash.stage),
    ("decontaminate", decontaminate.stage),
    ("pack", packing.stage),
]

#: The language model, XXH64 and the packing plan have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each writes Parquet in the shared folder, which the next one reads and then lets go."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if last is not None:
            delete_folder(spark, last)
        last = f"{at}/{name}"
    return docs
