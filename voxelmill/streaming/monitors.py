"""Structured Streaming over telemetry and metric files.

A directory is the source, as producers write files: no state lives on the driver, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from voxelmill.session import checkpoint_folder
from voxelmill.sources.tables import parse_telemetry


def metric_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of CSV files as they appear; a changed file is a new file."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def event_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str) -> DataFrame:
    """Rows of Parquet files as they appear."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(ts, gpu_id, ...): lines of text files parsed; the time is that of the file."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("line"))
    return parse_telemetry(lines)


def throttle(df: DataFrame, ts: str, keys: list[str], seconds: int = 15, late: str = "30 seconds") -> DataFrame:
    """The first row of each key in each window: one log line per window at most."""
    w = F.window(ts, f"{seconds} seconds")
    rest = [c for c in df.columns if c not in (ts, *keys)]
    first = F.min_by(F.struct(ts, *rest), ts).alias("r")
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(first).select(*keys, F.col("w.start").alias("window_start"), "r.*")


def throttle_since(df: DataFrame, ts: str, keys: list[str], seconds: int = 15, ties: list[str] | None = None) -> DataFrame:
    """The rows of each key that come at least so many seconds after the last row that passed; the first one passes.

    State is one time per key. A batch's rows are taken in the order of their time (and of ``ties``), so what a trigger reads of one key is
    held in a task; rows older than the last that passed never pass.
    """
    import numpy as np
    import pandas as pd

    kinds, period = dict(df.dtypes), seconds * 1_000_000

    def run(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([ts, *(ties or [])], kind="stable", ignore_index=True)
        at = rows[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        last, passed = (state.get[0] if state.exists else None), []
        while True:
            k = 0 if last is None else int(np.searchsorted(at, last + period))
            if k >= len(at):
                break
            passed.append(k)
            last = int(at[k])
        state.update((last,))
        yield rows.iloc[passed]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in df.columns)
    return df.groupBy(*keys).applyInPandasWithState(run, schema, "last long", "append", "NoTimeout")


def window_summary(df: DataFrame, ts: str, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean and extremes of each key over tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("w.start").alias("window_start"), *keys, "n", "mean", "min", "max")


def history(df: DataFrame, key: str, order: str, value: str, n: int = 300) -> DataFrame:
    """Per key the last n values, updated with every batch: bounded state of n numbers a key."""
    import pandas as pd

    kind = dict(df.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            old += list(zip(pdf[order].tolist(), pdf[value].tolist(), strict=True))
        old = sorted(old)[-n:]
        state.update(([o for o, _ in old], [v for _, v in old]))
        yield pd.DataFrame({key: [k[0]], "n": [len(old)], "last": [old[-1][0]], "values": [[v for _, v in old]]})

    narrow = df.select(key, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))
    return narrow.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long, last long, values array<double>", "orders array<long>, vals array<double>", "update", "NoTimeout")


def latest_only(df: DataFrame, request: str, key: str) -> DataFrame:
    """Of each key the result with the newest request; older ones that come late change nothing."""
    rest = [c for c in df.columns if c not in (key, request)]
    return df.groupBy(key).agg(F.max_by(F.struct(request, *rest), request).alias("r")).select(key, "r.*")


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, as Parquet below the shared checkpoint folder; nothing of the result is on the driver.

    A batch that is run again writes over what it wrote. Mode "complete" has the last batch only, "update" the updates of all batches
    under their number ``batch``.
    """
    spark = df.sparkSession
    root = f"{checkpoint_folder(spark)}/{name}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={0 if mode == 'complete' else batch}")

    writer = df.writeStream.foreachBatch(write).queryName(name).outputMode(mode).trigger(availableNow=True)
    query: StreamingQuery = writer.option("checkpointLocation", checkpoint or f"{root}/state").start()
    query.awaitTermination()
    found = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/rows") if query.lastProgress else spark.createDataFrame([], df.schema).withColumn("batch", F.lit(0).cast("long"))
    return found if mode == "update" else found.drop("batch")


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """fn on every micro-batch, one in flight at a time; a batch that is run again has the same number."""
    return df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class ProgressTable(StreamingQueryListener):
    """The progress of every streaming query of the session as JSON files in a folder, a file per batch; ``rows`` reads them as a table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _write(self, name: str, text: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"query": p.name, "id": str(p.id), "run": str(p.runId), "batch": p.batchId, "at": p.timestamp, "rows_in": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "ms": p.durationMs.get("triggerExecution", 0), "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
        self._write(f"{p.id}-{p.batchId:08d}-{p.runId}", json.dumps(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(f"{event.id}-end-{event.runId}", json.dumps({"id": str(event.id), "run": str(event.runId), "error": event.exception}))

    def rows(self) -> DataFrame:
        """(query, id, run, batch, at, rows_in, rows_per_second, ms, state_rows, error): a row per batch, and one with ``error`` (null if all went well) per end."""
        return self.spark.read.schema("query string, id string, run string, batch long, at string, rows_in long, rows_per_second double, ms long, state_rows long, error string").json(self.folder)
