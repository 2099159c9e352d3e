"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased; keys of at least
``min_chars`` code points count. A key held by at least ``min_docs`` documents is *shared*: all its lines go, except those in its
largest doc_id.

A ``LineIndex`` is three tables: the references (doc_id, key), the reference counts (key, documents, largest holder), and one stack of
cuckoo filters per shard (the key's hash modulo the number of shards) with the shared keys. ``insert`` adds the references that are
new to the counts, and keys that thereby become shared to their shards' filters; ``delete`` takes a document's references out, counts
the keys that it held again from the references that stay, and removes keys that are no longer shared from the filters.
Deleting what was inserted gives back the former decisions. Only changed keys are read to change a filter, in the task of its shard.

``apply`` settles documents: their keys go to the shards, salted by document, where each meets its shard's filter; those that the
filter lets pass are joined with the reference counts, so a filter's false positives change nothing. The query inserts all documents
into an empty index and applies it to them.

Edge cases: null or empty text is one empty line; a null doc_id counts as one document, smaller than all others;
repeated rows of a doc_id count as one document; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import ASCII_SPACE, cut, read_table, safe_id
from voxelmill.llm.cuckoo import Stack

MIN_CHARS, MIN_DOCS = 20, 3
#: Shared keys of a shard (2.4 bytes each) when an index chooses its number of shards; parts that the documents' keys of a shard are dealt over.
SHARD_KEYS, SALTS = 250_000, 16


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line as UTF-8, or None if it is too short to count."""
    key = line.strip(ASCII_SPACE)
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= min_chars else None


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k1, k2): the distinct keys of each row's lines."""
    rows = docs.select(safe_id(F.col(f"`{id_col}`")).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {key_hash(k) for line in (text or "").split("\n") if (k := line_key(line, min_chars)) is not None}
                digests.extend(found)
                ids.extend([doc_id] * len(found))
            k1, k2 = _halves(digests)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k1), pa.array(k2)], ["doc_id", "k1", "k2"])

    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long")


def reference_counts(refs: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, max_doc) of distinct references. Sums and maxima start before the shuffle, so a frequent key is no hot group."""
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _shard(n_shards: int) -> Column:
    return F.pmod(F.col("k2"), F.lit(n_shards)).cast("int").alias("shard")


def _changed_filters(filters: DataFrame, risen: DataFrame, fallen: DataFrame, n_shards: int) -> DataFrame:
    """filters (shard, filter) with the keys (k1, k2) that became shared inserted, and those that no longer are deleted.

    A shard's filter comes first in its task, then the keys: only the filter and a batch are in memory.
    """
    nothing = F.lit(None)
    rows = filters.select("shard", F.lit(0).alias("kind"), nothing.cast("long").alias("k1"), "filter")
    for kind, keys in ((1, fallen), (2, risen)):
        rows = rows.unionByName(keys.select(_shard(n_shards), F.lit(kind).alias("kind"), "k1", nothing.cast("binary").alias("filter")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Stack()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([held.to_bytes()], pa.binary())], ["shard", "filter"])
        for batch in batches:
            for shard, kind, part in _runs(batch):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, held = shard, Stack()
                if kind == 0:
                    held = Stack.from_bytes(part.column(3)[0].as_py())
                else:
                    (held.delete if kind == 1 else held.insert)(part.column(2).to_numpy())
        if now is not None:
            yield done()

    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "shard int, filter binary")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of rows that agree in the first two columns."""
    a, b = (batch.column(k).to_numpy() for k in (0, 1))
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
        yield int(a[s]), int(b[s]), batch.slice(s, e - s)


def _screened(refs: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """The references (doc_id, k1, k2) that their shards' filters let pass.

    References are dealt by shard and salt, and a copy of the shard's filter comes first in each part.
    """
    keys = refs.select(_shard(n_shards), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), "doc_id", "k1", "k2", F.lit(None).cast("binary").alias("filter"))
    copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *[F.lit(None).cast("long").alias(c) for c in ("doc_id", "k1", "k2")], "filter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stack()
        for batch in batches:
            for _, _, part in _runs(batch):
                if part.column(5).null_count < part.num_rows:  # a filter opens its part
                    held, part = Stack.from_bytes(part.column(5)[0].as_py()), part.slice(1)
                if part.num_rows:
                    passed = part.filter(pa.array(held.contains(part.column(3).to_numpy())))
                    yield pa.RecordBatch.from_arrays([passed.column(k) for k in (2, 3, 4)], ["doc_id", "k1", "k2"])

    dealt = keys.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return dealt.mapInArrow(run, "doc_id long, k1 long, k2 long")


def apply_drops(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of docs with struct column ``line_dedup`` (n_lines, n_dropped, kept text) beside its own columns.

    drops: one row per (doc_id, k1, k2) whose lines go.
    """
    per_doc = drops.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys")).select("doc_id", F.expr("transform(keys, x -> x.k1)").alias("a"), F.expr("transform(keys, x -> x.k2)").alias("b"))
    packed = docs.select(safe_id(F.col(f"`{id_col}`")).alias("doc_id"), F.struct("*").alias("row"))
    joined = packed.join(per_doc, "doc_id", "left")

    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def strip_lines(text, a, b):
        import pandas as pd

        out = []
        for t, xs, ys in zip(text, a, b, strict=True):
            lines = (t or "").split("\n")
            if xs is None or not len(xs):
                out.append((len(lines), 0, t or ""))
                continue
            gone = set(zip(np.asarray(xs).tolist(), np.asarray(ys).tolist(), strict=True))
            kept = []
            for line in lines:
                key = line_key(line, min_chars)
                if key is None or tuple(np.frombuffer(key_hash(key), np.int64).tolist()) not in gone:
                    kept.append(line)
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    return joined.withColumn("line_dedup", strip_lines(F.col(f"row.`{text_col}`").cast("string"), "a", "b")).select("row", "line_dedup")


class LineIndex:
    """Incremental, reversible line dedup: see the module. Tables are cut from their lineage at each change.

    refs: (doc_id, k1, k2), distinct; counts: (k1, k2, n_docs, max_doc) of all keys; filters: (shard, filter), one row per shard.
    """

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, n_shards: int, min_chars: int, min_docs: int):
        self.refs, self.counts, self.filters, self.n_shards, self.min_chars, self.min_docs = refs, counts, filters, n_shards, min_chars, min_docs

    @classmethod
    def empty(cls, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        refs = spark.createDataFrame([], "doc_id long, k1 long, k2 long")
        return cls(refs, reference_counts(refs), cls._no_filters(spark, 1), 1, min_chars, min_docs)

    @staticmethod
    def _no_filters(spark: SparkSession, n_shards: int) -> DataFrame:
        return spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), F.lit(Stack().to_bytes()).alias("filter"))

    @property
    def shared(self) -> DataFrame:
        """(k1, k2, max_doc) of the keys that min_docs documents hold."""
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "max_doc")

    def _changed(self, refs: DataFrame, both: DataFrame) -> LineIndex:
        """both: (k1, k2, was, n_docs, max_doc) of all keys that were or are held; was: documents before the change."""
        spark, both = refs.sparkSession, cut(both)
        counts = both.where("n_docs > 0").drop("was")
        is_shared, was_shared = F.col("n_docs") >= self.min_docs, F.col("was") >= self.min_docs
        n_shared = counts.where(is_shared).count()
        if n_shared > 2 * SHARD_KEYS * self.n_shards:  # more shards, filled anew from the counts
            n_shards = -(-n_shared // SHARD_KEYS)
            filters = _changed_filters(self._no_filters(spark, n_shards), both.where(is_shared), both.limit(0), n_shards)
        else:
            n_shards = self.n_shards
            filters = _changed_filters(self.filters, both.where(is_shared & ~was_shared), both.where(was_shared & ~is_shared), n_shards)
        return LineIndex(refs, counts, cut(filters), n_shards, self.min_chars, self.min_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        given = references(docs, id_col, text_col, self.min_chars).distinct()
        fresh = cut(given.join(self.refs, ["doc_id", "k1", "k2"], "left_anti"))
        old = self.counts.select("k1", "k2", F.col("n_docs").alias("was"), "n_docs", "max_doc")
        new = reference_counts(fresh).select("k1", "k2", F.lit(0).cast("long").alias("was"), "n_docs", "max_doc")
        both = old.unionByName(new).groupBy("k1", "k2").agg(F.sum("was").alias("was"), F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        return self._changed(cut(self.refs.unionByName(fresh)), both)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        gone = ids.select(safe_id(F.col(f"`{id_col}`")).alias("doc_id")).distinct()
        refs = cut(self.refs.join(gone, "doc_id", "left_anti"))
        touched = cut(self.refs.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct())
        left = reference_counts(refs.join(touched, ["k1", "k2"], "left_semi"))
        old = self.counts.withColumnRenamed("n_docs", "was")
        same = old.join(touched, ["k1", "k2"], "left_anti").select("k1", "k2", "was", F.col("was").alias("n_docs"), "max_doc")
        changed = old.drop("max_doc").join(touched, ["k1", "k2"], "left_semi").join(left, ["k1", "k2"], "left").select("k1", "k2", "was", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), "max_doc")
        return self._changed(refs, same.unionByName(changed))

    def drops(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, k1, k2) of lines to drop from documents that the index holds."""
        passed = _screened(references(docs, id_col, text_col, self.min_chars), self.filters, self.n_shards)
        return passed.join(self.shared, ["k1", "k2"]).where("doc_id < max_doc").select("doc_id", "k1", "k2").distinct()

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of docs, which the index holds: struct ``row`` (its columns) and struct ``line_dedup`` (n_lines, n_dropped, kept)."""
        return apply_drops(docs, self.drops(docs, id_col, text_col), id_col, text_col, self.min_chars)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """As LineIndex.apply, of an index of just these documents."""
    return LineIndex.empty(docs.sparkSession, min_chars, min_docs).insert(docs, id_col, text_col).apply(docs, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("row.doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shared lines removed; n_chars follows the new text."""
    fields = [F.col("line_dedup.kept").alias("text") if c == "text" else F.length("line_dedup.kept").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return line_dedup(docs).select(*fields)


#: chr(9) to chr(13) and chr(32) are stripped; only A-Z change case.
SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (
  SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE s.key IS NOT NULL AND k.doc_id < s.max_doc) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE s.key IS NULL OR k.doc_id >= s.max_doc), '')) AS kept_sha256
FROM k LEFT JOIN s ON k.key = s.key
GROUP BY k.doc_id
"""
