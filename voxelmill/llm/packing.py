"""Best-fit packing of token sequences by exact-complement hashing.

Texts become ids plus one end id; longer documents are cut into ``capacity`` pieces, of which the first may be shorter.
The planner sees only the histogram of lengths (at most ``capacity`` rows, whatever the input): it opens a sequence with
the longest length left, and looks up the gap in an index of single, pair and triple length sums, consuming a combination
that fills it exactly under the availability counts, as often as the counts allow. Where none exists it puts in the
longest length that fits (best fit) and looks again. Indexes are bit sets of available lengths: a pair that sums to g is
a common bit of the set and of the set mirrored at g.

The plan says, for each length, which ranks go to which sequence and place. A piece's rank among equal lengths comes from
hashed buckets of bounded size: counts per (bucket, length) are summed up over buckets, so no task ranks all pieces of a
frequent length. Each pattern of the plan uses up the count of one length at least, so the plan that is broadcast has
at most a few ``capacity`` patterns at any scale.

Edge cases: null text is empty (one piece, the end id); a null doc_id stays null; repeated rows are packed each on their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.llm import tokens
from voxelmill.llm._base import cut, read_table

CAPACITY, END_ID = 1024, 2
#: Documents whose ids a task holds at a time.
SLICE_ROWS = 200
#: Pieces that one rank bucket holds on average.
BUCKET_ROWS = 8_000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids as little-endian unsigned 32-bit bytes."""
    vocabulary = vocabulary or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.append(tokens.encode(text.as_py() or "", vocabulary), np.uint32(end_id))
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for name, value in zip(out, (doc_id, k, a, b - a, ids[a:b].astype("<u4").tobytes()), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["ids"], pa.binary())], list(out))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class _Available:
    """Counts by length, the set of available lengths as bits, and the same set mirrored."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.count = capacity, [0] * (capacity + 1)
        self.bits = self.mirror = 0
        for length, n in counts.items():
            self.add(length, n)

    def add(self, length: int, n: int) -> None:
        self.count[length] += n
        bit, back = 1 << length, 1 << (self.capacity - length)
        if self.count[length] > 0:
            self.bits, self.mirror = self.bits | bit, self.mirror | back
        else:
            self.bits, self.mirror = self.bits & ~bit, self.mirror & ~back

    def longest(self, at_most: int) -> int:
        return (self.bits & ((2 << at_most) - 1)).bit_length() - 1 if self.bits & ((2 << at_most) - 1) else 0

    def pair(self, total: int, at_most: int) -> tuple[int, int] | None:
        """Lengths a >= b with a + b = total and a <= at_most, a the longest possible."""
        both = self.bits & (self.mirror >> (self.capacity - total)) & ((2 << min(at_most, total - 1)) - 1)
        while both:
            a = both.bit_length() - 1
            b = total - a
            if a < b:
                return None
            if a != b or self.count[a] >= 2:
                return a, b
            both ^= 1 << a
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if self.count[gap] > 0:
            return (gap,)
        if found := self.pair(gap, gap):
            return found
        left = self.bits & ((1 << gap) - 1)
        while left:
            a = left.bit_length() - 1
            if 3 * a < gap:
                return None
            self.add(a, -1)
            found = self.pair(gap - a, a) if gap > a else None
            self.add(a, 1)
            if found:
                return (a, *found)
            left ^= 1 << a
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences each makes."""
    have, made = _Available(counts, capacity), []
    while have.bits:
        pattern, gap = [], capacity
        while gap:
            fill = have.exact(gap) if pattern else None
            fill = fill or ((best,) if (best := have.longest(gap)) else ())
            if not fill:
                break
            for length in fill:
                have.add(length, -1)
                pattern.append(length)
                gap -= length
        used = Counter(pattern)
        more = min(have.count[length] // n for length, n in used.items())
        for length, n in used.items():
            have.add(length, -n * more)
        made.append((tuple(pattern), more + 1))
    return made


def _segments(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence id, places' offset), one for each slot of each pattern."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks, first = [0] * (capacity + 1), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((ranks[length], first, offset))
            ranks[length] += n
            offset += length
        first += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(items: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """items with ``sequence_id`` and ``offset``; lengths are from 1 to capacity.

    items is cut first (its row numbers must not change), so keep it narrow.
    """
    spark = items.sparkSession
    fixed = cut(items.withColumn("__uid", F.monotonically_increasing_id()))
    n_buckets = max(1, -(-fixed.count() // BUCKET_ROWS))
    keyed = fixed.select(F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("item"), F.col(f"`{length_col}`").cast("int").alias("length"), "__uid").withColumn("bucket", F.pmod(F.xxhash64("__uid"), F.lit(n_buckets)).cast("int"))
    cells = keyed.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in keyed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = spark.sparkContext.broadcast(_segments(plan(histogram, capacity), capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            at, table = np.flatnonzero(length == n), sent.value[int(n)]
            slot = np.searchsorted(table[:, 0], rank[at], side="right") - 1
            seq[at] = table[slot, 1] + rank[at] - table[slot, 0]
            off[at] = table[slot, 2]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    within = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("__uid")) - 1
    ranked = keyed.withColumn("k", within).join(bases.drop("n"), ["bucket", "length"]).withColumn("place", place("length", (F.col("base") + F.col("k")).cast("long")))
    return ranked.select("item.*", "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from packed pieces that kept their ids; one has at most capacity pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def packed_documents(docs: DataFrame) -> DataFrame:
    cut_up = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut_up)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each piece of each document lies in the packed sequences."""
    return packed_documents(docs)
