"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints are 64-bit majorities over XXH64 (seed 42) of three-word shingles, repeats included. Two fingerprints link at
``radius`` = 3 or fewer differing bits. Equal fingerprints are one node from the start. For the rest, the 64 bits are cut
in three blocks and each block in turn is left out: of two different fingerprints within 3 bits, some block holds a
differing bit, so that the other two blocks differ in at most 2 bits, and half of that is a ball of radius 1 on either
side. Every fingerprint emits all variants within that half radius (43 or 44 for each block, 131 in all, where the
undivided radius of 3 would need balls of radius 2, 2,081 variants); variants are shuffled, fingerprints that meet are
verified on all 64 bits. A variant that many fingerprints share gives a forest of verified links, not its pairs: a clique
gives a star. Links then go through connected components.

Edge cases: null or empty text and text without words has fingerprint zero, linked like any other; texts of fewer than
three words have their whole word sequence as the one shingle; a null doc_id counts as the smallest id; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import cut, read_table, restore_id, safe_id
from voxelmill.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: (first bit, bits) of the blocks left out in turn.
BLOCKS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None) -> int:
    """The 64-bit majority fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, last[SHINGLE - 1 :], strict=False)] if len(words) >= SHINGLE else [digest(joined, SEED)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # 64 bytes a shingle at a time
        part = np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp): for each left-out block, the rest and the rest with any one bit flipped. The key's left-out bits hold the block's number."""
    keys, owners = [], []
    for n, (first, bits) in enumerate(BLOCKS):
        out = np.uint64(((1 << bits) - 1) << first)
        flips = np.array([0] + [1 << b for b in range(64) if not first <= b < first + bits], np.uint64)
        base = (fps & ~out) | np.uint64(n << first)
        keys.append((base[:, None] ^ flips[None, :]).reshape(-1))
        owners.append(np.repeat(fps, len(flips)))
    return np.concatenate(keys), np.concatenate(owners)


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all pairs within RADIUS would: a breadth-first search.

    A fingerprint leaves the open ones when it is first reached, so a clique costs one pass and gives a star.
    """
    out, open_ = [], fps
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            x = queue.pop()
            near = np.bitwise_count(open_ ^ x) <= RADIUS
            if near.any():
                out += [(int(x), int(y)) for y in open_[near]]
                queue += list(open_[near])
                open_ = open_[~near]
    return out


def links(distinct_fps: DataFrame, n: int) -> DataFrame:
    """(a, b): verified links that span the same components as all pairs of fingerprints within RADIUS."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for k in range(0, len(fps), 4096):
                key, fp = variants(fps[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if not got:
            return
        key, fp = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order].view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        found: set[tuple[int, int]] = set()
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        found.update(zip(fp[near].tolist(), fp[near + 1].tolist(), strict=True))
        for s, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            found.update(_forest(np.unique(fp[s : s + size])))
        a, b = np.array(sorted(found), np.uint64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], ["a", "b"])

    # a task meets about two million variants: 16 bytes each, and as much again to sort them
    parts = max(1, -(-n * 131 // 2_000_000))
    # emitting is shared out as meeting is, whatever adaptive execution made of the few bytes of fingerprints
    met = distinct_fps.repartition(parts, "fp").mapInArrow(emit, "key long, fp long").repartition(parts, "key").mapInArrow(meet, "a long, b long")
    return met.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row per row of docs."""
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min(safe_id(F.col("doc_id"))).alias("least"))
    roots = components(links(nodes.select("fp"), fps.select("fp").distinct().count()))
    # a component is named by its least document, not by its least fingerprint
    grouped = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", restore_id(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: its least doc_id. Of repeated rows of that id, all but one go too."""
    found = near_duplicates(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(safe_id(F.col("doc_id")).alias("__id")).distinct()
    keyed = docs.select(safe_id(F.col("doc_id")).alias("__id"), F.struct("*").alias("row")).join(kept, "__id", "left_semi")
    return keyed.dropDuplicates(["__id"]).select("row.*")
