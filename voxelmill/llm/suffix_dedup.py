"""Suffix-array dedup: removal of byte strings of ``window`` bytes that recur, by column-wise construction.

A byte goes if it is covered by a window-long string that starts anywhere else too. The strings of all documents are brought
together by content: among the gram hashes in a string, the least one (the leftmost, if equal) is its anchor, so equal strings
have equal anchors at equal offsets. The starts that share an anchor are a run; the bytes of its strings are a *fragment*
(at most 2 * window - gram bytes). Only anchors that occur again can matter; the rest never leave the scan's task. Equal fragments
enter once, or twice if there are two or more of them: two are as good as any number.

The fragments of an anchor form a collection whose suffixes are put in order column by column, as in Bauer, Cox and Rosone's BCR and
its extension to common prefixes. Each round inserts one symbol of every fragment, right to left: the symbols before the suffixes, in the
suffixes' order, are the collection's Burrows-Wheeler transform at that column; sorting by them, stably, gives the order of
the suffixes one symbol longer, and least common prefixes between old neighbours give those of the new ones. As fragments
are aligned at the anchor, a string can recur in its own column only, so the transform is kept by column (as in the positional
transform of Durbin 2014) and a round costs one pass over the fragments, not over all symbols inserted so far. Whole texts would
take a round for every byte of the longest one, each over all symbols inserted so far.

Symbols, transform, order and common prefixes are sequential files in the shared folder: a round reads the last round's order and
common prefixes and one column of symbols, and writes the transform and the new order and common prefixes, which are their
only copy until the next round reads them. A start recurs if its suffix has a common prefix of window bytes with a neighbour.

A passage of very many documents has as many contexts, hence one anchor with very many fragments. An anchor with more than
``MAX_GROUP`` is split by column range: halves of its starts' columns, and in each half by the bytes that all strings starting there
have in common places (equal strings agree on them), with equal pieces as one again. Halves of halves follow where that is not
enough; at one column all strings of a part are equal. Every part is put through the same construction.

Edge cases: null text is empty and loses nothing; texts shorter than the window lose nothing; repeated rows are documents of
their own, so they recur; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import checkpoint_dir, cut, delete_folder, read_table
from voxelmill.llm.cuckoo import CuckooFilter, Screen, screen_of

WINDOW, GRAM = 200, 32
#: Different fragments of one anchor up to which it is not split (2 MB); fragments of a construction batch; fragments whose symbols are turned from rows to columns at a time.
MAX_GROUP, BATCH, BLOCK = 5_000, 25_000, 4_096
#: Keys up to which a filter of them (2.4 bytes a key) goes to every executor.
MAX_FILTER_KEYS = 8_000_000
#: Bytes that are hashed at a time; positions inside take POSITION_BITS bits.
CHUNK, POSITION_BITS = 2 << 20, 24
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D]
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Shape:
    window: int = WINDOW
    gram: int = GRAM  # a power of two, at most half the window

    @property
    def grams(self) -> int:
        """Gram positions in a string."""
        return self.window - self.gram + 1

    @property
    def columns(self) -> int:
        """Columns left of the anchor's first byte, and from it on."""
        return self.grams - 1 + self.window


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each position."""
    h, k, n = _BYTES[data], 1, 0
    while k < gram:
        h = h[:-k] * np.uint64(_ODD[n]) + h[k:] if len(h) > k else h[:0]
        k, n = 2 * k, n + 1
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(_ODD[4])
    return h ^ (h >> np.uint64(29))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of the width keys from each position."""
    k = 1
    while 2 * k <= width:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    return np.minimum(key[: len(key) - (width - k)], key[width - k :]) if width > k else key


def runs(data: np.ndarray, bounds: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Runs in documents that follow one another in data, document d up to bounds[d]: first start, starts, anchor position, anchor hash."""
    n = len(data) - shape.window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h = gram_hashes(data, shape.gram)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = _least((h & ~mask) | np.arange(len(h), dtype=np.uint64), shape.grams)
    anchor = (least[:n] & mask).astype(np.int64)
    inside = np.ones(len(data), bool)
    for d in range(1, shape.window):
        at = bounds - d
        inside[at[at >= np.r_[0, bounds[:-1]]]] = False
    starts = np.flatnonzero(inside[:n])
    a = anchor[starts]
    first = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(starts) != 1)]) if len(starts) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(starts)])
    return starts[first], count, a[first], h[a[first]] if len(first) else np.zeros(0, np.uint64)


def _texts(batch: pa.RecordBatch, window: int) -> Iterator[tuple[list[int], list[int], list[int], list[int], bytes, np.ndarray]]:
    """Different texts of a batch (t1, t2, text), CHUNK bytes at a time: keys, weights, where each part begins in its text, the bytes and bounds."""
    rows: dict[tuple[int, int], list] = {}
    for t1, t2, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
        rows.setdefault((t1, t2), [text, 0])[1] += 1
    t1s, t2s, weights, origins, parts, size = [], [], [], [], [], 0
    for (t1, t2), (text, weight) in rows.items():
        raw = (text or "").encode("utf-8", "surrogatepass")
        for a in range(0, max(1, len(raw) - window + 1), CHUNK):  # parts overlap, so that each string lies in just one
            part = raw[a : a + CHUNK + window - 1]
            if size and size + len(part) > CHUNK:
                yield t1s, t2s, weights, origins, b"".join(parts), np.cumsum([len(p) for p in parts])
                t1s, t2s, weights, origins, parts, size = [], [], [], [], [], 0
            for to, value in ((t1s, t1), (t2s, t2), (weights, weight), (origins, a), (parts, part)):
                to.append(value)
            size += len(part)
    if parts:
        yield t1s, t2s, weights, origins, b"".join(parts), np.cumsum([len(p) for p in parts])


def _class_key(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """One long for an anchor and a fragment hash; the JVM has the same in ``_class_column``."""
    return h ^ f


def scan_runs(texts: DataFrame, shape: Shape, what: str, screen: Screen | None = None) -> DataFrame:
    """texts: (t1, t2, text). what: "anchors" gives (h, n); "runs" (h, f, t1, t2, los, weight), one row for all starts of a
    fragment in a text (periodic text repeats one without end); "fragments" (h, f, offset, content).

    screen: keys that may matter: anchors for "runs", classes for "fragments".
    """
    schema = {"anchors": "h long, n long", "runs": "h long, f long, t1 long, t2 long, los array<long>, weight long", "fragments": "h long, f long, offset int, content binary"}[what]
    sent = texts.sparkSession.sparkContext.broadcast(screen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, CuckooFilter] = {}
        for batch in batches:
            for t1s, t2s, weights, origins, raw, bounds in _texts(batch, shape.window):
                lo, n, anchor, h = runs(np.frombuffer(raw, np.uint8), bounds, shape)
                h = h.view(np.int64)
                doc = np.searchsorted(bounds, lo, side="right")
                weight = np.array(weights, np.int64)[doc] if len(lo) else np.zeros(0, np.int64)
                if what == "anchors":
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(weight)], ["h", "n"])
                    continue
                if what == "runs" and sent.value is not None:
                    keep = sent.value.keep(h, filters)
                    lo, n, anchor, h, doc, weight = (x[keep] for x in (lo, n, anchor, h, doc, weight))
                view = memoryview(raw)
                ends = lo + n + shape.window - 1
                f = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(lo.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)
                if what == "runs":
                    at = lo - np.r_[0, bounds[:-1]][doc] + np.array(origins, np.int64)[doc] if len(lo) else lo
                    order = np.lexsort((at, f, h, doc))
                    h, f, doc, at, n, weight = (x[order] for x in (h, f, doc, at, n, weight))
                    one = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(h) != 0) | (np.diff(f) != 0)]) if len(h) else np.zeros(0, np.int64)
                    los = pa.ListArray.from_arrays(pa.array(np.r_[one, len(h)].astype(np.int32)), pa.array(at.astype(np.int64)))
                    times = np.diff(np.r_[one, len(h)])
                    cols = [h[one], f[one], np.array(t1s, np.int64)[doc[one]], np.array(t2s, np.int64)[doc[one]], los, weight[one] * times]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["h", "f", "t1", "t2", "los", "weight"])
                    continue
                if sent.value is not None:
                    keep = sent.value.keep(_class_key(h, f), filters)
                    lo, ends, anchor, h, f = (x[keep] for x in (lo, ends, anchor, h, f))
                _, once = np.unique(np.stack([h, f]), axis=1, return_index=True)
                once.sort()
                content = [raw[lo[k] : ends[k]] for k in once]
                yield pa.RecordBatch.from_arrays([pa.array(h[once]), pa.array(f[once]), pa.array((anchor - lo)[once].astype(np.int32)), pa.array(content, pa.binary())], ["h", "f", "offset", "content"])

    return texts.mapInArrow(run, schema)


class _Files:
    """Sequential files of a construction, in the shared folder."""

    def __init__(self, folder: str):
        self.system, root = fs.FileSystem.from_uri(folder)
        self.root = f"{root}/{uuid.uuid4().hex}"

    def __enter__(self) -> _Files:
        self.system.create_dir(self.root, recursive=True)
        return self

    def __exit__(self, *_) -> None:
        self.system.delete_dir(self.root)

    def reader(self, name: str):
        return self.system.open_input_stream(f"{self.root}/{name}", buffer_size=1 << 16)

    def writer(self, name: str):
        return self.system.open_output_stream(f"{self.root}/{name}", buffer_size=1 << 16)

    def put(self, name: str, *arrays: np.ndarray) -> None:
        with self.writer(name) as out:
            for a in arrays:
                out.write(a.tobytes())

    def take(self, name: str, n: int, *kinds) -> list[np.ndarray]:
        """Read a file and remove it; files are never written over, which some file systems answer with a wait for the disk."""
        with self.reader(name) as source:
            out = [np.frombuffer(source.read(n * np.dtype(k).itemsize), k) for k in kinds]
        self.system.delete_file(f"{self.root}/{name}")
        return out


def _write_symbols(files: _Files, column0: np.ndarray, content: list[bytes], columns: int) -> list[int]:
    """One file per BLOCK strings, its columns one after another from the right; 0 where a string has no byte (nor is it in there)."""
    sizes = []
    for k in range(0, len(content), BLOCK):
        some = content[k : k + BLOCK]
        table = np.zeros((columns, len(some)), np.uint8)
        for j, (c, raw) in enumerate(zip(column0[k : k + BLOCK].tolist(), some, strict=True)):
            table[columns - c - len(raw) : columns - c, j] = np.frombuffer(raw, np.uint8)[::-1]
        files.put(f"symbols-{len(sizes)}", table)
        sizes.append(len(some))
    return sizes


def construct(group: np.ndarray, column0: np.ndarray, content: list[bytes], shape: Shape, folder: str) -> np.ndarray:
    """(strings, grams) flags: whether the window of a string that starts in a column starts in the same column of another of its group.

    group: numbers in ascending order; column0: the column of a string's first byte. content is emptied once it is written.
    """
    n, length = len(content), np.array([len(c) for c in content])
    column0, marks = np.asarray(column0), np.zeros((n, shape.grams), bool)
    last = column0 + length
    base = group.astype(np.int64) * 256
    place_kind, prefix_kind = np.min_scalar_type(n), np.min_scalar_type(shape.window)
    with _Files(folder) as files, ExitStack() as opened:
        sizes = _write_symbols(files, column0, content, shape.columns)
        content.clear()
        symbols = [opened.enter_context(files.reader(f"symbols-{k}")) for k in range(len(sizes))]
        transform = opened.enter_context(files.writer("transform"))
        files.put("state-0", np.arange(n, dtype=place_kind), np.zeros(n, prefix_kind))
        for turn, column in enumerate(range(shape.columns - 1, -1, -1)):
            order, common = files.take(f"state-{turn}", n, place_kind, prefix_kind)
            here = np.concatenate([np.frombuffer(f.read(k), np.uint8) for f, k in zip(symbols, sizes, strict=True)]) + np.uint8(1)  # no byte of UTF-8 is 255
            here[(column < column0) | (column >= last)] = 0
            before = here[order]
            transform.write(before.tobytes())
            place = np.argsort(base[order] + before, kind="stable")
            order, before = order[place], before[place]
            fresh = np.zeros(n, prefix_kind)
            at = np.flatnonzero((before[1:] == before[:-1]) & (base[order[1:]] == base[order[:-1]]) & (before[1:] > 0)) + 1
            if len(at):
                # the least common prefix between the two places in the last order
                spans = np.stack([place[at - 1] + 1, place[at] + 1], axis=1).reshape(-1)
                least = np.minimum.reduceat(np.append(common, common[:1]), spans)[::2]
                fresh[at] = np.minimum(least, shape.window - 1) + prefix_kind.type(1)
            files.put(f"state-{turn + 1}", order, fresh)
            if column < shape.grams:
                full = fresh >= shape.window
                recurs = full.copy()
                recurs[:-1] |= full[1:]
                marks[order[recurs], column] = True
            del order, common, fresh, before, here
    return marks


_FOUND = "g long, f long, firsts array<int>, lasts array<int>"


def _construct_all(pieces: DataFrame, shape: Shape, folder: str) -> DataFrame:
    """pieces: (g, f, column0, content, twice). (g, f, firsts, lasts): the runs of starts that recur, counted from a piece's first, where there are any."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.array([r[0] for r in rows], np.int64)
        number = np.r_[0, np.cumsum(keys[1:] != keys[:-1])]
        own = np.repeat(np.arange(len(rows)), [2 if r[4] else 1 for r in rows])  # which row each string is of
        column0 = np.array([r[2] for r in rows])
        content = [rows[k][3] for k in own]
        ids = [(r[0], r[1]) for r in rows]
        rows.clear()
        marks = construct(number[own], column0[own], content, shape, folder)
        marks = np.logical_or.reduceat(marks, np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), axis=0)
        edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, first), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        some, count = np.unique(row, return_counts=True)
        edges = np.r_[0, np.cumsum(count)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array((x - column0[row]).astype(np.int32))) for x in (first, end - 1)]
        return pa.RecordBatch.from_arrays([*[pa.array([ids[k][j] for k in some.tolist()], pa.int64()) for j in (0, 1)], *lists], ["g", "f", "firsts", "lasts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield flush(held)
                held.append(row)
        if held:
            yield flush(held)

    return pieces.select("g", "f", "column0", "content", "twice").repartition("g").sortWithinPartitions("g").mapInArrow(run, _FOUND)


def _halves(pieces: DataFrame, shape: Shape) -> DataFrame:
    """pieces: (g, f, a, b, column0, content, twice), groups whose starts lie in columns a to b - 1. The same of both halves' groups, with what each piece is of: (old_g, old_f, ahead)."""
    names = ["old_g", "old_f", "ahead", "g", "f", "a", "b", "column0", "content", "twice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, f, a, b, column0, content, twice in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                middle = (a + b) // 2
                for x, y in ((a, middle), (middle, b)):
                    first, end = max(column0, x), min(column0 + len(content) - shape.window + 1, y)
                    if first < end:
                        part = content[first - column0 : end - column0 + shape.window - 1]
                        both = part[y - 1 - first : x + shape.window - first]  # what every string that starts in x to y - 1 has
                        key = xxhash.xxh3_64_intdigest(both + f"|{g}|{x}|{y}".encode())
                        own = xxhash.xxh3_64_intdigest(part + f"|{first}".encode())
                        out.append((g, f, first - column0, key, own, x, y, first, part, twice))
            cols = list(zip(*out, strict=True)) or [()] * 10
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            kinds = (pa.int64(), pa.int64(), pa.int32(), None, None, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([signed(c) if t is None else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    schema = "old_g long, old_f long, ahead int, g long, f long, a int, b int, column0 int, content binary, twice boolean"
    return pieces.select("g", "f", "a", "b", "column0", "content", "twice").mapInArrow(run, schema)


def _split_and_construct(fragments: DataFrame, shape: Shape, folder: str) -> DataFrame:
    """As _construct_all, for anchors with more than MAX_GROUP fragments (g, f, column0, content, twice)."""
    pieces = fragments.select("g", "f", F.lit(0).alias("a"), F.lit(shape.grams).alias("b"), "column0", "content", "twice")
    # which piece's starts are whose: from_ starts after the first of (h0, f0)
    owners, out = pieces.select(F.col("g").alias("h0"), F.col("f").alias("f0"), F.lit(0).alias("from_"), "g", "f"), None
    while True:
        parts = cut(_halves(pieces, shape))
        owners = cut(owners.join(parts.select(F.col("old_g").alias("g"), F.col("old_f").alias("f"), "ahead", F.col("g").alias("new_g"), F.col("f").alias("new_f")), ["g", "f"]).select("h0", "f0", (F.col("from_") + F.col("ahead")).alias("from_"), F.col("new_g").alias("g"), F.col("new_f").alias("f")))
        equal = parts.groupBy("g", "f", "a", "b", "column0").agg(F.first("content").alias("content"), (F.max("twice") | (F.count(F.lit(1)) > 1)).alias("twice"))
        sizes = parts.groupBy("g").agg(F.count_distinct("f").alias("k"))
        sized = cut(equal.join(sizes, "g"))
        small = sized.where(F.col("k") <= MAX_GROUP)
        found = _construct_all(small, shape, folder).join(owners, ["g", "f"]).select("h0", "f0", F.transform("firsts", lambda x: x + F.col("from_")).alias("firsts"), F.transform("lasts", lambda x: x + F.col("from_")).alias("lasts"))
        out = found if out is None else out.unionByName(found)
        pieces = sized.where(F.col("k") > MAX_GROUP).drop("k")
        if pieces.isEmpty():
            return out.groupBy("h0", "f0").agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("lasts")).alias("lasts")).select(F.col("h0").alias("g"), F.col("f0").alias("f"), "firsts", "lasts")


def _fragments(texts: DataFrame, active: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """(g, f, column0, content, twice, k), one row per class (h, f, c, k)."""
    screen = screen_of(classes.select(F.expr("h ^ f").alias("key")).distinct(), MAX_FILTER_KEYS)
    if screen is not None:
        found = scan_runs(texts, shape, "fragments", screen).join(classes, ["h", "f"])
    else:  # too many classes to screen for: let one text of each class, by its key, give the fragment
        holder = active.groupBy("h", "f").agg(F.min(F.struct("t1", "t2")).alias("t")).select("t.t1", "t.t2").distinct()
        held = texts.join(holder, ["t1", "t2"], "left_semi").select("t1", "t2", "text")
        found = scan_runs(held, shape, "fragments").join(classes, ["h", "f"])
    one = found.groupBy("h", "f").agg(*[F.first(x).alias(x) for x in ("offset", "content", "c", "k")])
    return one.select(F.col("h").alias("g"), "f", (F.lit(shape.grams - 1) - F.col("offset")).alias("column0"), "content", (F.col("c") > 1).alias("twice"), "k")


def repeated_starts(texts: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """texts: (t1, t2, text). (t1, t2, firsts, lasts): the runs of starts whose strings recur, for each key that has any."""
    spark = texts.sparkSession
    seen = scan_runs(texts, shape, "anchors").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2").select("h")
    again = cut(seen)
    active = cut(scan_runs(texts, shape, "runs", screen_of(again, MAX_FILTER_KEYS)).join(again, "h", "left_semi"))
    classes = active.groupBy("h", "f").agg(F.sum("weight").alias("c"))
    sizes = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    classes = cut(classes.join(sizes, "h"))
    fragments = _fragments(texts, active, classes, shape)
    folder = f"{checkpoint_dir(spark)}/suffixes-{uuid.uuid4().hex}"
    if classes.where(F.col("k") > MAX_GROUP).isEmpty():
        found = _construct_all(fragments, shape, folder)
    else:
        fragments = cut(fragments)
        found = _construct_all(fragments.where(F.col("k") <= MAX_GROUP), shape, folder).unionByName(_split_and_construct(fragments.where(F.col("k") > MAX_GROUP), shape, folder))
    marked = cut(found)
    delete_folder(spark, folder)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts of a fragment in a text, and runs from its first start on: every run at every start."""
        for batch in batches:
            los, runs_ = batch.column(2), batch.column(3).value_lengths().to_numpy()
            times = los.value_lengths().to_numpy()
            total = times.astype(np.int64) * runs_
            edges = np.r_[0, np.cumsum(total)]
            row = np.repeat(np.arange(len(total)), total)
            within = np.arange(edges[-1]) - edges[row]
            lo = los.flatten().to_numpy()[(np.r_[0, np.cumsum(times)][row] + within // np.maximum(runs_[row], 1)).astype(np.int64)]
            of_run = (np.r_[0, np.cumsum(runs_)][row] + within % np.maximum(runs_[row], 1)).astype(np.int64)
            ends = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(lo + batch.column(c).flatten().to_numpy()[of_run])) for c in (3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ends], ["t1", "t2", "firsts", "lasts"])

    # the same text in another task gives the same row again
    one = active.join(marked.withColumnRenamed("g", "h"), ["h", "f"]).withColumn("lo", F.get("los", 0)).dropDuplicates(["t1", "t2", "h", "f", "lo"])
    each = one.select("t1", "t2", "los", "firsts", "lasts").mapInArrow(spans, "t1 long, t2 long, firsts array<long>, lasts array<long>")
    return each.groupBy("t1", "t2").agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("lasts")).alias("lasts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte spans (start, end) and the bytes that stay, one row per row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})
    starts = repeated_starts(keyed.select("t1", "t2", "text"), shape)
    window = shape.window

    @F.pandas_udf("n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    def remove(text, firsts, lasts):
        import pandas as pd

        out = []
        for t, first, last in zip(text, firsts, lasts, strict=True):
            raw, a, b = t.encode("utf-8", "surrogatepass"), [], []
            if first is not None and len(first):
                order = np.argsort(first, kind="stable")
                reach = np.maximum.accumulate(np.asarray(last)[order] + window)
                opens = np.flatnonzero(np.r_[True, np.asarray(first)[order][1:] > reach[:-1]])
                a, b = np.asarray(first)[order][opens].tolist(), reach[np.r_[opens[1:] - 1, len(reach) - 1]].tolist()
            kept = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True))
            out.append((len(raw), [{"start": x, "end": y} for x, y in zip(a, b, strict=True)], kept))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])

    return keyed.join(starts, ["t1", "t2"], "left").select("doc_id", remove("text", "firsts", "lasts").alias("r")).select("doc_id", "r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(read_table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of every text by its MD5; removed runs are islands of recurring starts less than a window apart.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200),
h AS (SELECT r, i, md5(b[i:i + 199]) AS m FROM w),
s AS (SELECT r, i FROM h WHERE m IN (SELECT m FROM h GROUP BY m HAVING count(*) > 1)),
e AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM s),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM e),
t AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY r, k),
u AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS y FROM t),
k AS (SELECT r, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS last,
             string_agg(CASE WHEN a > y + 1 THEN hex(d.b[y + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS kept
      FROM u JOIN d USING (r) GROUP BY r)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN k.r IS NULL THEN d.b
                   ELSE unhex(kept || CASE WHEN last < octet_length(d.b) THEN hex(d.b[last + 1:octet_length(d.b)]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
