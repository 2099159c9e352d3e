"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing. Records with equal payloads of at least ``min_bytes`` bytes share one response record, that of the largest
page_id; the others are revisit records that refer to it and hold no payload. Spark's text sink writes the records, so an
archive goes to any file system that Spark writes to.

Reading. Archives are split at the record magic, wherever that occurs; Spark's text source with that separator does it in
parallel inside large files. Each task gives a candidate record per piece, with its offset and its successor's (from the
header's Content-Length), and follows the successors inside its own split to the first one outside: the exit. A file's
true chain of records begins at its start; pointer jumping over (entry, exit) pairs, one or a few per split, finds where
the chain enters each split, and only candidates on the chain from there are records. A piece off the chain is payload (the
magic occurred inside it) and goes back to the record that it lies in.

A chain that ends before its file does (a damaged header, a file cut off) is an error that names the files; ``chain_breaks`` gives them as
a table, and ``read(..., strict=False)`` the records before the breaks.

Edge cases: a null payload is empty; a null page_id or url is left out of the header and null when read; of repeated rows
with the largest page_id, one is the response; empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.llm._base import checkpoint_dir, cut, read_table, safe_id
from voxelmill.llm.cuckoo import screen_of

MAGIC, CRLF = b"WARC/1.0\r\n", b"\r\n"
DATE = "2000-01-01T00:00:00Z"
_RECORD = uuid.UUID("b9b2b7d8-3c5e-4f0e-9d43-0d2f5a1c7e10")
#: Parts over which the keys of one payload are dealt when they meet their holder.
SALTS = 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: str, page_id: int | None, url: str | None, n_bytes: int, payload: bytes | None, digest: str, refers: str | None, refers_page: int | None) -> bytes:
    """One record without its last line feed; a revisit has no payload but refers to another record's key."""
    block = _HTTP if refers is not None else _HTTP + (payload or b"")
    lines = [f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_RECORD, key)}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        clean = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"X-Payload-Bytes: {n_bytes}")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_RECORD, refers)}>"]
        if refers_page is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_page}")
    lines.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(lines).encode("utf-8", "surrogatepass") + CRLF + CRLF + block + CRLF + b"\r"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write pages as uncompressed archives (one file per task) below path.

    Repeated rows are counted in the narrow table of keys, and revisits are written from it alone. Keys that are no plain
    response (revisits, repeated rows) go to the scan as cuckoo filters, if those are small enough: a row that they reject is
    written by the task that reads it, and only the others' payloads are shuffled to be settled exactly.
    """
    rows = pages.select(safe_id(F.col(id_col)).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.concat_ws("-", "page_id", F.sha1("payload"), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("")))).withColumn("sha", F.sha1("payload"))
    narrow = rows.groupBy("key", "page_id", "url", "sha").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("payload")).alias("n"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    several = narrow.groupBy("sha").agg(F.max(F.struct("page_id", "key")).alias("holder"), F.count(F.lit(1)).alias("k")).where("k > 1")
    holders = several.select("sha", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = narrow.select("*", salt("key")).join(holders, ["sha", "salt"], "left").drop("salt")
    marked = cut(held.withColumns({"holder": F.coalesce("holder", F.struct("page_id", "key")), "shares": F.col("n") >= min_bytes}))
    is_holder = (F.col("key") == F.col("holder.key")) | ~F.col("shares")
    screen = screen_of(marked.where(~is_holder | (F.col("copies") > 1)).select(F.xxhash64("key").alias("h")).distinct())
    sent = pages.sparkSession.sparkContext.broadcast(screen)

    @F.pandas_udf("boolean")
    def special(h):
        import pandas as pd

        return pd.Series(sent.value.keep(h.to_numpy(), {}))

    one, none = F.lit(1).cast("long"), F.lit(None).cast("string")
    last = [none.alias("refers"), none.cast("long").alias("refers_page")]
    wanted = marked.where(is_holder).select("key", F.when(F.col("shares"), one).otherwise(F.col("copies")).alias("times"))
    checked = rows.withColumn("special", special(F.xxhash64("key"))) if screen is not None else rows.withColumn("special", F.lit(True))
    settled = checked.where("special").join(wanted, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "sha", "payload", "times")])
    first = settled.select("key", "page_id", "url", "sha", F.length("payload").cast("long").alias("n"), "payload", *last, F.explode(F.sequence(one, F.col("times"))).alias("copy"))
    if screen is not None:
        first = first.unionByName(checked.where("NOT special").select("key", "page_id", "url", "sha", F.length("payload").cast("long").alias("n"), "payload", *last, one.alias("copy")))
    again = F.col("copies") - F.when(is_holder, F.lit(1)).otherwise(F.lit(0))
    rest = marked.where(F.col("shares") & (again > 0)).select("key", "page_id", "url", "sha", F.col("n").cast("long").alias("n"), F.lit(None).cast("binary").alias("payload"), F.col("holder.key").alias("refers"), F.col("holder.page_id").alias("refers_page"), F.explode(F.sequence(F.lit(2).cast("long"), again + 1)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lambda i: None if i is None or i == -(2**63) else i
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "page_id", "url", "sha", "n", "payload", "refers", "refers_page", "copy")]
            out = [record(f"{key}#{copy}", known(i), url, n, payload, base64.b32encode(bytes.fromhex(sha)).decode(), ref and f"{ref}#1", known(rp)) for key, i, url, sha, n, payload, ref, rp, copy in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # the text sink writes a string's bytes as they are, and ends each record with the line feed that it lacks
    first.unionByName(rest).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def parse(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Headers of a record, where its block starts, and its Content-Length; piece begins after the magic."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = {}
    for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    return (headers, end + 4, int(length)) if length.isascii() and length.isdigit() and "warc-type" in headers else None


class _Split:
    """The pieces of one split, by offsets local to it: a piece's record starts at its offset less the magic."""

    def __init__(self):
        self.at, self.pieces, self.total = [], [], 0

    def add(self, piece: bytes) -> None:
        self.at.append(self.total)
        self.pieces.append(piece)
        self.total += len(piece) + len(MAGIC)

    def successors(self, is_first: bool) -> tuple[list[int], list[int]]:
        """Starts of candidate records and where each one's successor starts. What precedes a file's first magic is none."""
        starts, succ = [], []
        for k, (o, piece) in enumerate(zip(self.at, self.pieces, strict=True)):
            if is_first and k == 0:
                continue
            found = parse(piece)
            if found:
                starts.append(o - len(MAGIC))
                succ.append(o + found[1] + found[2] + 4)
        return starts, succ


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, _Split]]:
    """Columns id, file, split and value: a split's pieces follow one another in order."""
    now, held = None, _Split()
    for batch in batches:
        for key, file, split, piece in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            if (key, file, split) != now:
                if now:
                    yield (*now, held)
                now, held = (key, file, split), _Split()
            held.add(piece)
    if now:
        yield (*now, held)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, file, split, value): id names file and split in 64 bits."""
    pieces = spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    return pieces.select(F.xxhash64("file", "split").alias("id"), "file", "split", "value")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, start, succ, exit, total): candidate records with offsets local to their split; a split without any has one row of nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, file, split, held in _splits(batches):
            starts, succ = held.successors(split == 0)
            exits: dict[int, int] = {}
            for s, t in zip(reversed(starts), reversed(succ), strict=True):  # successors lie ahead
                exits[s] = exits.get(t, t)
            n = max(1, len(starts))
            starts, succ, out = (starts, succ, [exits[s] for s in starts]) if starts else ([None], [None], [None])
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([split] * n, pa.int64()), *[pa.array(x, pa.int64()) for x in (starts, succ, out, [held.total] * n)]], ["file", "split", "start", "succ", "exit", "total"])

    return _pieces(spark, path).mapInArrow(run, "file string, split long, start long, succ long, exit long, total long")


def split_entries(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, split, base, entry, first): where the chain of records enters each split (null: nowhere) and its first candidate, local offsets.
    And (file, at, size) of files whose chain ends at ``at``, before the file does.

    Pointer jumping: from each file's start over entry-to-exit pairs, whose reach doubles each round.
    """
    by_file = Window.partitionBy("file").orderBy("split")
    splits = found.groupBy("file", "split").agg(F.max("total").alias("total"), F.min("start").alias("first"))
    bases = cut(splits.withColumn("base", F.coalesce(F.sum("total").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    placed = found.where("start IS NOT NULL").join(bases.select("file", "split", "base"), ["file", "split"]).select("file", "split", (F.col("start") + F.col("base")).alias("at"), (F.col("exit") + F.col("base")).alias("to"))
    starts = bases.where("split = 0").select("file", F.lit(0).cast("long").alias("at"))
    targets = placed.select("file", F.col("to").alias("at")).unionByName(starts).distinct()
    hops = cut(placed.join(targets, ["file", "at"], "left_semi"))
    reach, jump = starts.join(hops, ["file", "at"], "left_semi").select("file", "at"), hops.select("file", "at", "to")
    n = -1
    while (size := (reach := cut(reach)).count()) != n:
        n = size
        step = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reach = reach.unionByName(step).distinct()
        ahead = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = cut(jump.join(ahead, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")))
    entered = hops.join(reach, ["file", "at"], "left_semi").groupBy("file", "split").agg(F.min("at").alias("at"))
    entries = bases.join(entered, ["file", "split"], "left").select("file", "split", "base", (F.col("at") - F.col("base")).alias("entry"), "first")
    sizes = bases.groupBy("file").agg((F.sum("total") - len(MAGIC)).alias("size"))
    ends = hops.join(reach, ["file", "at"], "left_semi").groupBy("file").agg(F.max("to").alias("at"))
    return entries, sizes.join(ends, "file", "left").select("file", F.coalesce("at", F.lit(0).cast("long")).alias("at"), "size").where("at != size")


def chain_breaks(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, size): the archives below path whose chain of records ends at ``at`` and not at their size."""
    return split_entries(cut(candidates(spark, path)))[1]


_RECORD_COLS = "record_id string, record_type string, page_id long, url string, digest string, n_bytes long, refers_to_id string, refers_to long, payload binary"


def _fields(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(headers[name]) if name in headers else None
    url = headers.get("warc-target-uri")
    url = url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    payload = block[block.find(b"\r\n\r\n") + 4 :] if headers.get("content-type", "").startswith("application/http") else block
    return (headers.get("warc-record-id"), headers["warc-type"], number("x-page-id"), url, headers.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-payload-bytes"), headers.get("warc-refers-to"), number("x-refers-to-page-id"), payload if headers["warc-type"] == "response" else None)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All records of the archives below path; a revisit has no payload of its own. Broken chains are an error, or with strict=False end their file.

    What is broadcast is 16 bytes for each split that its chain enters elsewhere than at its first candidate: at most 16 bytes for
    each spark.sql.files.maxPartitionBytes of the archives (13 MB for 100 TB in splits of 128 MB).
    """
    entries, broken = split_entries(cut(candidates(spark, path)))
    if strict and (some := broken.limit(5).collect()):
        raise ValueError("broken chains of records: " + ", ".join(f"{r['file']} at {r['at']} of {r['size']}" for r in some) + "; see chain_breaks")
    entries = cut(entries)
    odd = entries.where(~F.col("entry").eqNullSafe(F.col("first"))).select(F.xxhash64("file", "split").alias("id"), F.coalesce("entry", F.lit(-1).cast("long")).alias("entry"))
    table = np.array(sorted((r["id"], r["entry"]) for r in odd.collect()), np.int64).reshape(-1, 2)
    sent = spark.sparkContext.broadcast(table)
    source = _pieces(spark, path)

    def entry_of(key: int, first: int | None) -> int | None:
        at = int(np.searchsorted(sent.value[:, 0], key))
        if at == len(sent.value) or sent.value[at, 0] != key:
            return first
        return None if sent.value[at, 1] < 0 else int(sent.value[at, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, file, split, held in _splits(batches):
            starts, succ = held.successors(split == 0)
            ahead = dict(zip(starts, succ, strict=True))
            at = entry_of(key, min(starts, default=None))
            piece_of = {o - len(MAGIC): k for k, o in enumerate(held.at)}
            whole, parts = [], []
            loose = len(held.pieces) if at is None else piece_of[at]
            parts += [(held.at[k], held.pieces[k], False) for k in range(loose)]
            while at in ahead:
                k, end = piece_of[at], ahead[at]
                body = [held.pieces[k]]
                while k + 1 < len(held.at) and held.at[k + 1] - len(MAGIC) < end:
                    k += 1
                    body.append(held.pieces[k])
                data = MAGIC.join(body)
                headers, block, length = parse(body[0])
                if len(data) >= block + length:
                    whole.append(_fields(headers, data[block : block + length]))
                else:
                    parts += [(held.at[j], held.pieces[j], j == piece_of[at]) for j in range(piece_of[at], len(held.at))]
                at = end
            cols = list(zip(*whole, strict=True)) if whole else [()] * 9
            for a in range(0, len(whole), 256):
                yield _batch(file, split, [c[a : a + 256] for c in cols], None)
            for a in range(0, len(parts), 256):
                yield _batch(file, split, None, parts[a : a + 256])

    made = source.mapInArrow(run, f"file string, split long, at long, piece binary, opens boolean, {_RECORD_COLS}")
    names = [c.split()[0] for c in _RECORD_COLS.split(", ")]
    whole = made.where("piece IS NULL").select(*names)
    parts = made.where("piece IS NOT NULL").join(entries.select("file", "split", "base"), ["file", "split"]).select("file", (F.col("at") + F.col("base")).alias("at"), "piece", "opens")
    owner = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    grouped = parts.withColumn("owner", F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(owner)).where("owner IS NOT NULL").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))

    @F.pandas_udf(_RECORD_COLS)
    def join_pieces(pieces):
        import pandas as pd

        out = []
        for row in pieces:
            data = MAGIC.join(bytes(p["piece"]) for p in row)
            headers, block, length = parse(data)
            out.append(_fields(headers, data[block : block + length]) if len(data) >= block + length else (None,) * 9)
        return pd.DataFrame(out, columns=names)

    spanning = grouped.select(join_pieces("pieces").alias("r")).select("r.*").where("record_type IS NOT NULL")
    return whole.unionByName(spanning)


def _batch(file: str, split: int, cols: list | None, parts: list | None) -> pa.RecordBatch:
    n = len(cols[0]) if cols else len(parts)
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    records = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)] if cols else [pa.nulls(n, t) for t in kinds]
    own = [pa.array([p[i] for p in parts], t) if parts else pa.nulls(n, t) for i, t in enumerate((pa.int64(), pa.binary(), pa.bool_()))]
    return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([split] * n, pa.int64()), *own, *records], ["file", "split", "at", "piece", "opens", *[c.split()[0] for c in _RECORD_COLS.split(", ")]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(read_table(spark, sf_dir, "pages"), path)
    back = read(spark, path)

    @F.pandas_udf("string")
    def base32(sha):
        return sha.map(lambda x: None if x is None else base64.b32encode(bytes.fromhex(x)).decode())

    digest = F.when(F.col("record_type") == "response", base32(F.sha1("payload"))).otherwise(F.col("digest"))
    n_bytes = F.when(F.col("record_type") == "response", F.length("payload").cast("long")).otherwise(F.col("n_bytes"))
    return back.select("page_id", n_bytes.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


#: A base32 digest is eight times four letters, each four from five hexadecimal digits.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC) AS k,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder FROM pages),
h AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(sha1(payload), 5 * g + 1, 5) AS BIGINT)) AS fives FROM p)
SELECT page_id, octet_length(payload) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((fives[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN holder END AS refers_to
FROM h
"""
