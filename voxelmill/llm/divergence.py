"""Source divergence audit: term counts of (lang, source) groups against each other and their language, by two-dimensional group-block tiles.

Terms are runs of letters (A-Z lower-cased, and every character beyond ASCII). A language keeps the V terms that at least ``min_docs`` of
its documents hold. With N the group's occurrences of kept terms, a term has p = 1 + floor(10^9 (count + 2) / (N + 2 V)) in the group and
likewise q in another group or the language; two of them differ by floor((p - q)^2 / (p + q)). All arithmetic is on integers.

Groups of a language are dealt into blocks by their source's hash, kept terms into vocabulary chunks by theirs. A group's counts in a chunk are one row,
two packed arrays of places and counts. Each pair of blocks is a tile; the vectors of a group are replicated to the tiles of its block. A
task walks its tile's chunks one after the other and adds up the submatrix of pairs; it holds one chunk of two blocks. Long vocabularies
are cut into spans of chunks, each a task of its own, whose submatrices are added after. What no group of the tile has in a chunk
is added in one go, as all of it has the count 0.

Counts are summed in the task that reads the texts, in a table of bounded size, before they are shuffled; so a hot source costs no more than
its different terms. Ranks within a group are taken of sums, at most one row per other source; of the terms only the first ``top`` of a task go on.

Edge cases: null texts, languages and sources count as empty; a text without terms still makes its group occur, and a language without
kept terms has pairs of value 0; each row is a document, so repeated rows count again; texts of any length are cut into pieces between
terms; ties are ranked by the item's UTF-8 bytes; an empty table gives an empty result; other columns are ignored. Counts may be up to
10^15 / V in all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.llm._base import cut, read_table

MIN_DOCS, TOP = 10, 10
SCALE = 1000  # three times: 10^9
#: Groups a block, terms a chunk (both on average), chunks a span, entries of a reading task's table, bytes of a text that are split at a time.
BLOCK, CHUNK, SPAN, MAX_ENTRIES, PIECE = 8, 4096, 64, 400_000, 1 << 20
#: Bytes of terms stay, A-Z as a-z, all others become blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BREAK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
_ENTRY = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece at a time."""
    start = 0
    while start < len(text):
        end = _BREAK.search(text, min(start + PIECE, len(text)))
        stop = end.start() if end else len(text)
        yield text[start:stop].translate(_TABLE).split()
        start = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), summed over the task as far as MAX_ENTRIES go; an empty term stands for the group itself."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush():
        for (lang, source), (n, docs) in seen.items():
            rows = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], schema=_ENTRY)
        seen.clear()

    for batch in batches:
        texts = batch.column("text")
        for k, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            if (lang, source) not in seen:
                seen[lang, source] = (Counter({b"": 0}), Counter({b"": 0}))
                size += 1
            n, docs = seen[lang, source]
            before, own = len(n), Counter()
            for words in _pieces(texts[k].as_py()):
                own.update(words)
            n.update(own)
            docs.update(own.keys())
            size += len(n) - before
            if size >= MAX_ENTRIES:
                yield from flush()
                size = 0
    yield from flush()


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), in three steps that stay within 64 bits."""
    left, out = count + 2, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        left = left * SCALE
        out = out * SCALE + left // total
        left = left % total
    return 1 + out


def _share(count: Column, total: Column) -> Column:
    """The same as a column."""
    div = lambda a, b: F.call_function("div", a, b)
    out, left = F.lit(0).cast("long"), (count + 2).cast("long")
    for _ in range(3):
        left = left * SCALE
        out, left = out * SCALE + div(left, total), left % total
    return out + 1


def gap(p, q):
    return (p - q) * (p - q) // (p + q)


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs) of every group and term, and with an empty term of every group."""
    given = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    parts = given.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task in the order (lang, left, right, span, chunk): headers, of chunk -1, then vectors. A submatrix per tile and span."""
    key, head, chunk, vectors = None, [], None, {}
    sums = seen = None
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def pairs() -> list[tuple[int, int]]:
        _, left, right, _ = key
        return [(i, j) for i in range(len(head)) for j in range(len(head)) if head[i][1] == left and head[j][1] == right and (left != right or i < j)]

    def add_chunk() -> None:
        nonlocal seen
        if not vectors:
            return
        places = np.unique(np.concatenate([v[0] for v in vectors.values()]))
        p = np.empty((len(head), len(places)), np.int64)
        for i, (source, _, total, _) in enumerate(head):
            counts = np.zeros(len(places), np.int64)
            if source in vectors:
                at, n = vectors[source]
                counts[np.searchsorted(places, at)] = n
            p[i] = share(counts, total)
        for k, (i, j) in enumerate(matrix):
            sums[k] += int(gap(p[i], p[j]).sum())
        seen += len(places)

    def close() -> pa.RecordBatch:
        rest = head[0][3] - seen
        zero = [int(share(np.zeros(1, np.int64), h[2])[0]) if h[2] else 0 for h in head]
        values = [s + (rest * gap(zero[i], zero[j]) if rest else 0) for s, (i, j) in zip(sums, matrix, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(matrix), pa.string()), pa.array([head[i][0] for i, _ in matrix], pa.string()), pa.array([head[j][0] for _, j in matrix], pa.string()), pa.array(values, pa.int64())], schema=schema)

    matrix: list[tuple[int, int]] = []
    for batch in batches:
        places, counts = _lists(batch.column("places")), _lists(batch.column("counts"))
        for at, row in enumerate(batch.drop_columns(["places", "counts"]).to_pylist()):
            this = (row["lang"], row["left"], row["right"], row["span"])
            if this != key or row["chunk"] != chunk:
                if chunk is not None and chunk >= 0:
                    add_chunk()
                vectors = {}
                if this != key:
                    if key is not None:
                        yield close()
                    key, head, matrix, seen = this, [], [], 0
                if row["chunk"] >= 0 and not matrix:
                    matrix = pairs()
                    sums = [0] * len(matrix)
                chunk = row["chunk"]
            if chunk < 0:
                head.append((row["source"], row["block"], row["total"], row["terms"]))
                matrix = pairs()
                sums = [0] * len(matrix)
            else:
                vectors[row["source"]] = (places[at], counts[at])
    if key is not None:
        if chunk >= 0:
            add_chunk()
        yield close()


def pair_values(groups: DataFrame, vectors: DataFrame, spans: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's groups.

    groups (lang, source, block, blocks, total), vectors (lang, source, chunk, places, counts), spans (lang, span, terms): every span of every language.
    """
    tiles = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = groups.select("lang", "source", "block", "total", tiles).select("lang", "source", "block", "total", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    none = F.array().cast("array<long>")
    heads = placed.join(spans, "lang").select("lang", "left", "right", "span", F.lit(-1).cast("long").alias("chunk"), "source", "block", "total", "terms", none.alias("places"), none.alias("counts"))
    bodies = placed.join(vectors, ["lang", "source"]).select("lang", "left", "right", F.floor(F.col("chunk") / SPAN).cast("long").alias("span"), "chunk", "source", "block", "total", F.lit(0).cast("long").alias("terms"), "places", "counts")
    tile = ["lang", "left", "right", "span"]
    rows = heads.unionByName(bodies).repartition(*tile).sortWithinPartitions(*tile, "chunk", "source")
    sums = rows.mapInArrow(_tile, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return sums.select("lang", both.alias("p"), "value").select("lang", "p.source", "p.item", "value")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and each group's ``top`` terms beyond its language's share."""
    counts = cut(term_counts(docs, lang, source, text))
    per_term = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = cut(per_term.select("lang", "term", "all"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("in_all"))
    chunks = F.greatest(F.ceil(F.col("v") / CHUNK), F.lit(1)).cast("long")
    dealt = kept.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), chunks)).repartition("lang", "chunk")
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")).cast("long"))

    known = cut(counts.where("term <> ''").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total_n"))
    names = counts.where("term = ''").select("lang", "source")
    per_lang = names.groupBy("lang").agg(F.count(F.lit(1)).alias("s")).join(sizes, "lang", "left").select("lang", F.greatest(F.ceil(F.col("s") / BLOCK), F.lit(1)).cast("int").alias("blocks"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("in_all", F.lit(0)).alias("in_all"))
    groups = cut(names.join(totals, ["lang", "source"], "left").join(per_lang, "lang").select("lang", "source", "blocks", F.pmod(F.hash("source"), F.col("blocks")).alias("block"), (F.coalesce("total_n", F.lit(0)) + 2 * F.col("v")).alias("total"), "v", "in_all"))

    packed = known.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("x"))
    vectors = packed.select("lang", "source", "chunk", F.col("x.place").alias("places"), F.col("x.n").alias("counts"))
    listed = per_lang.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.ceil(F.col("v") / CHUNK), F.lit(1)) - 1) / SPAN).cast("long"))).alias("span"))
    in_span = numbered.groupBy("lang", F.floor(F.col("chunk") / SPAN).cast("long").alias("span")).agg(F.count(F.lit(1)).alias("terms"))
    spans = listed.join(in_span, ["lang", "span"], "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    pair = pair_values(groups, vectors, spans).withColumn("part", F.lit("pair"))

    both = known.join(groups.select("lang", "source", "total"), ["lang", "source"])
    shares = both.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total")).alias("p"), _share(F.col("all"), F.col("in_all") + 2 * F.col("v")).alias("q")).where("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    term = shares.select("lang", "source", "item", value.alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    first = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).select(columns).unionByName(first.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_all FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(in_all) AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(s.n), 0)::HUGEINT + 2 * coalesce(any_value(v), 0) AS total, coalesce(any_value(l.n), 0)::HUGEINT + 2 * coalesce(any_value(v), 0) AS all_total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) LEFT JOIN l USING (lang) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // total AS p, 1 + (1000000000::HUGEINT * (in_all + 2)) // all_total AS q
      FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
