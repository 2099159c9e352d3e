"""Benchmark decontamination with DataFrame functions only: size-partitioned MinHash containment search.

Items are short and documents long, so plain Jaccard sketches fail; what counts is containment, the share of an item's
distinct five-word shingles that a document holds. Items are partitioned by their number n of distinct shingles, by powers of two;
partition p has the sizes from 2^p to 2^(p+1) - 1. An item is contained at ``threshold`` or more only if at most floor((1 - threshold) * n)
of its shingles are absent, so of that many and one more of its least shingle hashes one at least is in the document. Each partition's
MinHash sketches are as long as its largest size needs, and a document probes a partition only if it has shingles enough to contain
threshold of the partition's smallest size. Those sketches are the index: it finds every contained item, whatever the documents'
length, and the candidate pairs are verified by the exact shingle containment.

Words are runs of letters and digits, lower-cased; an item of fewer than five words has its whole word sequence as the one
shingle, which a document holds if it has that word sequence anywhere. Index and candidates are broadcast if a count shows them to be
small, and shuffled otherwise; documents are scanned twice, and their texts are shuffled only where the candidates are not small.

Edge cases: null or empty texts, and texts without words, match nothing; repeated items give a row each; rows of one doc_id are one
document, of which the row that holds most of an item counts; a null doc_id or
item_id stays null and is its own group; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import cut, read_table, restore_id, safe_id

SHINGLE, THRESHOLD = 5, 0.8
#: Rows of the sketch index, and candidate documents, up to which they are broadcast (24 bytes each, and 8 for each candidate).
MAX_BROADCAST_ROWS = 500_000
_WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD_BREAK), lambda w: w != "")


def _starts(w: str, n: Column) -> Column:
    return F.slice(w, F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0)))


def _hashes(h: str, n: Column) -> Column:
    """Hashes of all runs of n words, from the column h of the words' own hashes; none if there are fewer words."""
    return F.transform(_starts(h, n), lambda _, i: F.xxhash64(F.slice(h, i + 1, n)))


def _texts(w: str, n: Column) -> Column:
    return F.transform(_starts(w, n), lambda _, i: F.concat_ws(" ", F.slice(w, i + 1, n)))


def sketches(items: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(item, item_id, copies, n_words, shingles, partition, least_size, sketch): one row per item that has words; n_words is 5, or the few it has."""
    w = items.select(safe_id(F.col(f"`{id_col}`")).alias("item_id"), words(F.col(f"`{text_col}`").cast("string")).alias("w")).where(F.size("w") > 0).groupBy("item_id", "w").agg(F.count(F.lit(1)).alias("copies"))
    sized = w.select("item_id", "copies", F.least(F.size("w"), F.lit(SHINGLE)).alias("n_words"), "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    runs = sized.select("item_id", "copies", "n_words", F.array_distinct(_texts("w", F.col("n_words"))).alias("shingles"), F.sort_array(F.array_distinct(_hashes("h", F.col("n_words")))).alias("least"))
    placed = runs.withColumn("partition", F.length(F.bin(F.size("shingles").cast("long"))) - 1)
    smallest, largest = F.expr("shiftleft(1L, partition)"), F.expr("shiftleft(2L, partition) - 1")
    absent = F.floor(F.lit(1.0 - threshold + 1e-9) * largest).cast("int")
    needed = F.ceil(F.lit(threshold - 1e-9) * smallest).cast("int")
    return placed.select(F.monotonically_increasing_id().alias("item"), "item_id", "copies", "n_words", "shingles", "partition", needed.alias("least_size"), F.slice("least", F.lit(1), absent + 1).alias("sketch"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_hits, containment): every pair with containment of threshold or more."""
    known = cut(sketches(items, item_col, item_text, threshold))
    index = _small(known.select("item", "partition", "least_size", "n_words", F.explode("sketch").alias("h")))
    few = sorted(r[0] for r in known.select("n_words").distinct().collect())  # at most five values

    own = docs.select(safe_id(F.col(f"`{id_col}`")).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hashed = own.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    if not few:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles int, n_hits int, containment double")
    # one scan, whatever lengths of shingles the items have
    sets = F.array(*[F.struct(F.lit(n).alias("n_words"), F.array_distinct(_hashes("w", F.lit(n))).alias("hs")) for n in few])
    each_set = hashed.select("doc_id", F.explode(sets).alias("s")).select("doc_id", "s.n_words", "s.hs", F.size("s.hs").alias("n_doc"))
    probes = each_set.select("doc_id", "n_words", "n_doc", F.explode("hs").alias("h"))
    met = probes.join(index, ["n_words", "h"]).where(F.col("n_doc") >= F.col("least_size"))
    candidates = _small(cut(met.groupBy("doc_id").agg(F.collect_set("item").alias("items"))))

    texts = own.join(candidates, "doc_id").select("doc_id", words(F.col("text")).alias("w"), "items")
    each = texts.select("doc_id", "w", F.explode("items").alias("item")).join(known.drop("sketch"), "item")
    held = each.select("doc_id", "item", "item_id", "copies", F.size("shingles").alias("n_shingles"), F.size(F.array_intersect("shingles", _texts("w", F.col("n_words")))).alias("n_hits"))
    # one row per document and item; the threshold comes after the sum, so that it is not pushed below and the arrays met twice
    best = held.groupBy("doc_id", "item", "item_id", "copies", "n_shingles").agg(F.max("n_hits").alias("n_hits"))
    pairs = best.where(F.col("n_hits") >= F.lit(threshold - 1e-9) * F.col("n_shingles")).withColumn("containment", F.col("n_hits") / F.col("n_shingles"))
    out = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(restore_id(F.col("doc_id")).alias("doc_id"), restore_id(F.col("item_id")).alias("item_id"), "n_shingles", "n_hits", "containment")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(safe_id(F.col("doc_id")).alias("id")).distinct()
    rows = docs.select(safe_id(F.col("doc_id")).alias("id"), F.struct("*").alias("row"))
    return rows.join(leaks, "id", "left_anti").select("row.*")


#: Words are runs of letters and digits of the lower-cased text; an item of fewer than five words is one shingle of as many.
SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item, item_id, least(len(w), 5) AS k,
             list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda j: array_to_string(w[j:j + least(len(w), 5) - 1], ' '))) AS g
      FROM i WHERE len(w) > 0),
g AS (SELECT item, item_id, k, len(g) AS n_shingles, unnest(g) AS shingle FROM s),
h AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS shingle
      FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k)
SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_hits,
       count(*) / n_shingles AS containment
FROM h JOIN g USING (k, shingle) GROUP BY doc_id, item, item_id, n_shingles HAVING count(*) >= (0.8 - 1e-9) * n_shingles
"""
