"""License scan with DataFrame functions only: ordered signature rules behind a keyword prefilter, then priority and interval containment.

A text is its words: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Every rule (``license_rules``)
begins with a keyword of one or two words. A word that begins no keyword costs one look-up in a set; where a whole
keyword stands, its rules are matched against the next ``REACH`` words. A match is an interval of words. It is suppressed if a rule of higher priority
(an earlier one) matches an interval that contains it; such an interval begins at most ``REACH`` words before, so each match is held
against its near neighbours only. Everything stays within the row: no shuffle, no Python, and work in proportion to the words.

Edge cases: null and empty texts have no words, no labels and a score of 0; a text of any length is scanned whole; equal rows give equal
results, a row each; ties in an interval go to the earlier rule; a null or repeated id changes nothing; an empty table gives an empty
result; other columns, whatever their names, stay in ``scan`` and are not in the query. The phrases of the contract count wherever their
words stand, suppressed or not. The score is the largest weight of a label that is left.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import read_table
from voxelmill.llm.license_rules import BASE, REACH, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RULE = "rank int, label string, weight double, base boolean, pattern string"


def _rules_by_keyword() -> Column:
    """A map from keyword to its rules, a constant of the plan."""
    by: dict[str, list[dict]] = {}
    for r in rules():
        by.setdefault(r.keyword, []).append({"rank": r.rank, "label": r.label, "weight": r.weight, "base": r.base, "pattern": r.pattern})
    return F.from_json(F.lit(json.dumps(by, ensure_ascii=False)), f"map<string, array<struct<{', '.join(f.replace(' ', ':', 1) for f in _RULE.split(', '))}>>>")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_words, base, found): base and found are arrays of (start, end, label, weight) by words, end exclusive; found has what is not suppressed."""
    keywords = sorted({r.keyword for r in rules()})
    firsts = sorted({k.split(" ")[0] for k in keywords})
    known = _rules_by_keyword()
    words = docs.select(F.struct("*").alias("row"), F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(WORD), 0).alias("w"))
    # the prefilter: places of words that begin a keyword
    begun = words.select("row", "w", F.array_compact(F.transform("w", lambda x, i: F.when(F.lower(x).isin(firsts), i))).alias("places"))
    pair = lambda i: F.lower(F.concat(F.get("w", i), F.lit(" "), F.coalesce(F.get("w", i + 1), F.lit(""))))
    whole = F.filter("places", lambda i: F.lower(F.get("w", i)).isin(keywords) | pair(i).isin(keywords))
    placed = begun.select("row", F.size("w").cast("long").alias("n_words"), "w", whole.alias("places"))
    near = lambda i: F.concat(F.translate(F.array_join(F.slice("w", i + 1, F.lit(REACH)), " "), UPPER, LOWER), F.lit(" "))
    read = placed.select("row", "n_words", F.transform("places", lambda i: F.struct(i.cast("long").alias("start"), near(i).alias("t"))).alias("spots"))

    def matches(spot: Column) -> Column:
        tried = lambda n: F.coalesce(F.try_element_at(known, F.substring_index(spot["t"], " ", n)), F.array().cast(f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in _RULE.split(', '))}>>"))
        words_of = lambda r: (F.size(F.split(F.call_function("regexp_extract", spot["t"], r["pattern"], F.lit(0)), " ")) - 1).cast("long")
        tested = F.transform(F.concat(tried(1), tried(2)), lambda r: F.struct(spot["start"].alias("start"), (spot["start"] + words_of(r)).alias("end"), r["rank"].alias("rank"), r["label"].alias("label"), r["weight"].alias("weight"), r["base"].alias("base")))
        return F.filter(tested, lambda d: d["end"] > d["start"])

    met = read.select("row", "n_words", F.transform("spots", matches).alias("each")).select("row", "n_words", F.filter("each", lambda x: F.size(x) > 0).alias("each"))
    # a place has at most REACH - 1 others before it that can reach over it
    before = lambda k: F.flatten(F.slice("each", F.greatest(k - REACH + 2, F.lit(1)), F.least(k + 1, F.lit(REACH))))
    outdone = lambda d, near: F.exists(near, lambda e: (e["end"] >= d["end"]) & (e["rank"] < d["rank"]))
    left = F.flatten(F.transform("each", lambda found, k: F.flatten(F.transform(F.array(before(k)), lambda near: F.filter(found, lambda d: ~outdone(d, near))))))
    plain = lambda c: F.transform(c, lambda d: F.struct(d["start"], d["end"], d["label"], d["weight"]))
    return met.select("row", "n_words", plain(F.filter(F.flatten("each"), lambda d: d["base"])).alias("base"), plain(left).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(read_table(spark, sf_dir, "documents"))
    label = lambda c: F.transform(c, lambda d: d["label"])
    starts = F.transform("base", lambda d: d["start"])
    listed = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return got.select(
        "row.doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(label("base")).alias("base_labels"), listed(F.concat(label("base"), label("found"))).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = ",\n  ".join(f"({r.rank}, {quote(r.label)}, {r.weight}::DOUBLE, {r.base}, {quote(r.keyword)}, {quote(r.pattern)})" for r in rules())
    firsts = ", ".join(quote(x) for x in sorted({r.keyword.split(" ")[0] for r in rules()}))
    return rf"""
WITH r(rank, label, weight, base, keyword, pattern) AS (VALUES
  {table}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT k, unnest(list_transform(list_filter(range(len(w)), lambda i: w[i + 1] IN ({firsts})), lambda i: {{'start': i, 't': array_to_string(w[i + 1:i + {REACH}], ' ') || ' '}})) AS s FROM d),
m AS (SELECT k, s.start AS start, rank, label, weight, base, len(string_split(regexp_extract(s.t, pattern), ' ')) - 1 AS n
      FROM (SELECT k, s, unnest([split_part(s.t, ' ', 1), split_part(s.t, ' ', 1) || ' ' || split_part(s.t, ' ', 2)]) AS keyword FROM s) JOIN r USING (keyword)),
h AS (SELECT *, start + n AS stop FROM m WHERE n > 0),
f AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h e WHERE e.k = h.k AND e.start <= h.start AND e.stop >= h.stop AND e.rank < h.rank)),
b AS (SELECT k, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h WHERE base GROUP BY k),
l AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM f UNION SELECT k, label FROM h WHERE base) GROUP BY k),
c AS (SELECT k, max(weight) AS score FROM f GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (k) LEFT JOIN l USING (k) LEFT JOIN c USING (k)
"""


SQL = _sql()
assert set(BASE.values()) <= {r.label for r in rules() if r.base}
