"""The divergence audit against plain counting in whole numbers."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from voxelmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs, top):
    """{(lang, source, part, item, value, rank)} by Python's integers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        p = lambda c, v=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in v) + 2 * len(v)) for t in v}
        shares = {s: p(counts[lang, s]) for s in sources}
        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(shares[s][t], whole[t])) for t in kept if counts[lang, s][t] and shares[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def documents(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Éa", "éa", "ÜB", "übér", "x9y", "don't"]
    rows = []
    for k in range(n):
        source = [None, "", "s1", "s2", "ÿ", "Z"][rng.integers(6)] if k % 3 else "hot"
        rows.append((k, " ".join(rng.choice(words, rng.integers(0, 30))) if k % 17 else None, [None, "en", "de"][rng.integers(3)], source))
    return rows


def run(spark, rows, **options):
    return {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), **options).collect()}


@pytest.mark.parametrize("block, chunk, span", [(8, 4096, 64), (1, 2, 1), (2, 5, 3)])
def test_against_plain_counting(spark, monkeypatch, block, chunk, span):
    """With small blocks, chunks and spans, every tile meets many of each."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "SPAN", span)
    rows = documents(block)
    got = run(spark, rows, min_docs=4, top=5)
    assert got == plain(rows, 4, 5) and {r[2] for r in got} == {"pair", "term"}


def test_small_tables_of_a_task_and_long_texts(monkeypatch):
    """Flushing early and cutting a text into pieces change no sum."""
    import pyarrow as pa

    rows = documents(3)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": pa.array([(r[1] or "").encode() for r in rows], pa.binary())})

    def sums():
        out = defaultdict(lambda: [0, 0])
        for b in divergence._counted(iter([batch, batch])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"]][0] += r["n"]
                out[r["lang"], r["source"], r["term"]][1] += r["docs"]
        return dict(out)

    whole = sums()
    monkeypatch.setattr(divergence, "MAX_ENTRIES", 7)
    monkeypatch.setattr(divergence, "PIECE", 3)
    assert sums() == whole


def test_shares_are_exact():
    for count, total in ((0, 3), (10**12, 3 * 10**12 + 7), (7 * 10**14, 10**15 + 1), (5, 7)):
        assert int(divergence.share(np.array([count]), total)[0]) == 1 + 10**9 * (count + 2) // total


def test_odd_rows(spark):
    # groups without terms, languages without kept terms, repeated rows, extra columns, one long text
    rows = [(1, None, "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, "x " * 200_000, "en", "b"), (4, "x", "en", "c"), (5, "...", "xx", "a"), (6, "word", "xx", "b")]
    assert run(spark, rows, min_docs=2, top=3) == plain(rows, 2, 3)
    assert {r for r in run(spark, rows, min_docs=2, top=3) if r[0] == "xx"} == {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)}
    more = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA + ", term string, total int")
    assert {tuple(r) for r in divergence.audit(more, min_docs=2, top=3).collect()} == plain(rows, 2, 3)
    assert divergence.audit(more.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    got = divergence.query(spark, "/root/testdata/sf0.001").toArrow()
    with duckdb.connect() as c:
        c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
        want = c.sql(divergence.SQL).to_arrow_table()
    columns = ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(repr, got.select(columns).to_pylist())) == sorted(map(repr, want.select(columns).to_pylist()))
