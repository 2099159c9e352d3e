import duckdb
import hashlib
import random

import numpy as np

from voxelmill.llm import line_dedup
from voxelmill.llm.cuckoo import CuckooFilter, Stack

DOCS = "doc_id long, text string, k1 long, keys string"


def plain(rows, min_chars=20, min_docs=3):
    """Per row: n_lines, n_dropped, kept text."""
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(line.strip(space).translate(lower), set()).add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(space).translate(lower)) < min_chars or len(holders[k]) < min_docs or max(holders[k]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def cases():
    long = "This line is long enough ÀÉ to be shared"
    odd = " no-break space is kept at the ends "
    rng = random.Random(1)
    rows = [(1, f"a\n{long}\n{long}"), (2, f"  {long.replace('T', 't')}\t\nb"), (3, long + "\r"), (4, None), (5, ""), (6, odd), (7, odd + "\n" + odd), (8, odd), (9, "short\nshort"), (None, long), (None, "x"), (10, "\n\n")]
    lines = [f"shared line number {k} with enough text" for k in range(30)]
    rows += [(100 + n, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for n in range(40)]
    return [*rows, rows[-1]]


def result(df):
    return sorted(((r["row"]["doc_id"], *r["line_dedup"]) for r in df.collect()), key=str)


def test_against_plain(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, 0, None) for i, t in rows], DOCS)
    assert result(line_dedup.line_dedup(df)) == sorted(plain(rows), key=str)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    assert line_dedup.stage(spark, df, "").columns == df.columns


def test_shards_grow(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    rows = cases()
    df = spark.createDataFrame([(i, t, 0, None) for i, t in rows], DOCS)
    made = line_dedup.LineIndex.empty(spark).insert(df)
    assert made.n_shards > 4 and result(made.apply(df)) == sorted(plain(rows), key=str)


def held(index):
    return sum(Stack.from_bytes(bytes(r["filter"])).count for r in index.filters.collect())


def test_index_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    rows = cases()
    make = lambda part: spark.createDataFrame([(i, t, 0, None) for i, t in part], DOCS)
    first, second = [r for r in rows if r[0] is None or r[0] < 120], [r for r in rows if r[0] is not None and r[0] >= 120]
    one = line_dedup.LineIndex.empty(spark).insert(make(first))
    before = result(one.apply(make(first)))
    assert before == sorted(plain(first), key=str)
    both = one.insert(make(second))
    assert result(both.apply(make(rows))) == sorted(plain(rows), key=str)
    again = both.insert(make(second[:5]))  # what it holds already changes nothing
    assert sorted(map(tuple, again.counts.collect())) == sorted(map(tuple, both.counts.collect())) and held(again) == held(both)
    back = again.delete(make(second).select("doc_id"))
    assert result(back.apply(make(first))) == before
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, one.counts.collect()))
    assert held(back) == held(one) == one.shared.count()
    none = back.delete(make(first).select("doc_id"))
    assert held(none) == none.counts.count() == none.refs.count() == 0


def test_filters_take_part(spark):
    """Without its keys in the filters, nothing is shared: the filters decide what is looked up."""
    rows = cases()
    df = spark.createDataFrame([(i, t, 0, None) for i, t in rows], DOCS)
    made = line_dedup.LineIndex.empty(spark).insert(df)
    assert made.drops(df).count() > 0
    made.filters = line_dedup.LineIndex._no_filters(spark, made.n_shards)
    assert made.drops(df).count() == 0


def test_very_long_text(spark):
    line = "a line that three documents share"
    rows = [(1, "\n".join([line] * 100_000)), (2, line), (3, "x" * 2_000_000 + "\n" + line), (4, "x" * 2_000_000)]
    df = spark.createDataFrame([(i, t, 0, None) for i, t in rows], DOCS)
    assert result(line_dedup.line_dedup(df)) == sorted(plain(rows), key=str)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, 50_000)
    made = CuckooFilter.from_bytes(CuckooFilter.build(keys).to_bytes())
    assert made.contains(keys).all() and made.count == len(keys)
    others = rng.integers(-(2**63), 2**63 - 1, 200_000)
    assert made.contains(others).mean() < 5e-4
    assert made.delete(keys[:1000]).all()
    assert made.contains(keys[1000:]).all() and made.contains(keys[:1000]).mean() < 0.01


def test_a_full_filter_stays_as_it_was():
    rng = np.random.default_rng(1)
    made, keys = CuckooFilter(16), rng.integers(-(2**63), 2**63 - 1, 500)
    assert made.insert(keys[:40])
    table = made.table.copy()
    assert not made.insert(keys[40:]) and (made.table == table).all() and made.contains(keys[:40]).all() and made.count == 40


def test_stack_against_a_set():
    rng, made, have = np.random.default_rng(2), Stack(first=8), set()
    pool = rng.integers(-(2**63), 2**63 - 1, 4_000)
    for _ in range(60):
        new = np.array([k for k in rng.choice(pool, 300, replace=False).tolist() if k not in have], np.int64)
        made.insert(new)
        have |= set(new.tolist())
        old = rng.choice(sorted(have), min(len(have), 200), replace=False)
        made.delete(old)
        have -= set(old.tolist())
        assert made.count == len(have) and made.contains(np.array(sorted(have), np.int64)).all()
    made = Stack.from_bytes(made.to_bytes())
    assert made.contains(np.array(sorted(have), np.int64)).all() and len(made.filters) > 1
    gone = np.array(sorted(set(pool.tolist()) - have), np.int64)
    assert made.contains(gone).mean() < 0.02
    made.delete(np.array(sorted(have), np.int64))
    assert made.count == 0 and all((f.table == 0).all() for f in made.filters)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = c.sql(line_dedup.SQL).fetchall()
    got = [tuple(r) for r in line_dedup.query(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert hashlib.sha256(b"").hexdigest() not in {r[3] for r in got if r[1] > 1 and r[2] == 0}
