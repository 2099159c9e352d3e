import random
import re

import duckdb
import pytest

from voxelmill.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, item string, w string", "item_id long, text string, h string"
LONG = " ".join(f"term{k}" for k in range(30))


def plain(docs, items, threshold=0.8):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for j, t in items:
        w = words(t)
        if not w:
            continue
        n = min(5, len(w))
        want = runs(w, n)
        for i, d in dict.fromkeys(docs):
            hits = len(want & runs(words(d), n))
            if hits >= threshold * len(want) - 1e-9 and hits:
                out.append((i, j, len(want), hits))
    return sorted(out, key=str)


def test_cases(spark):
    part = LONG.split()
    items = [(1, LONG), (2, "only three words"), (3, None), (4, "!!! ..."), (5, "One"), (None, " ".join(part[10:20])), (7, LONG), (7, LONG), (8, "über das größte Maß hinaus geht 3 mal")]
    docs = [(10, "before " + LONG.upper().replace(" ", "*** ") + " after"), (11, " ".join(part[:27]) + " x y z"), (12, " ".join(part[:20])), (13, "Only, three words!"), (14, None), (15, ""), (None, "one " + LONG), (16, "ÜBER DAS GRÖßTE MAß HINAUS GEHT 3 MAL"), (17, "three words only"), (18, " ".join(part[:15] + ["q"] + part[15:]))]
    d = spark.createDataFrame([(*r, "i", None) for r in docs], DOCS)
    t = spark.createDataFrame([(*r, None) for r in items], ITEMS)
    got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_hits"]) for r in decontaminate.decontaminate(d, t).collect()), key=str)
    assert got == plain(docs, items)
    assert decontaminate.decontaminate(d.limit(0), t).count() == 0 and decontaminate.decontaminate(d, t.limit(0)).count() == 0
    again = decontaminate.decontaminate(d.union(d), t).count()
    assert again == len(got)


def test_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", -1)
    d = spark.createDataFrame([(1, "a " + LONG, None, None), (2, "b", None, None)], DOCS)
    assert [r["doc_id"] for r in decontaminate.decontaminate(d, spark.createDataFrame([(1, LONG, None)], ITEMS)).collect()] == [1]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = c.sql(decontaminate.SQL).fetchall()
    assert sorted(map(tuple, decontaminate.query(spark, sf).collect())) == sorted(want)


def made_tables(seed=5):
    """Items of many sizes in documents of many sizes, some of them damaged."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 20, 21, 36, 40, 70, 140, 300])))) for k in range(60)]
    docs = []
    for k in range(300):
        parts = [word() for _ in range(rng.choice([0, 3, 50, 400]))]
        if rng.random() < 0.6:
            inner = rng.choice(items)[1].split()
            for _ in range(int(len(inner) * rng.choice([0, 0, 0.01, 0.03, 0.05]))):
                inner[rng.randrange(len(inner))] = word()
            at = rng.randint(0, len(parts))
            parts[at:at] = inner[: int(len(inner) * rng.choice([1, 1, 0.9, 0.8]))]
        docs.append((k, " ".join(parts)))
    return docs, [*items, (60, items[3][1]), (60, items[3][1])]


@pytest.mark.parametrize("most", [None, -1])
def test_sizes_of_all_partitions(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", most)
    docs, items = made_tables()
    known = decontaminate.sketches(spark.createDataFrame([(*r, None) for r in items], ITEMS), "item_id", "text", 0.8).collect()
    assert len({r["partition"] for r in known}) >= 7
    for r in known:
        n = len(r["shingles"])
        assert 2 ** r["partition"] <= n < 2 ** (r["partition"] + 1) and len(r["sketch"]) == min(n, int(0.2 * (2 ** (r["partition"] + 1) - 1) + 1e-6) + 1)
    found = decontaminate.decontaminate(spark.createDataFrame([(*r, None, None) for r in docs], DOCS), spark.createDataFrame([(*r, None) for r in items], ITEMS))
    got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_hits"]) for r in found.collect()), key=str)
    assert got == plain(docs, items) and len(got) > 80


def test_sql_has_short_items(spark, tmp_path):
    docs, items = made_tables(6)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = sorted(c.sql(decontaminate.SQL).fetchall())
    got = sorted(map(tuple, decontaminate.query(spark, str(tmp_path)).collect()))
    short = {i for i, t in items if len(t.split()) < 5}
    assert [r[:4] for r in got] == [r[:4] for r in want] and len({r[1] for r in got} & short) > 3


def test_very_long_text(spark):
    text = "x y z " * 200_000 + LONG + " tail" * 10
    d = spark.createDataFrame([(1, text, None, None), (2, "x y z " * 200_000, None, None)], DOCS)
    assert [r["doc_id"] for r in decontaminate.decontaminate(d, spark.createDataFrame([(1, LONG, None)], ITEMS)).collect()] == [1]


def test_stage_keeps_columns_of_any_name(spark):
    sf = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(1, "clean words", "a", 1, 2, "b"), (2, f"so {leak} so", "c", 3, 4, "d"), (None, None, None, None, None, None), (3, "", "e", 5, 6, "f"), (1, "clean words", "a", 1, 2, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, row int, __id long, item string")
    out = decontaminate.stage(spark, df, sf)
    assert out.columns == df.columns and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[0], *rows[2:]]))


def test_plan_has_no_python(spark):
    df = decontaminate.query(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)
