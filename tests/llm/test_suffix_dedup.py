import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from voxelmill.llm import suffix_dedup
from voxelmill.llm.suffix_dedup import Shape

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, starts string, h long"
SMALL = Shape(24, 8)


def plain(rows, window):
    """Per row: n_bytes, spans, kept."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + window] for _, r in raws for k in range(len(r) - window + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                gone[k + 1 : k + 1 + window] = True
        edge = np.diff(gone.astype(np.int8))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((i, len(r), spans, bytes(b for b, g in zip(r, gone[1:], strict=False) if not g)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    alphabet = "abcdé \n" if seed % 2 else "ab"
    make = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [make(rng.randint(20, 90)) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else make(rng.randint(0, 40)) for _ in range(rng.randint(0, 6))]
        rows.append((k, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, "x" * 80), (103, "y" + "x" * 30), (104, "abcab" * 20), (105, None), (None, ""), (None, passages[0]), (106, passages[0][:-1] + "z"), (107, "q" * 23), (108, "w" * 24), (109, "w" * 24)]
    return rows


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_strings(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, None, 0) for r in rows], DOCS)
    assert result(suffix_dedup.dedup(df, shape=SMALL)) == sorted(plain(rows, 24), key=str)


@pytest.mark.parametrize("limits", [{"MAX_GROUP": 1}, {"MAX_GROUP": 2}, {"MAX_FILTER_KEYS": -1}, {"BATCH": 3, "BLOCK": 2}, {"CHUNK": 64}, {"MAX_GROUP": 3, "MAX_FILTER_KEYS": -1, "CHUNK": 30}])
def test_other_sizes_give_the_same(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(5)
    df = spark.createDataFrame([(*r, None, 0) for r in rows], DOCS)
    assert result(suffix_dedup.dedup(df, shape=SMALL)) == sorted(plain(rows, 24), key=str)


def test_a_passage_in_very_many_contexts(spark, monkeypatch):
    """One anchor with hundreds of fragments is split by column range, some of its parts again."""
    monkeypatch.setattr(suffix_dedup, "MAX_GROUP", 40)
    rng = random.Random(8)
    make = lambda k: "".join(rng.choice("abcd") for _ in range(k))
    passage, ends = make(30), [make(12) for _ in range(3)]
    rows = [(k, make(20) + rng.choice(ends) + passage + rng.choice(ends) + make(20)) for k in range(500)]
    df = spark.createDataFrame([(*r, None, 0) for r in rows], DOCS)
    assert result(suffix_dedup.dedup(df, shape=SMALL)) == sorted(plain(rows, 24), key=str)


def test_long_text_among_short_ones(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, long[100_000:100_060] + "zz"), (3, "q" + long[-30:]), (4, long[:23])]
    df = spark.createDataFrame([(*r, None, 0) for r in rows], DOCS)
    assert result(suffix_dedup.dedup(df, shape=SMALL)) == sorted(plain(rows, 24), key=str)


def test_construction_against_pairs(tmp_path):
    rng = random.Random(0)
    group, offset, content = [], [], []
    for g in range(12):
        core = bytes(rng.choice(b"ab") for _ in range(8))
        for _ in range(rng.randint(1, 6)):
            a, b = rng.randint(0, 16), rng.randint(16, 24)
            side = [bytes(rng.choice(b"ab" if rng.random() < 0.2 else b"a") for _ in range(k)) for k in (a, b - 8)]
            if a + b >= 24:
                group.append(g), offset.append(a), content.append(side[0] + core + side[1])
    column0 = [SMALL.grams - 1 - a for a in offset]
    got = suffix_dedup.construct(np.array(group), np.array(column0), list(content), SMALL, str(tmp_path))
    for k, c in enumerate(content):
        for j in range(SMALL.grams):
            i = j - column0[k]
            here = 0 <= i <= len(c) - 24
            want = here and any(m != k and group[m] == group[k] and (x := j - column0[m]) >= 0 and content[m][x : x + 24] == c[i : i + 24] for m in range(len(content)))
            assert got[k, j] == want
    assert not list(tmp_path.iterdir())  # nothing stays


def test_files_hold_the_transform(tmp_path, monkeypatch):
    """The transform by column: the symbols before the sorted suffixes of a collection, right to left."""
    kept = {}
    monkeypatch.setattr(suffix_dedup._Files, "__exit__", lambda self, *_: kept.update(root=self.root))
    rng = random.Random(1)
    content = [bytes(rng.choice(b"ab") for _ in range(SMALL.columns)) for _ in range(9)]
    suffix_dedup.construct(np.zeros(9, int), np.zeros(9, int), list(content), SMALL, str(tmp_path))
    raw = np.fromfile(f"{kept['root']}/transform", np.uint8).reshape(SMALL.columns, 9)
    for turn, column in enumerate(range(SMALL.columns - 1, -1, -1)):
        order = sorted(range(9), key=lambda k: content[k][column + 1 :])
        assert raw[turn].tolist() == [content[k][column] + 1 for k in order]
    order = np.fromfile(f"{kept['root']}/state-{SMALL.columns}", np.uint8, 9).tolist()
    assert [content[k] for k in order] == sorted(content)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in plain(rows, 200)]
    assert sorted(map(tuple, suffix_dedup.query(spark, SF).collect())) == sorted(want)
    empty = spark.createDataFrame([], DOCS)
    assert suffix_dedup.dedup(empty).count() == 0
