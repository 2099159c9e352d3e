"""The license scan against a plain one: every rule at every word, every pair of matches."""

import re

import duckdb
import numpy as np
import pytest

from voxelmill.llm import licenses
from voxelmill.llm.license_rules import BASE, REACH, rules

SCHEMA = "doc_id long, text string"
RULES = [(r, re.compile(r.pattern)) for r in rules()]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text):
    """(n_words, base places, matches left), without keywords."""
    w = words(text)
    found = []
    for k in range(len(w)):
        near = " ".join(w[k : k + REACH]) + " "
        found += [(k, k + m[0].count(" "), r) for r, p in RULES if (m := p.match(near))]
    left = [(a, b, r) for a, b, r in found if not any(c <= a and d >= b and e.rank < r.rank for c, d, e in found)]
    base = [(k, label) for phrase, label in BASE.items() for k in range(len(w)) if w[k : k + phrase.count(" ") + 1] == phrase.split(" ")]
    return len(w), sorted(base), sorted((a, b, r.label) for a, b, r in left)


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = sorted(licenses.scan(df).collect(), key=lambda r: r["row"]["doc_id"])
    return [(r["n_words"], sorted((d["start"], d["label"]) for d in r["base"]), sorted((d["start"], d["end"], d["label"]) for d in r["found"])) for r in rows]


def test_there_are_hundreds_of_rules_and_each_finds_itself(spark):
    assert len(RULES) >= 250 and len({r.rank for r, _ in RULES}) == len(RULES)
    plain_rules = [r for r, _ in RULES if re.fullmatch(r"\^\(\?:[^\\()\[\]{}?*+|]+\) ", r.pattern)]
    texts = [r.pattern[4:-2] for r in plain_rules]
    assert len(texts) > 60
    for r, got in zip(plain_rules, run(spark, texts), strict=True):
        assert any(a == 0 for a, _, _ in got[2]), r


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_scan(spark, seed):
    rng = np.random.default_rng(seed)
    parts = ["CC BY-NC 4.0", "cc-by", "GNU Lesser General Public License version 2.1 or later", "the GNU General Public License, v3", "General Public Licence", "ALL RIGHTS RESERVED.", "all rights", "reserved", "Permission is hereby granted, free of charge", "SPDX-License-Identifier: Apache-2.0", "BSD 3-Clause License", "in the public domain", "mit", "MIT license", "Copyright (c) 2021 2022", "tous droits réservés", "für", "x9", "gpl", "general", "cc", "by", "\n", "Domaine public", "CC", "BY"]
    texts = [rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(parts, rng.integers(0, 40))) for _ in range(60)]
    assert run(spark, texts) == [plain(t) for t in texts]


def test_containment_and_priority(spark):
    got = run(spark, ["under the GNU Lesser General Public License, version 2.1", "cc by 4.0 and cc by", "Apache License 2.0 mit license"])
    # the longer signature takes the one within, but the phrase of the contract still counts
    assert got[0][1] == [(4, "gpl")] and [x[2] for x in got[0][2]] == ["lgpl-2.1"]
    assert [x[1] for x in got[1][1]] == ["cc-by", "cc-by"] and [x[2] for x in got[1][2]] == ["cc-by-4.0", "cc-by"]
    assert [x[2] for x in got[2][2]] == ["apache-2.0", "mit"]


def test_odd_texts(spark):
    texts = [None, "", "...", "Kcc by", "CC BY", "cc by" * 2, "CC BY " * 30_000, "all rights RESERVED" + "\x00all rights reserved", "İcc by", "a" * 500_000 + " cc by"]
    got = run(spark, texts)
    assert [g[:2] for g in got[:6] + got[7:]] == [plain(t)[:2] for t in texts[:6] + texts[7:]]
    assert got[6][0] == 60_000 and len(got[6][1]) == 30_000
    # Kelvin's sign is no k
    assert run(spark, ["openrail", "blue oaK model license", "blue oak model license"])[1][2] == [] and run(spark, ["blue oak model license"])[0][2]


def test_query_equals_its_sql_and_plain_labels(spark):
    d = "/root/testdata/sf0.001"
    got = licenses.query(spark, d).toArrow()
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
        want = c.sql(licenses.SQL).to_arrow_table()
        texts = dict(c.sql("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(map(repr, got.select(columns).to_pylist())) == sorted(map(repr, want.select(columns).to_pylist()))
    for r in got.to_pylist():
        n, base, left = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(base), *((base[0][0], base[-1][0]) if base else (None, None)))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base})) and r["labels"] == ",".join(sorted({x for _, x in base} | {x[2] for x in left}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(left)


def test_columns_of_any_name_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "cc by", 5, "z")], SCHEMA + ", w int, each string")
    r = licenses.scan(df).first()
    assert r["row"].asDict() == {"doc_id": 1, "text": "cc by", "w": 5, "each": "z"} and len(r["base"]) == 1
    assert licenses.scan(df.limit(0)).count() == 0
