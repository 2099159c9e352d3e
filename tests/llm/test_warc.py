import base64
import hashlib
import random

import pytest

from voxelmill.llm import warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, key string, sha string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    """(page_id, url, digest, type, refers_to), one response for each payload of min_bytes or more."""
    top, out, taken = {}, [], set()
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -(2**63)), -(2**63) if i is None else i)
    for i, u, h in rows:
        best = top[h or ""]
        best_id = None if best == -(2**63) else best
        if len((h or "").encode()) < min_bytes or i == best_id and (h or "") not in taken:
            taken.add(h or "")
            out.append((i, u, digest(h), "response", None))
        else:
            out.append((i, u, digest(h), "revisit", best_id))
    return sorted(out, key=lambda r: str((r[0], r[2], r[3])))


def result(df):
    rows = df.collect()
    for r in rows:
        if r["record_type"] == "response":
            assert digest(bytes(r["payload"]).decode()) == r["digest"] and len(r["payload"]) == r["n_bytes"]
        else:
            assert r["payload"] is None
    return sorted(((r["page_id"], r["url"], r["digest"], r["record_type"], r["refers_to"]) for r in rows), key=lambda r: str((r[0], r[2], r[3])))


def rows_of(n):
    rng = random.Random(4)
    fake = warc.record("fake", 999, "u", 3, b"abc", "X", None, None).decode() + "\n"
    bodies = ["", "<p>é</p>", "WARC/1.0\r\n", "x" * 5000, fake, fake * 40, "a WARC/1.0\r\nContent-Length: 5\r\n\r\n", "\r\n\r\n", "z" + "WARC/1.0\r\n" * 30]
    return [(k, None if k % 7 == 0 else f"http://h/{k}?a=%0A", rng.choice(bodies) + (str(k % 5) * rng.randint(0, 300) if k % 3 else "")) for k in range(n)]


@pytest.mark.parametrize("split", [2000, 50_000, 1 << 27])
def test_round_trip_over_splits(spark, tmp_path, split):
    rows = [*rows_of(150), (None, "u", "y"), (None, None, None), (3, "again", "x" * 5000)]
    df = spark.createDataFrame([(*r, None, "s") for r in rows], PAGES).coalesce(1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write(df, str(tmp_path / "a"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert result(warc.read(spark, str(tmp_path / "a"))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_chains_are_named(spark, tmp_path):
    rows = rows_of(60)
    warc.write(spark.createDataFrame([(*r, None, "s") for r in rows], PAGES).coalesce(1), str(tmp_path / "a"))
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "a").glob("part-*")))
    assert warc.chain_breaks(spark, str(tmp_path / "a")).count() == 0
    at = raw.index(b"X-Page-Id: 30\r\n")
    start = raw.rindex(b"WARC/1.0\r\nWARC-Type", 0, at)
    damaged = raw[:at] + raw[at:].replace(b"Content-Length: ", b"Content-Length: x", 1)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "cut").write_bytes(damaged)
    (tmp_path / "b" / "none").write_bytes(b"no records here")
    (tmp_path / "b" / "whole").write_bytes(raw)
    found = {r["file"].rsplit("/", 1)[1]: (r["at"], r["size"]) for r in warc.chain_breaks(spark, str(tmp_path / "b")).collect()}
    assert found == {"cut": (start, len(damaged)), "none": (0, 15)}
    with pytest.raises(ValueError, match="cut at"):
        warc.read(spark, str(tmp_path / "b"))
    kept = [r["page_id"] for r in warc.read(spark, str(tmp_path / "b"), strict=False).collect()]
    assert 60 < len(kept) < 120 and {k for k in kept if k != 999} == set(range(60))


def test_one_payload_of_most_pages(spark, tmp_path):
    rows = [(k, f"u{k}", "same" if k % 3 else f"own {k}") for k in range(300)]
    warc.write(spark.createDataFrame([(*r, None, "s") for r in rows], PAGES), str(tmp_path / "a"))
    assert result(warc.read(spark, str(tmp_path / "a"))) == expected(rows)


def test_very_long_payload(spark, tmp_path):
    rows = [(1, "u", "é" * 1_500_000), (2, "u", "b" + "WARC/1.0\r\n" * 20_000), (3, "u", "é" * 1_500_000)]
    warc.write(spark.createDataFrame([(*r, None, "s") for r in rows], PAGES), str(tmp_path / "a"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300_000)
    try:
        assert result(warc.read(spark, str(tmp_path / "a"))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_without_screens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("voxelmill.llm.cuckoo.MAX_SCREEN_KEYS", -1)
    rows = rows_of(60)
    warc.write(spark.createDataFrame([(*r, None, "s") for r in rows], PAGES), str(tmp_path / "a"))
    assert result(warc.read(spark, str(tmp_path / "a"))) == expected(rows)


def test_repeated_rows_short_payloads_and_empty_tables(spark, tmp_path):
    rows = [(1, "u", "ab"), (1, "u", "ab"), (2, "u", "ab"), (2, "u", "ab"), (5, "u", "long enough"), (5, "u", "long enough"), (4, "v", "long enough"), (9, None, None)]
    df = spark.createDataFrame([(*r, None, "s") for r in rows], PAGES)
    warc.write(df, str(tmp_path / "a"), min_bytes=5)
    assert result(warc.read(spark, str(tmp_path / "a"))) == expected(rows, 5)
    warc.write(df, str(tmp_path / "b"))
    assert result(warc.read(spark, str(tmp_path / "b"))) == expected(rows)
    warc.write(df.limit(0), str(tmp_path / "c"))
    assert warc.read(spark, str(tmp_path / "c")).count() == 0


def test_query(spark):
    rows = [(r["page_id"], None, r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = [tuple(r) for r in warc.query(spark, SF).collect()]
    size = {i: len((h or "").encode()) for i, _, h in rows}
    want = [(i, size[i], d, t, ref) for i, _, d, t, ref in expected(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
