import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from voxelmill.llm import decontaminate, langid, line_dedup, packing, simhash

sys.path.insert(0, str(Path(__file__).parent))
import test_decontaminate  # noqa: E402
import test_langid  # noqa: E402
import test_line_dedup  # noqa: E402
import test_simhash  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Documents with columns that the stages might use names of.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` int, id string, language string, line_dedup string, item long, component_id long, place string, `a.b` string"


def test_stages_one_by_one(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "pack":
            assert docs.columns == before.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    # each stage against its operator on its own input
    before, after = kept["language_id"]
    found = langid.identify(before, langid.fit(before.where(langid.remainder(before.doc_id, 3) != 1))).collect()
    assert ids(after) == {r["row"]["doc_id"] for r in found if r["language"]["lang_pred"] != "und" and r["language"]["score"] >= langid.MIN_SCORE}
    before, after = kept["line_dedup"]
    texts = {r["row"]["doc_id"]: r["line_dedup"]["kept"] for r in line_dedup.line_dedup(before).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == texts and all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = kept["near_dedup"]
    assert ids(after) == {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    before, after = kept["decontaminate"]
    leaks = {r["doc_id"] for r in decontaminate.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(after) == ids(before) - leaks
    before, after = kept["pack"]
    assert ids(after) == ids(before)
    pack = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert pack(after) == pack(packing.packed_documents(before)) == pack(corpus_pipeline.run(spark, SF))


def documents(seed=2):
    rng = random.Random(seed)
    de, en = "der die das und ist nicht ein haus von wald".split(), "the of and to in house from wood is not".split()
    say = lambda words, n: " ".join(rng.choice(words) + (rng.choice("abcdefgh") if rng.random() < 0.3 else "") for _ in range(n))
    texts, shared, leak = [], [say(en, 8) for _ in range(4)], say(en, 30)
    for k in range(80):
        words = de if k % 3 == 0 else en
        texts.append("\n".join(rng.choice(shared) if rng.random() < 0.3 else say(words, rng.randint(1, 20)) for _ in range(rng.randint(1, 6))))
    texts += [texts[4], texts[7], texts[4] + " the", say(en, 5) + " " + leak + " " + say(en, 5), "12345 !?", "", None, "\n\n", say(en, 60_000)]
    rows = [(k, t, "de" if k < 80 and k % 3 == 0 else "en", "s", len(t or ""), k, None, "x", "y", 1, 2, "z", "dot") for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[9], None, None, None, None, None, None, None, None, None, None, None)], [(1, leak), (2, None), (3, "wholly other words that stand nowhere"), (1, leak)]


def brute_force(rows, items):
    """What each stage keeps, as {(doc_id, text)} counts."""
    out = {}
    model = langid.train(sorted((r[2], r[1]) for r in rows if r[2] is not None and r[1] is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 != 1))
    kept = []
    for r in rows:
        emissions, _ = langid._emissions(model, langid._codes(r[1] or ""))
        if len(emissions):
            p, _ = test_langid.plain_marginals(emissions, [len(emissions)], model.transitions)
            if p.mean(axis=0).max() >= langid.MIN_SCORE:
                kept.append((r[0], r[1]))
    out["language_id"] = Counter(kept)
    kept = [(i, t) for i, _, _, t in test_line_dedup.plain(kept)]
    out["line_dedup"] = Counter(kept)
    least = lambda i: -(2**63) if i is None else i
    kept.sort(key=lambda r: least(r[0]))
    root = test_simhash.plain_components([test_simhash.plain_fingerprint(t) for _, t in kept])
    ids = {least(kept[g][0]) for g in set(root)}
    one = {}
    for i, t in kept:
        if least(i) in ids:
            one.setdefault(least(i), (i, t))
    out["near_dedup"] = Counter(one.values())
    leaks = {i for i, *_ in test_decontaminate.plain(list(one.values()), items)}
    out["decontaminate"] = Counter(r for r in one.values() if r[0] not in leaks)
    return out


def test_run_against_brute_force(spark, tmp_path):
    rows, items = documents()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, docs = brute_force(rows, items), spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [sum(c.values()) for c in want.values()]
    assert len(rows) > sizes[0] == sizes[1] > sizes[2] > sizes[3] > 20
    others = {r[0]: r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == [f.strip().split()[0].strip("`") for f in DOCS.split(",")]
        got = docs.collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == want[name], name
        assert all(tuple(r)[5:] == others[r["doc_id"]] for r in got)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(i for i, _ in want["decontaminate"].elements())
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    for n in {r["sequence_id"] for r in pieces}:
        ends = np.cumsum([0, *[r["length"] for r in sorted(pieces, key=lambda r: r["offset"]) if r["sequence_id"] == n]])
        assert ends[:-1].tolist() == sorted(r["offset"] for r in pieces if r["sequence_id"] == n) and ends[-1] <= 1024


def test_run_of_nothing(spark, tmp_path):
    rows, items = documents()
    for table, df in (("documents", spark.createDataFrame(rows, DOCS).where(F.lit(False))), ("benchmark", spark.createDataFrame(items, "item_id long, text string").limit(0))):
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
