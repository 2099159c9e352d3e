import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from voxelmill.llm import langid

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, language string, score string"


def plain_marginals(emissions, lengths, transitions):
    a, out, pairs, at = np.exp(transitions.astype(float)), [], np.zeros(transitions.shape), 0
    for n in lengths:
        e, fwd, m = np.exp(emissions[at : at + n].astype(float)), [], np.full(len(a), 1 / len(a))
        for t in range(n):
            m = (m @ a) * e[t]
            fwd.append(m := m / m.sum())
        b, back = np.ones(len(a)), []
        for t in range(n - 1, -1, -1):
            back.append(b)
            b = a @ (e[t] * b)
            b /= b.sum()
        for t, beta in enumerate(reversed(back)):
            q = fwd[t] * beta
            out.append(q / q.sum())
            if t:
                j = fwd[t - 1][:, None] * a * (e[t] * beta)[None]
                pairs += j / j.sum()
        at += n
    return np.array(out), pairs


def test_forward_backward_over_segments():
    rng = np.random.default_rng(0)
    lengths = np.array([100, 1, 48, 29, 200])
    e, t = rng.normal(size=(lengths.sum(), 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    got, pairs = langid.marginals(e, lengths, t, want_pairs=True)
    want, want_pairs = plain_marginals(e, lengths, t)
    assert np.allclose(got, want, atol=1e-4) and np.allclose(pairs, want_pairs, atol=1e-2)


def test_word_features_do_not_depend_on_neighbours():
    a, b = langid.word_features(langid._codes("Été")), langid.word_features(langid._codes("x été, ab c"))
    assert len(a) == 1 and len(b) == 4
    assert (a.fields[0] == b.fields[1]).all() and (a.trigrams == b.trigrams[b.starts[1] : b.starts[2]]).all()


def test_chunks_change_nothing(monkeypatch):
    rng = random.Random(1)
    words = ["der", "und", "the", "and", "écoute", "x"]
    model = langid.train([(lang, " ".join(rng.choice(w) for _ in range(200))) for lang, w in (("de", words[:2]), ("en", words[2:4]))])
    text = " ".join(rng.choice(words) for _ in range(3000)) + "z" * 9000
    whole = langid.classify(model, [text, "und", "", None])
    monkeypatch.setattr(langid, "CHUNK_CHARS", 700)
    parts = langid.classify(model, [text, "und", "", None])
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1], atol=1e-6)
    assert parts[0][1:] == ["de", "und", "und"]


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    model = langid.fit(docs)
    row = docs.where("lang = 'en' AND n_chars > 300").orderBy("doc_id").first()["text"][:200], docs.where("lang = 'de' AND n_chars > 300").orderBy("doc_id").first()["text"][:200]
    labels = langid.word_languages(model, row[0] + " " + row[1])
    assert np.mean([lang == ("en" if a < 200 else "de") for a, _, lang, _ in labels]) > 0.85


def test_cases(spark):
    rows = [(1, "der und die das " * 40, "de", "a", "b"), (2, "the and of in to " * 40, "en", None, None), (3, None, "en", None, None), (4, "123 !?", None, None, None), (None, "the and of", None, None, None), (5, "", "de", None, None), (2, "the and of in to " * 40, "en", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df)
    made = langid.identify(df, model).collect()  # df has columns language and score of its own
    assert sorted(map(str, (tuple(r["row"]) for r in made))) == sorted(map(str, rows))
    got = [(r["row"]["doc_id"], r["language"]["lang_pred"]) for r in made]
    want = [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (None, "en"), (5, "und"), (2, "en")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert langid.stage(spark, df, "").columns == df.columns
    assert langid.identify(df.limit(0), model).count() == 0 == langid.stage(spark, df.limit(0), "").count()
    none = langid.fit(df.where(F.lit(False)))
    assert {r["language"]["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}


def test_long_texts_are_learned_from_and_ties_go_to_the_first_name(spark):
    rows = [(k, ("der und die das " if k % 2 else "the and of in to ") * 8_000, "de" if k % 2 else "en") for k in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.classify(model, [rows[0][1], rows[1][1]])[0] == ["en", "de"]
    even = langid.Model(["de", "en"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros((2, 2), np.float32))
    lang, score = langid.classify(even, ["ab cd"])
    assert lang == ["de"] and np.isclose(score[0], 0.5)


def test_query_against_plain_forward_backward(spark, tmp_path):
    """The query's rows are those of the same model under forward-backward without segments or batches."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = [tuple(r) for r in docs.where((langid.remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").collect()]
    model = langid.train(sorted(learned))
    got = {r["doc_id"]: r for r in langid.query(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.select("doc_id", "text").collect():
        emissions, _ = langid._emissions(model, langid._codes(r["text"] or ""))
        if not len(emissions):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        p, _ = plain_marginals(emissions, [len(emissions)], model.transitions)
        mass = p.mean(axis=0)
        assert np.isclose(got[r["doc_id"]]["score"], mass.max(), atol=2e-3)
        assert got[r["doc_id"]]["lang_pred"] == model.langs[int(mass.argmax())] or np.isclose(*np.sort(mass)[-2:], atol=2e-3)
