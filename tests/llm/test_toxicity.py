import random
import zlib

import numpy as np

from voxelmill.llm import toxicity
from voxelmill.llm import automaton
from voxelmill.llm.automaton import Entry, Matcher, Trie

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, toxicity string, toxic string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        old, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, old[j + 1] + 1, old[j] + (x != y)))
    return row[-1]


def plain(entries, w):
    want = {}
    for n, e in enumerate(entries):
        if e.stem or abs(len(w) - len(e.text)) <= e.distance:
            ends = range(min(len(w), len(e.text) + e.distance) + 1)
            d = min(distance(w[:k], e.text) for k in ends) if e.stem else distance(w, e.text)
            if d <= e.distance:
                want[n] = d
    return want


def test_walk_against_edit_distance():
    entries = [Entry("idiot", False, 1), Entry("idol", False, 1), Entry("disgusting", False, 2), Entry("scum"), Entry("lowei", True), Entry("lostraß", True, 1), Entry("aa", True, 1), Entry("scum", True, 2), Entry("idiot", False, 1)]
    made, rng, words = Matcher.of(entries), random.Random(0), []
    for _ in range(4000):
        e = rng.choice(entries)
        w = list(e.text) + list("xyz")[: rng.randint(0, 3)]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", *"aeiosé"])
        words.append("".join(w) or "a")
    words += ["lowei" + "x" * 500, "i" * 300, "\U0001f600"]
    for w, r in zip(words, made.read(words), strict=True):
        assert dict(made.results[r]) == plain(entries, w), w
    assert len(made.known) == len(set(words)) and (Matcher.of([]).read(words) == 0).all() and len(made.read([])) == 0


def test_long_entries_span_machine_words():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (58, 59, 60, 61, 62, 63, 64, 122, 123, 124, 125, 200)]
    entries = [Entry(t, k % 3 == 2, k % 3) for k, t in enumerate(texts)]
    words = []
    for t in texts:
        for _ in range(4):
            w = list(t) + rng.choice([[], [], list("ab"), list("abab" * 20)])
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
            words.append("".join(w))
    made = Matcher.of(entries)
    for w, r in zip(words, made.read(words), strict=True):
        assert dict(made.results[r]) == plain(entries, w), w


def corpus(n, seed=0, quoted=False):
    rng, rows = random.Random(seed), []
    for k in range(n):
        words = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        toxic = int(k % 6 == 0)
        if toxic:
            words[30:33] = ["you", rng.choice(["grobling", "Vexatron", "snarkle"]), "now"]
        elif quoted and k % 6 == 1:
            words[28:34] = ["he", "said", '"grobling', 'vexatron"', "in", "court"]
        rows.append((toxic, " ".join(words)))
    return rows


def test_misspelled_terms_and_lexicon():
    model = toxicity.train(corpus(600))
    assert {e.text for e in model.matcher.entries} >= {"grobling", "vexatron", "snarkle"}
    clean = " ".join(["water", "under", "bridge"] * 20)
    s = model.score([clean, clean + " grobling", clean + " groblinq", clean + " VEXATR0N", "", None])
    assert s[1] > 0.5 > s[0] and s[2] > s[0] and s[3] > s[0] and s[4] == s[5] < 0.5


def test_context_separates_quotation():
    rows = corpus(1200, 1, quoted=True)
    old = toxicity.MIN_ODDS
    toxicity.MIN_ODDS = 0.3
    try:
        model = toxicity.train(rows)
    finally:
        toxicity.MIN_ODDS = old
    test = corpus(600, 2, quoted=True)
    s = model.score([x for _, x in test])
    y = np.array([t for t, _ in test])
    assert ((s >= 0.5) == y).mean() > 0.97


def test_query_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = toxicity.query(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_cases(spark):
    rows = [(k, t, None, "x") for k, (_, t) in enumerate(corpus(300))] + [(None, "grobling", None, None), (7, None, None, None), (7, "", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(corpus(300))] + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).collect()  # df has a column toxicity of its own
    assert sorted(map(str, (tuple(r["row"]) for r in got))) == sorted(map(str, rows))
    empty = {r["toxicity"] for r in got if not r["row"]["text"]}
    assert len(empty) == 1 and empty.pop() < 0.5
    none = toxicity.fit(df, labels.limit(0))
    assert {r["toxicity"] for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_long_texts_are_learned_from_and_scored_to_their_end(spark):
    filler = "water under the bridge " * 15_000
    rows = [(k, filler + x, None, None) for k, (_, x) in enumerate(corpus(60))] + [(1000 + k, x, None, None) for k, (t, x) in enumerate(corpus(200)) if not t]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(corpus(60))] + [(r[0], 0) for r in rows if r[0] >= 1000], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert model.matcher.entries
    got = {r["row"]["doc_id"]: r["toxicity"] for r in toxicity.score(df, model).collect()}
    toxic = [k for k, (t, _) in enumerate(corpus(60)) if t]
    assert min(got[k] for k in toxic) > max(got[k] for k in got if k not in toxic)


def test_query_against_plain_matching(spark, tmp_path):
    """The query's scores are those of a model whose matches come from edit distances, word by word."""
    rows = [(k, x) for k, (_, x) in enumerate(corpus(400))] + [(900, None), (901, ""), (902, "vexatrom grobblin snarkle")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(k, t) for k, (t, _) in enumerate(corpus(400))]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.query(spark, str(tmp_path)).collect()}
    learn = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    model = toxicity.train(sorted((t, x) for (i, x), (j, t) in zip(rows, marks, strict=False) if i in learn), sum(t for i, t in marks if i in learn) / sum(i in learn for i, _ in marks))
    known = {}

    def walk(trie, words):
        for w in words:
            known.setdefault(w, plain(trie.entries, w))
        for n in range(len(trie.entries)):
            at = [k for k, w in enumerate(words) if n in known[w]]
            yield n, np.array(at, int), np.array([known[words[k]][n] for k in at], int)

    model.matcher.known.clear()
    old, automaton.Trie.walk = automaton.Trie.walk, walk
    try:
        want = model.score([x for _, x in rows])
    finally:
        automaton.Trie.walk = old
    assert np.allclose([got[i]["score"] for i, _ in rows], want)
    assert all(got[i]["predicted"] == int(s >= 0.5) for (i, _), s in zip(rows, want, strict=True))


def test_score_of_one_half_counts():
    model = toxicity.train([(1, "a"), (0, "b")])
    assert model.matcher is None and model.score(["x"])[0] == 0.5


def test_a_large_lexicon_keeps_its_edits():
    rng, texts = random.Random(3), set()
    while len(texts) < 2_000:
        texts.add("".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) + rng.choice(["", "n", "r", "s"]))
    texts = rng.sample(sorted(texts), len(texts))
    entries = [Entry(t, False, 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0) for t in texts]
    made = Matcher.of(entries)
    assert len(Trie.of(entries).children) > 4_000
    words = [t[:k] + rng.choice(["q", "", "qa"]) + t[k + 1 :] for t in texts[:400] for k in [rng.randrange(len(t))]] + texts[:50] + ["qqqq"]
    for w, r in zip(words, made.read(words).tolist(), strict=True):
        assert dict(made.results[r]) == plain(entries, w), w


def test_a_lexicon_has_as_many_entries_as_the_labels_support():
    letters = "bcdfghjklmnprstvwz"
    bad = [a + v + b + "ixun" for a in letters for v in "aeo" for b in letters][:700]
    toxic = [f"plain words {bad[k % 700]}" for k in range(14_000)]
    clean = ["plain words and others"] * 14_000
    entries = toxicity.learn_lexicon(toxic, clean)
    assert len(entries) > 400 and {w for w in bad if not any(w == e.text or e.stem and w.startswith(e.text) for e in entries)} == set()


def test_short_stems_have_one_edit():
    rng, rows = random.Random(5), corpus(400)
    word = lambda: "".join(rng.choice("aeiost") for _ in range(4))
    rows = [(t, x.replace("grobling", "zwurkh" + word()).replace("Vexatron", "zwurkh" + word()).replace("snarkle", "zwurkh" + word()) + ("" if t else " zwur" + word())) for t, x in rows]
    stems = [e for e in toxicity.learn_lexicon([x for t, x in rows if t], [x for t, x in rows if not t]) if e.stem]
    assert stems == [Entry("zwurk", True, 1)]
