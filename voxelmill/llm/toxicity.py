"""Toxicity: a learned lexicon, misspellings by Levenshtein automata over its trie, and context-window scores.

Learning takes a hash sample of labelled rows (about MAX_TOXIC and MAX_CLEAN documents, whole texts; classes are weighted back to
their shares). Word beginnings of any length that occur in far more toxic than clean documents become the lexicon, without a limit
on its entries: a whole word if one word makes up most of a beginning's documents, else a stem with any ending. Longer words admit
one or two edits. All entries make one trie (see ``automaton``), which every different word of every text is matched with.

A hit's weight is its entry's log-odds in the sample, for exact and misspelled hits apart. Its context is the window of
WINDOW words on either side: each context word has log-odds between hits of toxic and of clean documents, and a hit inside
quotation marks counts as quoted, so that quotation and abuse are weighed apart where the labels tell them apart. A logistic
regression over a document's hits and contexts gives the score.

Edge cases: null and empty texts have no hits and take the score of a text without hits; a null doc_id counts as the empty text
in the hold-out rule; without both labels in the sample every score is the share of toxic rows (0 if none); a document
labelled more than once is toxic if any row says so; repeated rows give repeated results; a score of just 0.5 counts as
toxic; an empty table gives an empty result; other columns stay in the struct ``row``, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import read_table
from voxelmill.llm.automaton import Entry, Matcher

#: About so many labelled documents of each class are learned from.
MAX_TOXIC, MAX_CLEAN = 2_500, 5_000
MIN_PREFIX = 4
#: A beginning enters the lexicon at this G statistic and log-odds, and so many toxic texts.
MIN_G, MIN_ODDS, MIN_TEXTS = 20.0, 3.0, 4
WINDOW, CONTEXT_BUCKETS, CHUNK_CHARS = 5, 1 << 14, 1 << 20
QUOTES = "\"“”„«»"


@lru_cache(maxsize=1)
def _word_chars() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)], bool)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Found:
    """Words and hits of a batch of texts."""

    n_words: np.ndarray  # per text
    owner: np.ndarray  # text of each hit
    result: np.ndarray  # matcher's result of each hit
    quoted: np.ndarray  # whether each hit is inside quotation marks
    context: np.ndarray  # (hits, 2 * WINDOW) context buckets, -1 where there is no word


def find(texts: list[str | None], matcher: Matcher) -> Found:
    joined = "".join(x for t in texts for x in ((t or "").lower(), "\n"))
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len((t or "").lower()) + 1 for t in texts]).astype(np.int64)
    edge = np.diff(np.r_[False, _word_chars()[codes], False].astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(ends, first, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    result = matcher.read([joined[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    hits = np.flatnonzero(result)
    # a quotation opens and closes within a line
    marks = np.flatnonzero(np.isin(codes, np.array([ord(c) for c in QUOTES], np.uint32)))
    lines = np.flatnonzero(codes == 10)
    line_start = np.r_[0, lines + 1][np.searchsorted(lines, first[hits])]
    quoted = (np.searchsorted(marks, first[hits]) - np.searchsorted(marks, line_start)) % 2 == 1
    near = hits[:, None] + np.r_[-WINDOW:0, 1 : WINDOW + 1][None, :]
    inside = (near >= 0) & (near < len(first))
    near = np.clip(near, 0, max(0, len(first) - 1))
    context = np.full(near.shape, -1, np.int64)
    if len(hits):
        inside &= owner[near] == owner[hits][:, None]
        which, back = np.unique(near, return_inverse=True)
        bucket = np.array([_bucket(codes[first[w] : last[w]]) for w in which])
        context = np.where(inside, bucket[back].reshape(near.shape), -1)
    return Found(n_words, owner[hits], result[hits], quoted, context)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK_CHARS characters, or of one text."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size < CHUNK_CHARS):
            size, b = size + len(texts[b] or ""), b + 1
        yield a, b
        a = b


def find_all(texts: list[str | None], matcher: Matcher) -> Found:
    """As find, a chunk of the texts at a time."""
    parts = [(a, find(texts[a:b], matcher)) for a, b in _chunks(texts)]
    join = lambda name: np.concatenate([getattr(f, name) for _, f in parts])
    return Found(join("n_words"), np.concatenate([f.owner + a for a, f in parts]), join("result"), join("quoted"), join("context"))


def _bucket(word: np.ndarray) -> int:
    h = 1469598103934665603
    for c in word.tolist():
        h = ((h ^ c) * 1099511628211) & (2**64 - 1)
    return (h ^ h >> 31) % CONTEXT_BUCKETS


def _words(text: str) -> set[str]:
    codes = _codes(text)
    edge = np.diff(np.r_[False, _word_chars()[codes], False].astype(np.int8))
    low = text.lower()
    return {low[a:b] for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b - a >= 3}


def _beginnings(words: set[str], wanted: dict[str, int]) -> set[str]:
    """The beginnings among wanted that the words have. Wanted has every shorter beginning of MIN_PREFIX characters or more, too."""
    out = {w for w in words if len(w) < MIN_PREFIX and w in wanted}
    for w in words:
        k = MIN_PREFIX
        while k <= len(w) and (p := w[:k]) in wanted:
            out.add(p)
            k += 1
    return out


def _frequent_beginnings(word_sets: list[set[str]], least: int) -> dict[str, int]:
    """Beginnings of MIN_PREFIX characters or more, and shorter words, with how many sets have them, if ``least`` or more do.

    Level by level: a beginning is frequent only if what is one character shorter is.
    """
    short = Counter(w for ws in word_sets for w in ws if len(w) < MIN_PREFIX)
    out = {w: n for w, n in short.items() if n >= least}
    left, k = [[w for w in ws if len(w) >= MIN_PREFIX] for ws in word_sets], MIN_PREFIX
    while any(left):
        seen = Counter(p for ws in left for p in {w[:k] for w in ws})
        level = {p: n for p, n in seen.items() if n >= least}
        out |= level
        left = [[w for w in ws if len(w) > k and w[:k] in level] for ws in left]
        k += 1
    return out


def learn_lexicon(toxic: list[str], clean: list[str]) -> list[Entry]:
    """Words and stems that are far more frequent among toxic texts, strongest first.

    Each pick halves the say of the toxic texts that it is in, so that what merely stands beside strong words in copies of
    one text does not enter.
    """
    n_tox, n_clean = len(toxic), len(clean)
    share = n_tox / (n_tox + n_clean)
    word_sets = [_words(t) for t in toxic]
    wanted = _frequent_beginnings(word_sets, MIN_TEXTS)
    whole = Counter(w for ws in word_sets for w in ws)
    by_first: dict[str, list[str]] = {}
    for w in whole:
        by_first.setdefault(w[:MIN_PREFIX], []).append(w)
    in_clean: Counter = Counter()
    for t in clean:
        in_clean.update(_beginnings(_words(t), wanted))

    def odds(p: str, n: float) -> float:
        return np.log((n + 0.5) / (n_tox + 1)) - np.log((in_clean[p] + 0.5) / (n_clean + 1))

    def g(p: str, n: float) -> float:
        b = in_clean[p]
        return 2 * (n * np.log(n / ((n + b) * share)) + (b * np.log(b / ((n + b) * (1 - share))) if b else 0.0))

    say = {p: float(n) for p, n in wanted.items() if odds(p, n) >= MIN_ODDS and g(p, n) >= MIN_G}
    held = [_beginnings(ws, wanted) & say.keys() for ws in word_sets]
    holders: dict[str, list[int]] = {}
    for d, ps in enumerate(held):
        for p in ps:
            holders.setdefault(p, []).append(d)
    weight, entries = np.ones(n_tox), []
    while say:
        best = max(say, key=lambda p: (g(p, say[p]), -len(p), p))
        if g(best, say[best]) < MIN_G or odds(best, say[best]) < MIN_ODDS or say[best] < MIN_TEXTS:
            break
        word, n = max(((w, whole[w]) for w in by_first[best[:MIN_PREFIX]] if w.startswith(best)), key=lambda x: (x[1], x[0]))
        stem = n < 0.8 * wanted[best]
        text = best if stem else word
        entries.append(Entry(text, stem, 2 if len(text) >= 9 else 1 if len(text) >= 5 else 0))
        for d in holders[best]:
            weight[d] /= 2
            for p in held[d]:
                if p in say:
                    say[p] = max(1e-9, say[p] - weight[d])
        say = {p: n for p, n in say.items() if not p.startswith(best) and not best.startswith(p)}
    return list(dict.fromkeys(entries))


@dataclass
class Model:
    matcher: Matcher | None
    exact: np.ndarray  # log-odds by entry
    fuzzy: np.ndarray
    context: np.ndarray  # log-odds by bucket
    weights: np.ndarray
    prior: float

    def features(self, found: Found, n: int) -> np.ndarray:
        """(texts, 8)."""
        hit = np.zeros((len(self.matcher.results), 3))  # best weight, exact, misspelled
        for r, pairs in enumerate(self.matcher.results):
            if pairs:
                weights = [(self.exact if d == 0 else self.fuzzy)[e] for e, d in pairs]
                hit[r] = (max(weights), any(d == 0 for _, d in pairs), all(d > 0 for _, d in pairs))
        w, exact, fuzzy = hit[found.result].T if len(found.result) else np.zeros((3, 0))
        known = found.context >= 0
        ctx = np.where(known, self.context[np.maximum(found.context, 0)], 0.0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
        total = lambda v: np.bincount(found.owner, v, n)
        hits = total(np.ones(len(w)))
        best = np.zeros(n)
        np.maximum.at(best, found.owner, w)
        return np.stack([np.ones(n), np.log1p(total(exact)), np.log1p(total(fuzzy)), best, np.clip(total(w), -20, 20) / 5, np.log1p(total(found.quoted * 1.0)), total(ctx) / np.maximum(hits, 1), np.minimum(hits / np.maximum(found.n_words, 1), 0.2) * 20], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.matcher is None:
            return out
        for a, b in _chunks(texts):
            x = self.features(find(texts[a:b], self.matcher), b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the first column is free of the ridge."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: list[tuple[int, str]], toxic_share: float | None = None) -> Model:
    """rows: (toxic, text); toxic_share: what share of all labelled rows is toxic, if the sample's differs."""
    y = np.array([t for t, _ in rows], float)
    share = float(y.mean()) if len(y) else 0.0
    prior = share if toxic_share is None else toxic_share
    nothing = Model(None, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), prior)
    if not 0 < share < 1:
        return nothing
    entries = learn_lexicon([x for t, x in rows if t], [x for t, x in rows if not t])
    if not entries:
        return nothing
    matcher = Matcher.of(entries)
    found = find_all([x for _, x in rows], matcher)
    # documents of each class with an exact, and with a misspelled hit of each entry
    seen = [np.zeros((2, len(entries))), np.zeros((2, len(entries)))]
    for owner, e, kind in {(o, e, min(d, 1)) for o, r in zip(found.owner.tolist(), found.result.tolist(), strict=True) for e, d in matcher.results[r]}:
        seen[kind][int(y[owner]), e] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    exact, fuzzy = [np.log((s[1] + 0.5) / (n[1] + 1)) - np.log((s[0] + 0.5) / (n[0] + 1)) for s in seen]
    counts = np.zeros((2, CONTEXT_BUCKETS))
    for k in (0, 1):
        c = found.context[y[found.owner] == k]
        counts[k] = np.bincount(c[c >= 0], minlength=CONTEXT_BUCKETS)
    context = np.zeros(CONTEXT_BUCKETS)
    if counts.sum(axis=1).min() >= 50:  # else the labels do not tell contexts apart
        rate = (counts + 5.0) / (counts.sum(axis=1, keepdims=True) + 5.0 * CONTEXT_BUCKETS)
        context = np.clip(np.log(rate[1]) - np.log(rate[0]), -2, 2) * (counts.sum(axis=0) >= 5)
    model = Model(matcher, exact, fuzzy, context, np.zeros(8), prior)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    model.weights = _logistic(model.features(found, len(rows)), y, weight)
    return model


def hold_out(id_col, mod: int = 5):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of documents (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([])
    share = F.when(F.col("toxic") == 1, MAX_TOXIC / max(1, counts.get(1, 0))).otherwise(MAX_CLEAN / max(1, counts.get(0, 0)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(draw < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(picked), "doc_id").select("toxic", "text").distinct().collect()  # the sample's rows are bounded above
    return train(sorted((r["toxic"], r["text"]) for r in sample), counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, toxicity): the columns of docs in a struct, and the score from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(text):
        import pandas as pd

        return pd.Series(sent.value.score([t if isinstance(t, str) else None for t in text]))

    return docs.select(F.struct("*").alias("row")).select("row", run(F.col(f"row.`{text_col}`").cast("string")).alias("toxicity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs.where(~hold_out(F.col("doc_id"))), labels.where(~hold_out(F.col("doc_id"))))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", hold_out(F.col("row.doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
