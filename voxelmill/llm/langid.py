"""Language ID by a linear-chain conditional random field over words.

Each word (a run of letters, lower-cased) has affix features (first and last two and three letters), letter trigrams with
word ends, and a lexicon feature (the whole word); features are hashed to ``BUCKETS`` rows of weights, one weight per
language. A transition matrix between neighbouring words is learned with them, on chains made of short runs of words
drawn from documents of all languages, so that switches within a text are seen in training. Forward-backward gives each
word its marginal probabilities; a document's prediction is the language with the largest sum, its score the mean
marginal of that language. ``word_languages`` gives the labels of the words themselves, for code-switched text.

A text's words are cut in segments; all segments of a batch advance together, segment products carry the messages across,
so long documents cost as much per word as short ones.

Learning takes a hash sample of labelled rows of about ``PER_LANG`` documents per language, whatever the size of the table and the
length of the texts. The model (BUCKETS x languages floats) is what is broadcast.

Edge cases: null texts and texts without a letter are ``und`` with score 0; if no row is labelled, all are; of languages with equal
mass the first by name is predicted; a null doc_id counts as the empty text in the hold-out rule; repeated rows give repeated
results; an empty table gives an empty result; other columns stay in the struct ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import read_table

BUCKETS, SEGMENT = 1 << 17, 48
PER_LANG, RUN_WORDS, RUNS_PER_DOC, EPOCHS = 400, 16, 8, 2
UNDETERMINED, MIN_SCORE = "und", 0.35
#: Characters that are turned into features at a time.
CHUNK_CHARS = 1 << 20
_FIELDS = 5  # whole-word fields beside the trigrams


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _mix(x: np.ndarray, field: int) -> np.ndarray:
    x = x + np.uint64(field * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Words:
    """Hashed features of a run of words: trigram rows with word starts, and _FIELDS rows for each word."""

    trigrams: np.ndarray
    starts: np.ndarray
    fields: np.ndarray  # (words, _FIELDS)
    spans: np.ndarray  # (words, 2), in the given code points

    def __len__(self) -> int:
        return len(self.starts)


def word_features(codes: np.ndarray) -> Words:
    """codes: lower-cased code points; words end at anything but a letter."""
    is_letter = _letters()[codes]
    edge = np.diff(np.r_[False, is_letter, False].astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # last is one past the word
    length = last - first
    starts = np.r_[0, np.cumsum(length)[:-1]].astype(np.int64) if len(first) else np.zeros(0, np.int64)
    x = codes.astype(np.uint64)
    padded = np.where(is_letter, x, 0)
    padded = np.r_[np.uint64(0), padded, np.uint64(0)]
    at = np.flatnonzero(is_letter)
    before, here, after = padded[at], padded[at + 1], padded[at + 2]
    trigrams = _mix((before << np.uint64(42)) ^ (here << np.uint64(21)) ^ after, 1)
    if not len(first):
        return Words(trigrams, starts, np.zeros((0, _FIELDS), np.int32), np.zeros((0, 2), np.int64))
    a, b = x[first], np.where(length > 1, padded[first + 2], 0)
    c = np.where(length > 2, padded[np.minimum(first + 3, len(padded) - 1)], 0)
    z, y = x[last - 1], np.where(length > 1, padded[last - 1], 0)
    w = np.where(length > 2, padded[np.maximum(last - 2, 0)], 0)
    place = np.arange(len(at), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), length)
    spread = (here + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    spread ^= spread >> np.uint64(32)
    whole = np.add.reduceat(spread * np.uint64(0xD6E8FEB86659FD93), starts)
    s = np.uint64(21)
    fields = np.stack([_mix((a << s) ^ b, 2), _mix((a << s + s) ^ (b << s) ^ c, 3), _mix((z << s) ^ y, 4), _mix((z << s + s) ^ (y << s) ^ w, 5), _mix(whole, 6)], axis=1)
    return Words(trigrams, starts, fields, np.stack([first, last], axis=1))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, L)
    transitions: np.ndarray  # (L, L), from row to column

    def scores(self, w: Words) -> np.ndarray:
        """Emission scores (words, L)."""
        if not len(w):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.weights[w.trigrams], w.starts, axis=0)
        for k in range(_FIELDS):
            out += self.weights[w.fields[:, k]]
        return out


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, want_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (words, L) of chains that follow one another in emissions, and the summed marginals of neighbouring pairs."""
    n_words, n_lang = emissions.shape
    big = np.exp(transitions.astype(np.float32))
    big /= big.max()
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + np.float32(1e-30)
    segs = -(-lengths // SEGMENT)
    first_seg = np.r_[0, np.cumsum(segs)[:-1]]
    n_seg = int(segs.sum())
    chain = np.repeat(np.arange(len(lengths)), segs)
    k = np.arange(n_seg) - first_seg[chain]
    size = np.minimum(SEGMENT, lengths[chain] - k * SEGMENT)
    start = np.r_[0, np.cumsum(lengths)[:-1]][chain] + k * SEGMENT
    cols = np.arange(SEGMENT)
    real = cols[None, :] < size[:, None]
    x = np.ones((SEGMENT, n_seg, n_lang), np.float32)
    x.transpose(1, 0, 2)[real] = e
    real = real.T
    # what a segment does to a message that enters it
    prod = np.broadcast_to(np.eye(n_lang, dtype=np.float32), (n_seg, n_lang, n_lang)).copy()
    if (segs > 1).any():
        for t in range(SEGMENT):
            step = (prod @ big) * x[t][:, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            prod = np.where(real[t][:, None, None], step, prod)
    enter = np.full((n_seg, n_lang), 1.0 / n_lang, np.float32)
    leave = np.ones((n_seg, n_lang), np.float32)
    for j in range(1, int(segs.max(initial=0))):
        at = first_seg[segs > j] + j
        enter[at] = _norm(np.einsum("si,sij->sj", enter[at - 1], prod[at - 1]))
    for j in range(int(segs.max(initial=0)) - 2, -1, -1):
        at = first_seg[segs > j + 1] + j
        leave[at] = _norm(np.einsum("sij,sj->si", prod[at + 1], leave[at + 1]))
    alpha = np.empty((SEGMENT, n_seg, n_lang), np.float32)
    a = enter
    for t in range(SEGMENT):
        a = np.where(real[t][:, None], _norm((a @ big) * x[t]), a)
        alpha[t] = a
    out = np.empty((SEGMENT, n_seg, n_lang), np.float32)
    pairs = np.zeros((n_lang, n_lang))
    b = leave
    for t in range(SEGMENT - 1, -1, -1):
        out[t] = _norm(alpha[t] * b + np.float32(1e-30))
        inner = real[t]
        back = x[t] * b
        if want_pairs:
            prev = alpha[t - 1] if t else enter
            joint = prev[:, :, None] * big[None] * back[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True) + 1e-30
            has_prev = inner & ((k > 0) | (t > 0))
            pairs += joint[has_prev].sum(axis=0)
        b = np.where(inner[:, None], _norm(back @ big.T), b)
    return out.transpose(1, 0, 2)[real.T], pairs


def train(texts: list[tuple[str, str]], seed: int = 11) -> Model:
    """texts: (lang, text). AdaGrad on the conditional likelihood of the word labels."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in texts})
    n_lang = len(langs)
    runs = []  # (label, trigram rows, word starts, fields)
    for lang, text in texts:
        w = word_features(_codes(text))
        n = len(w)
        cuts = np.arange(0, n, RUN_WORDS)
        for c in rng.permutation(cuts)[:RUNS_PER_DOC]:
            d = min(n, c + RUN_WORDS)
            lo, hi = w.starts[c], w.starts[d] if d < n else len(w.trigrams)
            runs.append((langs.index(lang), w.trigrams[lo:hi], w.starts[c:d] - lo, w.fields[c:d]))
    model = Model(langs, np.zeros((BUCKETS, n_lang), np.float32), np.zeros((n_lang, n_lang), np.float32))
    seen_w, seen_t = np.full(BUCKETS, 1e-3, np.float32)[:, None].repeat(n_lang, 1), np.full((n_lang, n_lang), 1.0)
    per_chain, chains = 6, 48
    for _ in range(EPOCHS if n_lang > 1 else 0):
        order = rng.permutation(len(runs))
        for s in range(0, len(order), per_chain * chains):
            part = [runs[i] for i in order[s : s + per_chain * chains]]
            sizes = np.array([len(r[2]) for r in part])
            offsets = np.r_[0, np.cumsum([len(r[1]) for r in part])[:-1]]
            w = Words(np.concatenate([r[1] for r in part]), np.concatenate([r[2] + o for r, o in zip(part, offsets, strict=True)]), np.concatenate([r[3] for r in part]), np.zeros((0, 2)))
            label = np.repeat([r[0] for r in part], sizes)
            lengths = np.add.reduceat(sizes, np.arange(0, len(part), per_chain))
            p, pairs = marginals(model.scores(w), lengths, model.transitions, want_pairs=True)
            p[np.arange(len(p)), label] -= 1.0
            true = np.zeros((n_lang, n_lang))
            inside = np.ones(len(label), bool)
            inside[np.r_[0, np.cumsum(lengths)[:-1]]] = False
            np.add.at(true, (label[:-1][inside[1:]], label[1:][inside[1:]]), 1)
            rows = np.concatenate([w.trigrams, *w.fields.T])
            owner = np.concatenate([np.repeat(np.arange(len(p)), np.diff(np.r_[w.starts, len(w.trigrams)])), *[np.arange(len(p))] * _FIELDS])
            used, inverse = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(inverse, p[owner, j], len(used)) for j in range(n_lang)], axis=1)
            seen_w[used] += grad**2
            model.weights[used] -= 0.25 * grad / np.sqrt(seen_w[used]) + 1e-4 * model.weights[used]
            g = pairs - true
            seen_t += g**2
            model.transitions -= (0.2 * g / np.sqrt(seen_t)).astype(np.float32)
    return model


def _batches(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Indexes and code points of texts, about CHUNK_CHARS at a time."""
    ids, parts, total = [], [], 0
    for n, text in enumerate(texts):
        ids.append(n)
        parts.append(_codes(text or ""))
        total += len(parts[-1])
        if total >= CHUNK_CHARS:
            yield ids, parts
            ids, parts, total = [], [], 0
    if ids:
        yield ids, parts


def _emissions(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and spans of all words of codes, made in pieces that end between words."""
    scores, spans, a = [], [], 0
    while a < len(codes):
        b = min(len(codes), a + CHUNK_CHARS)
        while b < len(codes) and _letters()[codes[b - 1]]:
            more = np.flatnonzero(~_letters()[codes[b : b + 4096]])
            b = b + int(more[0]) + 1 if len(more) else min(len(codes), b + 4096)
        w = word_features(codes[a:b])
        scores.append(model.scores(w))
        spans.append(w.spans + a)
        a = b
    return (np.concatenate(scores), np.concatenate(spans)) if scores else (np.zeros((0, len(model.langs)), np.float32), np.zeros((0, 2), np.int64))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return lang, score
    gap = np.zeros(1, np.uint32)
    for ids, parts in _batches(texts):
        joined = np.concatenate([x for p in parts for x in (p, gap)])
        emissions, spans = _emissions(model, joined)
        ends = np.cumsum([len(p) + 1 for p in parts])
        owner = np.searchsorted(ends, spans[:, 0], side="right")
        lengths = np.bincount(owner, minlength=len(ids))
        some = np.flatnonzero(lengths)
        if not len(some):
            continue
        p, _ = marginals(emissions, lengths[some], model.transitions)
        mass = np.add.reduceat(p.astype(np.float64), np.r_[0, np.cumsum(lengths[some])[:-1]], axis=0) / lengths[some][:, None]
        best = mass.argmax(axis=1)
        for d, j, m in zip(some, best, mass, strict=True):
            lang[ids[d]], score[ids[d]] = model.langs[j], min(1.0, float(m[j]))
    return lang, score


def word_languages(model: Model, text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, language, probability) of each word of a text."""
    emissions, spans = _emissions(model, _codes(text))
    if not len(spans):
        return []
    p, _ = marginals(emissions, np.array([len(spans)]), model.transitions)
    return [(int(a), int(b), model.langs[j], float(row[j])) for (a, b), row, j in zip(spans, p, p.argmax(axis=1), strict=True)]


def remainder(id_col: Column, mod: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the labelled rows, from a hash sample of about PER_LANG documents per language."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, PER_LANG / n)))])
    draw = F.pmod(F.xxhash64("i", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text").collect()
    return train(sorted((r["lang"], r["text"]) for r in sample))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, language): the columns of docs in a struct, and the struct (lang_pred, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(text):
        import pandas as pd

        lang, score = classify(sent.value, [t if isinstance(t, str) else None for t in text])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.select(F.struct("*").alias("row")).select("row", run(F.col(f"row.`{text_col}`").cast("string")).alias("language"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    held_out = (remainder(F.col("row.doc_id"), 3) == 1).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("row.doc_id", held_out, "language.lang_pred", "language.score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts without letters go, and those of which no language has MIN_SCORE of the words."""
    model = fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    found = identify(docs, model).where((F.col("language.lang_pred") != UNDETERMINED) & (F.col("language.score") >= MIN_SCORE))
    return found.select("row.*")
