import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from voxelmill.llm import packing, tokens

DOCS = "doc_id long, text string, length string, sequence_id string, bucket string"


def check_plan(counts, capacity):
    made = packing.plan(counts, capacity)
    used = Counter()
    for pattern, n in made:
        assert n > 0 and sum(pattern) <= capacity
        used.update({k: v * n for k, v in Counter(pattern).items()})
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(n for _, n in made)


def test_exact_combinations():
    assert check_plan({700: 3, 324: 3}, 1024) == 3
    assert check_plan({700: 1, 200: 1, 124: 1}, 1024) == 1
    assert check_plan({500: 2, 300: 2, 124: 2, 100: 2}, 1024) == 2
    assert check_plan({512: 5}, 1024) == 3 and check_plan({1024: 4, 1: 1}, 1024) == 5 and check_plan({}, 1024) == 0
    assert check_plan({256: 1_000_003}, 1024) == 250_001


def lower_bound(counts, capacity=1024):
    """Martello and Toth's: long items need sequences of their own, and only the room beside the middle ones is free for the short."""
    best = -(-sum(k * v for k, v in counts.items()) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = sum(v for x, v in counts.items() if x > capacity - k)
        half = [(x, v) for x, v in counts.items() if capacity // 2 < x <= capacity - k]
        free = sum(v * (capacity - x) for x, v in half)
        short = sum(x * v for x, v in counts.items() if k <= x <= capacity // 2)
        best = max(best, alone + sum(v for _, v in half) + max(0, -(-(short - free) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(5))
def test_plans_against_the_bound(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 1024) if seed % 2 else min(1024, int(rng.expovariate(1 / 200)) + 1) for _ in range(5000))
    bound = lower_bound(counts)
    assert bound <= check_plan(dict(counts), 1024) <= bound * 1.005 + 1
    assert len(packing.plan(dict(counts), 1024)) < 4 * 1024


def test_available_pairs_and_triples():
    have = packing._Available({3: 1, 5: 2, 7: 1, 12: 1}, 20)
    assert have.pair(10, 10) == (7, 3) and have.pair(10, 6) == (5, 5) and have.pair(6, 6) is None and have.exact(12) == (12,) and have.exact(15) == (12, 3) and have.exact(13) == (5, 5, 3)
    assert have.longest(6) == 5 and have.longest(2) == 0


def test_pieces_and_places(spark):
    full = Tokenizer.from_file(tokens.default_path())
    rng = random.Random(1)
    texts = [(k, " ".join("".join(rng.choice("abcdeé ñ1") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 900)))) for k in range(60)]
    texts += [(100, None), (101, ""), (None, "no id"), (102, "<|endoftext|>a<|endoftext|>"), (103, "中文 текст"), (104, "a"), (104, "a"), (105, "x " * 1023), (106, "x " * 1022), (107, "word " * 3000)]
    df = spark.createDataFrame([(*t, None, "s", None) for t in texts], DOCS)
    got = packing.packed_documents(df).collect()
    want = Counter()
    for i, t in texts:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // 1024) * 1.05 + 2
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_small_buckets_and_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    df = spark.createDataFrame([(k, "a b c", None, None, None) for k in range(50)], DOCS)
    cut_up = packing.pack(packing.pieces(df))
    assert len({(r["sequence_id"], r["offset"]) for r in cut_up.collect()}) == 50
    ids = [np.frombuffer(r["ids"], "<u4") for r in packing.sequences(cut_up).collect()]
    one = np.append(tokens.encode("a b c", tokens.default_path()), 2)
    assert sum(map(len, ids)) == 50 * len(one) and all((x.reshape(-1, len(one)) == one).all() for x in ids)


def test_ids_equal_the_vocabulary_files():
    path = tokens.default_path()
    full, rng = Tokenizer.from_file(path), random.Random(2)
    pool = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x180E, 0x3000, 0xFEFF, 0x20AC, 0x4E2D, 0x1F600, 0x0301]]
    for _ in range(3000):
        s = "".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice("  ab1.\n'") for _ in range(50))
        assert full.encode(s, add_special_tokens=False).ids == tokens.encode(s, path).tolist()
    own = [c for c in map(chr, [*range(0x250), *map(ord, tokens._MARKS)]) if not tokens._OTHER.search(c)]
    assert len(own) > 500
    for c in own:  # every character that is cut here, beside each kind of neighbour
        s = f"a{c}a 1{c}1 .{c}. {c} {c}{c}  {c}\n{c}'{c}s{c}"
        assert full.encode(s, add_special_tokens=False).ids == tokens.encode(s, path).tolist()
    for _ in range(3000):
        s = "".join(rng.choice(own) if rng.random() < 0.4 else rng.choice("  ab1.\n\t's") for _ in range(60))
        assert full.encode(s, add_special_tokens=False).ids == tokens.encode(s, path).tolist()
    for s in ["a" + " " * 5000 + "b", " " * 1000, "中文" * 3000, "x" * 100_000, "a <|endoftext|> b", " <|endoftext|>", "it's we'll I'm  's 's", "\n \n a", ""]:
        assert full.encode(s, add_special_tokens=False).ids == tokens.encode(s, path).tolist()


def test_ids_of_whole_table(spark):
    path = tokens.default_path()
    full = Tokenizer.from_file(path)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert full.encode(r["text"] or "", add_special_tokens=False).ids == tokens.encode(r["text"] or "", path).tolist()


def test_memory_of_parts_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    path = tokens.default_path()
    full = Tokenizer.from_file(path)
    for k in range(20):
        s = f"one two{k} three{k} four{k} five"
        assert full.encode(s, add_special_tokens=False).ids == tokens.encode(s, path).tolist()
