import random

import numpy as np
import xxhash

from voxelmill.llm import simhash
from voxelmill.llm.components import components

DOCS = "doc_id long, text string, fp string, lang string"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(values):
    """Component's least index by index, from all pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint_against_plain():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rng.choice(["Éa", "THE", "of", "x y", "ß"]) for _ in range(n)).replace("of", "\tof\n", 1)
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_links_find_every_pair_within_the_radius(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in list(fps):
        x = base
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.append(x)
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << b) for b in range(64)] + [hub ^ (3 << b) for b in range(20)]
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps)).collect()
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame([tuple(r) for r in found], "a long, b long")).collect()}
    want = plain_components(fps)
    groups, plain = {}, {}
    for x, w in zip(signed, want, strict=True):
        groups.setdefault(roots.get(x, x), set()).add(x)
        plain.setdefault(w, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))
    clique = np.array([hub ^ (1 << b) for b in range(64)], np.uint64)
    assert len(simhash._forest(clique)) == 63  # a star, not 2016 pairs


def test_query_cases(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(3000))
    near = text + " tail"
    rows = [(7, text), (5, near), (9, text), (9, text), (1, None), (2, ""), (3, "one two"), (None, "one two"), (4, "Other words here")]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: -1 if rows[i][0] is None else rows[i][0])
    roots = plain_components([fps[i] for i in order])
    want = [(rows[i][0], int(np.uint64(fps[i]).view(np.int64)), rows[order[r]][0]) for i, r in zip(order, roots, strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.stage(spark, df, "")
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({w[2] for w in want}, key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
