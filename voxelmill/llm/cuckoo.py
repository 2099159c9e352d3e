"""A cuckoo filter over 64-bit hashes (Fan, Andersen, Kaminsky, Mitzenmacher 2014), vectorised with NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class CuckooFilter:
    """Membership with deletion: no false negatives, about 2 * SLOTS / 65535 false positives.

    Inserting a member twice needs deleting it twice. ``insert`` that finds no slot for a fingerprint after ``max_kicks`` rounds
    says so and leaves the table as it was; ``build`` then tries a larger one, and ``Stack`` puts another one on top.
    """

    def __init__(self, n_buckets: int):
        self.n_buckets = 1 << max(2, int(n_buckets - 1).bit_length())
        self.table = np.zeros((self.n_buckets, SLOTS), np.uint16)
        self.count = 0

    @classmethod
    def build(cls, hashes: np.ndarray, load: float = 0.85) -> CuckooFilter:
        n = max(4, int(np.ceil(len(hashes) / (SLOTS * load))))
        while True:
            made = cls(n)
            if made.insert(hashes):
                return made
            n = made.n_buckets * 2

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = _mix(np.asarray(hashes).astype(np.int64).view(np.uint64))
        fp = (m & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, ((m >> np.uint64(16)) & np.uint64(self.n_buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(fp.astype(np.uint64)) & np.uint64(self.n_buckets - 1)).astype(np.int64)

    def _settle(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Put fingerprints in free slots of their buckets; returns the indexes of those left over."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        nth = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
        free = self.table[b] == 0
        fits = nth < free.sum(axis=1)
        rank = np.cumsum(free, axis=1) - 1
        slot = np.argmax(free & (rank == nth[:, None]), axis=1)
        self.table[b[fits], slot[fits]] = fp[order][fits]
        return order[~fits]

    def insert(self, hashes: np.ndarray, max_kicks: int = 500) -> bool:
        """Add each hash once; False if the table is too full, which then is as it was."""
        before = self.table.copy()
        fp, bucket = self._places(hashes)
        left = self._settle(bucket, fp)
        fp, bucket = fp[left], self._other(bucket[left], fp[left])
        rng = np.random.default_rng(7)
        for _ in range(max_kicks):
            left = self._settle(bucket, fp)
            fp, bucket = fp[left], bucket[left]
            if not len(fp):
                self.count += len(hashes)
                return True
            one = np.unique(bucket, return_index=True)[1]  # a bucket gives up one fingerprint a round
            slot = rng.integers(0, SLOTS, len(one))
            out = self.table[bucket[one], slot].copy()
            self.table[bucket[one], slot] = fp[one]
            fp[one] = out
            bucket[one] = self._other(bucket[one], out)
        self.table = before
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        fp, bucket = self._places(hashes)
        other = self._other(bucket, fp)
        return (self.table[bucket] == fp[:, None]).any(1) | (self.table[other] == fp[:, None]).any(1)

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Remove one copy of each hash that is here; which ones were. Only for hashes that were inserted."""
        hashes = np.asarray(hashes).reshape(-1)
        done, left = np.zeros(len(hashes), bool), np.arange(len(hashes))
        fps, firsts = self._places(hashes)
        while len(left):
            again = []
            for buckets in (firsts, self._other(firsts, fps)):
                at = left[~done[left]]
                hit = self.table[buckets[at]] == fps[at, None]
                some = hit.any(axis=1)
                at, slot = at[some], hit[some].argmax(axis=1)
                # of hashes that point to one slot, the first has it; the others look again
                _, one = np.unique(buckets[at] * SLOTS + slot, return_index=True)
                self.table[buckets[at[one]], slot[one]] = 0
                done[at[one]] = True
                again.append(np.setdiff1d(at, at[one]))
            left = np.concatenate(again)
            left = left[~done[left]]
        self.count -= int(done.sum())
        return done

    def to_bytes(self) -> bytes:
        return np.array([self.n_buckets, self.count], np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        n, count = np.frombuffer(blob[:16], np.int64)
        made = cls(int(n))
        made.table = np.frombuffer(blob[16:], np.uint16).reshape(int(n), SLOTS).copy()
        made.count = int(count)
        return made


class Stack:
    """Filters that grow: when the top one is full, one of twice its size goes on top. Deleting needs no other key."""

    def __init__(self, filters: list[CuckooFilter] | None = None, first: int = 256):
        self.filters = filters or [CuckooFilter(first)]

    def insert(self, hashes: np.ndarray) -> None:
        at = 0
        while at < len(hashes):
            top = self.filters[-1]
            room = int(top.table.size * 0.85) - top.count
            part = hashes[at : at + max(room, 0)]
            if len(part) and top.insert(part):
                at += len(part)
            else:
                self.filters.append(CuckooFilter(max(2 * top.n_buckets, min(len(hashes) - at, 1 << 20) // SLOTS)))

    def delete(self, hashes: np.ndarray) -> None:
        """From the largest filter down: hashes that one filter can't tell apart, no smaller one can, so what is taken for another is still found."""
        hashes = np.asarray(hashes)
        for f in reversed(self.filters):
            hashes = hashes[~f.delete(hashes)]

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for f in self.filters:
            out |= f.contains(hashes)
        return out

    @property
    def count(self) -> int:
        return sum(f.count for f in self.filters)

    def to_bytes(self) -> bytes:
        blobs = [f.to_bytes() for f in self.filters]
        return np.array([len(blobs), *map(len, blobs)], np.int64).tobytes() + b"".join(blobs)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Stack:
        n = int(np.frombuffer(blob[:8], np.int64)[0])
        ends = 8 * (n + 1) + np.r_[0, np.cumsum(np.frombuffer(blob[8 : 8 * (n + 1)], np.int64))]
        return cls([CuckooFilter.from_bytes(blob[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])


#: Keys up to which a screen of them (2.4 bytes a key) goes to every executor.
MAX_SCREEN_KEYS = 8_000_000


@dataclass
class Screen:
    """Cuckoo filters of a set of longs, by shard: no member is rejected."""

    shards: list[bytes]

    def keep(self, keys: np.ndarray, made: dict[int, CuckooFilter]) -> np.ndarray:
        """Which keys may be members; made: holds the filters already unpacked."""
        out, shard = np.zeros(len(keys), bool), np.mod(keys, len(self.shards))
        for n in np.unique(shard):
            if n not in made:
                made[n] = CuckooFilter.from_bytes(self.shards[n])
            out[shard == n] = made[n].contains(keys[shard == n])
        return out


def screen_of(keys: DataFrame, most: int | None = None) -> Screen | None:
    """A screen of the distinct longs of a one-column table, or None if they are too many to send."""
    n = keys.count()
    if n > (MAX_SCREEN_KEYS if most is None else most):
        return None
    shards = max(1, -(-n // 500_000))

    def build(pdf):
        import pandas as pd

        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [CuckooFilter.build(pdf["key"].to_numpy()).to_bytes()]})

    key = F.col(keys.columns[0])
    made = keys.select(key.alias("key"), F.pmod(key, F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")
    found = {r["shard"]: bytes(r["filter"]) for r in made.collect()}
    return Screen([found.get(k, CuckooFilter(4).to_bytes()) for k in range(shards)])
