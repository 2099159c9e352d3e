"""Levenshtein automata of words intersected with a lexicon trie.

A lexicon entry is a whole word or a stem (any ending may follow). The trie has a node per different beginning of entries. The
Levenshtein automaton of a word is run as bits (Wu and Manber 1992): bit i of row d says that the characters on the way from the
root can be turned into the first i characters of the word with d edits at most. The walk goes down the trie once for
all words of a batch: a node's rows come from its parent's by a few operations on whole arrays, and only words whose rows are not
empty at the largest distance that an entry below admits go on. So a word meets the nodes near it, however many entries there are,
and nothing is determinised. Each different word of a worker is looked up once, up to ``REMEMBERED`` words, which then start anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

REMEMBERED = 1_000_000
#: Characters of a word in a machine word of bits; longer words and entries take several.
_BITS = 62


@dataclass(frozen=True)
class Entry:
    text: str
    stem: bool = False  # any ending may follow
    distance: int = 0


@dataclass
class Trie:
    """Nodes 0 (the root) and up; a node comes after its parent."""

    entries: list[Entry]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])  # entries that end at a node
    reach: list[int] = field(default_factory=lambda: [0])  # the largest distance of the entries at a node and below

    @classmethod
    def of(cls, entries: list[Entry]) -> Trie:
        made = cls(list(entries))
        for n, e in enumerate(entries):
            node = 0
            made.reach[0] = max(made.reach[0], e.distance)
            for c in e.text:
                if c not in made.children[node]:
                    made.children[node][c] = len(made.children)
                    made.children.append({})
                    made.ends.append([])
                    made.reach.append(0)
                node = made.children[node][c]
                made.reach[node] = max(made.reach[node], e.distance)
            made.ends[node].append(n)
        return made

    def walk(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(entry, words, distances): which words match each entry, and with how many edits at least."""
        if not words or len(self.children) == 1:
            return
        # what follows the longest entry's end by more than its distance can only be the ending of a stem
        most = max(len(e.text) + e.distance for e in self.entries)
        size = np.array([min(len(w), most + 1) for w in words])
        planes = most // _BITS + 1  # bit positions 0 to most, and one that no entry reaches
        shape = (len(words), planes)
        letters: dict[str, np.ndarray] = {}
        lengths = np.minimum(size, most)
        codes = np.zeros((len(words), most), np.uint32)
        for k, w in enumerate(words):
            part = w[:most]
            codes[k, : len(part)] = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        for c in {c for e in self.entries for c in e.text}:
            mask = np.zeros(shape, np.uint64)
            hit = codes == ord(c)
            for p in range(planes):
                cols = hit[:, p * _BITS : (p + 1) * _BITS]
                if cols.shape[1]:
                    mask[:, p] = cols @ (np.uint64(1) << np.arange(cols.shape[1], dtype=np.uint64))
            letters[c] = mask
        inside = np.zeros(shape, np.uint64)  # bits up to the word's end
        for p in range(planes):
            inside[:, p] = (np.uint64(1) << np.clip(lengths + 1 - p * _BITS, 0, _BITS).astype(np.uint64)) - np.uint64(1)
        start = [np.zeros(shape, np.uint64) for _ in range(self.reach[0] + 1)]
        for d, row in enumerate(start):
            for i in range(d + 1):
                row[:, i // _BITS] |= np.uint64(1 << i % _BITS)
            row &= inside
        stack = [(c, node, np.arange(len(words)), start) for c, node in self.children[0].items()]
        while stack:
            c, node, alive, rows = stack.pop()
            alive, rows = self._step(letters[c], inside, alive, rows, self.reach[node])
            if not len(alive):
                continue
            for e in self.ends[node]:
                yield from self._match(e, size, alive, rows)
            stack += [(c, child, alive, rows) for c, child in self.children[node].items()]

    @staticmethod
    def _step(mask: np.ndarray, inside: np.ndarray, alive: np.ndarray, rows: list[np.ndarray], reach: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rows after one more character of the trie, of the words that can still match below."""
        mask, inside = mask[alive], inside[alive]
        out = [_shift(rows[0] & mask)]
        for d in range(1, reach + 1):
            out.append(_shift((rows[d] & mask) | rows[d - 1] | out[d - 1]) | rows[d - 1])
        out = [row & inside for row in out]
        keep = out[reach].any(axis=1)
        return (alive, out) if keep.all() else (alive[keep], [row[keep] for row in out])

    def _match(self, e: int, size: np.ndarray, alive: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        best = np.full(len(alive), -1)
        for d in range(self.entries[e].distance, -1, -1):
            if self.entries[e].stem:
                ok = rows[d].any(axis=1)
            else:  # a word cut off above is longer than any entry can reach
                end = size[alive]
                plane = np.minimum(end // _BITS, rows[d].shape[1] - 1)
                ok = (rows[d][np.arange(len(alive)), plane] >> (end - plane * _BITS).clip(0, 63).astype(np.uint64)) & np.uint64(1) > 0
            best[ok] = d
        hit = best >= 0
        if hit.any():
            yield e, alive[hit], best[hit]


def _shift(rows: np.ndarray) -> np.ndarray:
    """All bits one place up, over the planes of a row."""
    up = rows << np.uint64(1)
    if rows.shape[1] > 1:
        up[:, 1:] |= (rows[:, :-1] >> np.uint64(_BITS - 1)) & np.uint64(1)
        up &= np.uint64((1 << _BITS) - 1)
    return up


@dataclass
class Matcher:
    """A trie with what it found for the words it was asked for."""

    trie: Trie
    results: list[tuple[tuple[int, int], ...]] = field(default_factory=lambda: [()])  # (entry, distance) pairs by result; grows while reading
    number: dict[tuple, int] = field(default_factory=lambda: {(): 0})
    known: dict[str, int] = field(default_factory=dict)  # word to result

    @classmethod
    def of(cls, entries: list[Entry]) -> Matcher:
        return cls(Trie.of(entries))

    @property
    def entries(self) -> list[Entry]:
        return self.trie.entries

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}  # what a worker looked up stays with it

    def read(self, words: list[str]) -> np.ndarray:
        """The result of each word; 0 is no match."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new and len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(dict.fromkeys(words))
        for a in range(0, len(new), 1 << 16):
            some = new[a : a + (1 << 16)]
            found: dict[int, list[tuple[int, int]]] = {}
            for e, which, distance in self.trie.walk(some):
                for w, d in zip(which.tolist(), distance.tolist(), strict=True):
                    found.setdefault(w, []).append((e, d))
            self.known.update(dict.fromkeys(some, 0))
            for w, pairs in found.items():
                key = tuple(sorted(pairs))
                if key not in self.number:
                    self.number[key] = len(self.results)
                    self.results.append(key)
                self.known[some[w]] = self.number[key]
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
