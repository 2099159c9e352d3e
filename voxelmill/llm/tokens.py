"""Exact ids of a byte-level BPE vocabulary by ``tokenizers``, whole texts.

Ids come from the vocabulary file's BPE model, a piece at a time, and each different short piece once per worker. Texts of ASCII,
Latin letters and common punctuation are cut in pieces here, by the pre-tokenizer's own pattern; on other scripts, whose character
classes may differ by Unicode version, and on texts that hold a special token, the whole tokenizer runs.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

# Letters and punctuation beyond ASCII whose classes no Unicode version has changed.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", "«»¡¿–—‘’“”„…€"
_OTHER = re.compile(f"[^\x00-\x7f{_LETTERS}{_MARKS}]")
# Fixed value: the pattern that byte-level vocabularies of this family cut text by, for the characters above.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Characters of a piece up to which its ids are remembered, and how many pieces a worker remembers before it starts anew.
SHORT, REMEMBERED = 48, 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[int, str]:
    """The character by which the vocabulary names each byte: printable ones stand for themselves, others for 256 and up in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}


class Vocabulary:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.names = self.tokenizer.model, _byte_names()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # ids of a short piece

    def _learn(self, piece: str) -> bytes:
        named = piece.encode("utf-8").decode("latin-1").translate(self.names)
        ids = np.array([t.id for t in self.model.tokenize(named)], "<u4").tobytes()
        if len(piece) <= SHORT:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit, without special tokens around them."""
        if (not text.isascii() and _OTHER.search(text)) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if len(self.known) > REMEMBERED:
            self.known.clear()
        pieces = _PIECES.findall(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self.known.get(p) or self._learn(p) if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        return np.frombuffer(b"".join(found), "<u4")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(text: str, path: str) -> np.ndarray:
    return vocabulary(path).encode(text)
