"""Words, their ids and the hashes of word n-grams, over whole Arrow batches.

Words are runs of letters and digits after NFKC and removal of invisible characters,
compared without letter case.
"""

from __future__ import annotations

import re
import unicodedata
from hashlib import blake2b

import numpy as np

#: Soft hyphen, zero-width space, non-joiner, joiner, word joiner, byte order mark.
INVISIBLE = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
#: A task forgets its word table at this many entries; ids depend on the word alone.
MAX_CACHE = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The words of a text; none of a null or blank one."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", text.translate(INVISIBLE)).casefold())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordIds:
    """64-bit ids of words, the same on every machine."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        new = set(tokens).difference(self.known)
        if len(self.known) + len(new) > MAX_CACHE:
            self.known, new = {}, set(tokens)
        for w in new:
            self.known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n`` successive ids; empty if there are fewer."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * _STEP + ids[k : len(ids) - n + 1 + k]
    return mix(h)
