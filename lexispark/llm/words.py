"""Words of UTF-8 texts as 64-bit hashes, for numpy work inside tasks.

Words stand for their XXH3 64-bit hash: two of n words share one with a probability under n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import xxhash

_UPPER = bytes(range(65, 91))
#: Lower-cases A-Z; bytes that are no word characters (ASCII other than digits and letters) become spaces.
ALNUM = bytes(b + 32 if b in _UPPER else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def spaced(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII white space."""
    return text.lower().split()


def alnum(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and all that is not ASCII."""
    return text.translate(ALNUM).split()


class Hashes(dict):
    """Hash by word; forgets all when full, so memory stays bounded."""

    def __init__(self, most: int = 150_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
