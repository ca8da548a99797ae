"""Words of texts inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHashes(dict):
    """64-bit hashes of words (bytes); those met before are looked up, up to a bounded number (some 10 MB)."""

    LIMIT = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
