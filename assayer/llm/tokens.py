"""Words as 64-bit numbers, flat over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np

#: Words remembered by one Python worker before its memory of them is emptied.
MOST_REMEMBERED = 400_000


class WordHash(dict):
    """word -> 64-bit hash, the same everywhere; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def flat(texts: Iterable[list[str]], memory: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one after another, where each text begins; one entry more than texts)."""
    get, out, ends = memory.__getitem__, [], [0]
    for ws in texts:
        out.extend(map(get, ws))
        ends.append(len(out))
    return np.array(out, dtype=np.uint64), np.array(ends, dtype=np.int64)
