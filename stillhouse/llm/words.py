"""Words, word hashes and shingles of texts, vectorised inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Maximal runs of letters and digits of any script.
WORD = re.compile(r"[^\W_]+")


class WordIds(dict):
    """Word to a 64-bit id, computed once per word and task; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


def word_ids(texts: list[str | None], cache: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of ``texts`` in a row, and the offsets of each text (one more than texts)."""
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    ids: list[int] = []
    for i, text in enumerate(texts):
        if text:
            ids.extend(map(cache.__getitem__, WORD.findall(text.lower())))
        counts[i + 1] = len(ids)
    return np.array(ids, dtype=np.uint64), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of the values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` ids; empty where there are fewer."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(31) + ids[k : k + n] + np.uint64(k + 1))
    return h
