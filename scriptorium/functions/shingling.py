"""Word-shingle hashes in vectorised batches.

Higher-order functions hash shingles row by row in interpreted code; here a batch's words are hashed once each (memo per
worker) and shingles come from rolling array arithmetic, about twenty times faster on whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORDS = re.compile("[a-z0-9]+").findall
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MEMO: dict[str, int] = {}
#: Distinct words kept in a worker's memo at most.
MEMO_WORDS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the maximal runs of a-z0-9 in the lower-cased text."""
    words = _WORDS(text.lower()) if text else []
    if len(_MEMO) > MEMO_WORDS:
        _MEMO.clear()
    out = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        value = _MEMO.get(word)
        if value is None:
            value = _MEMO[word] = xxhash.xxh64_intdigest(word)
        out[i] = value
    return out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of `n` consecutive words, in order; empty if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = words[:count].copy()
    for k in range(1, n):
        total = total * _STEP + words[k : k + count]
    return mix(total)
