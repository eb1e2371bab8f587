"""Word and shingle hashes for tasks (numpy); no Spark here."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHE_WORDS = 1 << 18
_words: dict[bytes, int] = {}
_STEP = 0x9E3779B97F4A7C15


def split_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; ``bytes`` methods know ASCII only, as wanted here."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; a bounded cache holds the words met so far in this worker."""
    if len(_words) > _CACHE_WORDS:
        _words.clear()
    out = list(map(_words.get, words))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                out[i] = _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.array(out, dtype=np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False) | np.uint64(1)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order; fewer words than ``k`` are one run as a whole."""
    n = len(hashes)
    if n == 0:
        return hashes
    m = multipliers(k, 17)
    width = min(k, n)
    out = np.full(n - width + 1, width * _STEP % (1 << 64), dtype=np.uint64)
    for j in range(width):
        out += hashes[j : n - width + 1 + j] * m[j]
    return scramble(out)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(windows(word_hashes(split_words(text or b"")), k))
