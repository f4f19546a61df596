"""Hashes of words and of runs of words, over numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from tallyloom.llm.shared import worker_cache

MEMO_ENTRIES = 100_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs outside ASCII white space, which bytes.split() cuts at."""
    return (text or "").encode("utf-8").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits for each word."""
    return np.fromiter(map(worker_cache(("word hashes",), _WordHashes, large=True).__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> _HALF)) * _MIX
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs, in order."""
    return mixed(left * _SPREAD + right)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from doubled runs: about log2(k) passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, covered, level, width = None, 0, h, 1
    while True:
        if k & width:
            part = level[covered : covered + n]
            out = part if out is None else joined(out, part)
            covered += width
        if width * 2 > k:
            return mixed(out + np.uint64(k))
        level = joined(level[:-width], level[width:])
        width *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours."""
    if len(x) < w:
        return np.empty(0, dtype=x.dtype)
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = w - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def sequence_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a word sequence, as two signed integers."""
    digest = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
