"""Shingle sets of whole texts and their circulant MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from . import caches

#: Words of a shingle.
SIZE = 5
_WORDS = 200_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Hashes()
caches.register("words", _known.clear)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text.

    bytes.split() parts at space and 0x09-0x0D, and bytes.lower() changes A-Z alone.
    """
    caches.claim("words")
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct word shingles of a text, A-Z lower-cased.

    A text with fewer words is one shingle of them all; null, empty or blank: no shingle.
    """
    ids = word_hashes(text)
    if not len(ids):
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(ids) - size + 1)
    h = np.full(n, min(size, len(ids)), dtype=np.uint64)
    for i in range(min(size, len(ids))):
        h = h * _M[0] + ids[i : i + n]
    return np.unique(_finish(h))


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union of two ascending sets that are not empty."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Circulant:
    """Signatures of `k` coordinates from two permutations of a universe of `universe` places.

    The first scatters the shingles over the universe; coordinate i is the least value that the second,
    circularly shifted by i, gives to any of them. The shifted copies are windows of one array: the k
    values of a shingle lie side by side, and a signature is the minimum of its shingles' windows.
    """

    def __init__(self, k: int, universe: int = 1 << 21, seed: int = 1):
        self.k, self.universe = k, universe
        rng = np.random.default_rng(seed)
        second = rng.permutation(universe).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)
        # the first permutation acts on a universe far larger than an array: a bijection of 64-bit hashes, cut to the array's places
        self.mul = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (_finish(shingles * self.mul) % np.uint64(self.universe)).astype(np.int64)
        out = None
        for start in range(0, len(places), 1024):
            low = self.windows[places[start : start + 1024]].min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of `rows` coordinates; equal keys in different bands are not alike."""
    h = np.arange(1, bands + 1, dtype=np.uint64) * _M[2]
    for i in range(rows):
        h = _finish(h * _M[0] + signature[i : bands * rows : rows].astype(np.uint64))
    return h.view(np.int64)
