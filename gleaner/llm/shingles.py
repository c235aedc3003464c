"""Word shingles and circulant MinHash signatures, as array operations."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np

#: Places of the permutations.
PLACES = 1 << 20
#: Bytes of words whose hashes a worker remembers.
REMEMBERED = 32 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Hashes(dict):
    """A cryptographic hash of 64 bits of every word that is asked for."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.held += len(word) + 128
        if self.held > REMEMBERED:
            self.clear()
            self.held = len(word) + 128
        self[word] = h
        return h


class _Numbers(dict):
    """A number for every word, from 0 on."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_hashes = _Hashes()


def split(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case.  bytes.split() knows the same
    white space as the contracts, and bytes.lower() changes nothing but A-Z."""
    return (text or "").encode().lower().split()


def digest(words: list[bytes]) -> bytes:
    """The same for the same words in the same order only."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingles(texts: list[list[bytes]], words: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text (its words) the distinct shingles, sorted, and 64-bit
    hashes of them.  A text of fewer words is one shingle; without words it has
    none.

    Shingles are numbers that, within one call, stand for the same words and no
    others: equal numbers are equal shingles, not just equal hashes.
    """
    # No word is empty, so a filled-up text is equal to no longer one.
    filled = [t + [b""] * (words - len(t)) if 0 < len(t) < words else t for t in texts]
    numbers = _Numbers()
    lengths = np.fromiter(map(len, filled), np.int64, len(filled))
    total = int(lengths.sum())
    if not total:
        return [np.empty(0, np.int64) for _ in texts], [np.empty(0, np.uint64) for _ in texts]
    codes = np.fromiter(map(numbers.__getitem__, chain.from_iterable(filled)), np.int64, total)
    own = np.fromiter(map(_hashes.__getitem__, numbers), np.uint64, len(numbers))
    m = total - words + 1
    out, size = codes[:m], len(numbers)
    h = np.zeros(m, np.uint64)
    for k in range(words):
        at = codes[k : k + m]
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + own[at])
        if k:
            if size * len(numbers) >= 1 << 62:
                out = np.unique(out, return_inverse=True)[1]
                size = int(out.max()) + 1
            out, size = out * len(numbers) + at, size * len(numbers)
    sets, hashes = [], []
    for begin, n in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist()):
        end = begin + max(0, n - words + 1)
        sets.append(np.unique(out[begin:end]))
        hashes.append(np.unique(h[begin:end]))
    return sets, hashes


class Circulant:
    """Signatures from two permutations of PLACES places: the first deals the
    shingles to places, the second, shifted by k, gives coordinate k: the
    least value at any of the set's places.  The shifted values of a place
    lie next to each other, so one read serves all coordinates."""

    def __init__(self, coordinates: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self._first = rng.permutation(PLACES).astype(np.uint32)
        second = rng.permutation(PLACES).astype(np.uint32)
        ring = np.append(second, second[: coordinates - 1])
        self._shifted = np.lib.stride_tricks.sliding_window_view(ring, coordinates)
        self._k = coordinates

    def signature(self, shingles: np.ndarray, step: int = 1024) -> np.ndarray:
        places = self._first[(shingles % np.uint64(PLACES)).astype(np.int64)]
        out = np.full(self._k, PLACES, np.uint32)
        for k in range(0, len(places), step):
            np.minimum(out, self._shifted[places[k : k + step]].min(axis=0), out=out)
        return out

    def bands(self, shingles: np.ndarray, rows: int) -> np.ndarray:
        """A 64-bit hash for each band of the signature."""
        s = self.signature(shingles).astype(np.uint64)[: self._k // rows * rows].reshape(-1, rows)
        h = mixed(np.arange(len(s), dtype=np.uint64) + np.uint64(1))
        for k in range(rows):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
        return h.view(np.int64)
