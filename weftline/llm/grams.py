"""Character n-grams of many words at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def spelt(words: list[str], left: str = "", right: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words between marks in one array, where each begins and how long it is."""
    joined = left + (right + left).join(words) + right if words else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + len(left) + len(right)
    return codes, np.cumsum(lengths) - lengths, lengths


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return hashes ^ (hashes >> np.uint64(29))


def gram_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all words, in order, and the number of the word that each is in.

    Two different n-grams share a hash with a chance of about 2**-64.
    """
    counts = np.maximum(0, lengths - n + 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(owner):
        return np.zeros(0, dtype=np.uint64), owner
    rolled = codes.copy()
    for k in range(1, n):
        rolled = rolled[:-1] * np.uint64(_BASE) + codes[k:]
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
    return mixed(rolled[at] + np.uint64(n)), owner


def word_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each whole word: its polynomial, by powers that count from the word's end."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    longest = int(lengths.max())
    powers = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(max(0, longest - 1), _BASE, dtype=np.uint64))))
    place = np.repeat(starts + lengths - 1, lengths) - np.arange(int(lengths.sum()))
    return mixed(np.add.reduceat(codes * powers[place], starts) + lengths.astype(np.uint64))
