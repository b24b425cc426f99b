"""Hashes of words and word windows for whole batches of texts, without a loop over words.

A word of up to 16 bytes is mapped one to one to 128 bits (a Feistel network over its bytes, with its length in the
keys); a longer one has 128 bits of BLAKE2b. So no structure of words makes two of them equal. The halves are two independent
lanes. A window's hash in a lane is a sum of its words' hashes with one odd factor for each place, mixed to 64 bits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Bytes that separate words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _factors(lane: int) -> np.ndarray:
    """Random odd factors of the places of a window."""
    return np.random.default_rng(1000 + lane).integers(0, 1 << 63, 64, dtype="u8") * np.uint64(2) + np.uint64(1)


def find_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    blank = np.concatenate(([True], BLANK[buf], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


#: Keys of the rounds, and masks of the first bytes of an integer.
ROUNDS = np.random.default_rng(1002).integers(0, 1 << 63, 6, dtype="u8")
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(2, words): both lanes of each word's hash."""
    size = ends - starts
    padded = np.concatenate((buf, np.zeros(16, "u1")))
    eight = np.ndarray(len(buf) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    a = eight[starts] & FIRST[np.minimum(size, 8)]
    b = eight[starts + np.minimum(size, 8)] & FIRST[np.clip(size - 8, 0, 8)]
    length = size.astype("u8") << np.uint64(56)
    for i in range(0, len(ROUNDS), 2):
        b = b ^ mix(a ^ ROUNDS[i] ^ length)
        a = a ^ mix(b ^ ROUNDS[i + 1])
    out = np.stack((a, b))
    long = np.flatnonzero(size > 16)
    if len(long):
        digests = [hashlib.blake2b(buf[s:e].tobytes(), digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[:, long] = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).T
    return out


def hash_windows(words: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` words; run i starts at word i."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, "u8")
    factors = _factors(lane)
    total = np.zeros(n, "u8")
    for k in range(width):
        total += words[k : k + n] * factors[k]
    return mix(total)


class Batch:
    """Words of several texts side by side: text t has the words first[t] to first[t + 1]."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.buf = np.frombuffer(b" ".join(texts), "u1")
        self.starts, self.ends = find_words(self.buf)
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, edges)
        self.last = np.repeat(self.first[1:], np.diff(self.first))  # end of each word's text
        self.hashes: np.ndarray | None = None

    def words(self, lane: int = 0) -> np.ndarray:
        """Hash of each word in a lane."""
        if self.hashes is None:
            self.hashes = hash_words(self.buf, self.starts, self.ends)
        return self.hashes[lane]

    def inside(self, width: int) -> np.ndarray:
        """Whether the window that starts at each word ends in the same text."""
        return np.arange(len(self.starts)) + width <= self.last
