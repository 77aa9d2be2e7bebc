"""Word shingles of whole texts as 64-bit hashes, computed on bytes in bulk.

Words are maximal runs of bytes other than ASCII white space, with A-Z lowered. A stretch of the text,
words joined by one space, has the hash sum(T[byte] * P^place) / P^start modulo 2^64, finalised; running
sums give all stretches of a text at once.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_PRIME = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 15
_SALT = np.frombuffer(b"".join(hashlib.blake2b(b"shingle %d" % i, digest_size=8).digest() for i in range(256)), np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LIMIT = 1 << 18
_UP, _DOWN = _powers(_PRIME, _LIMIT), _powers(pow(_PRIME, -1, 1 << 64), _LIMIT)


def finalise(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space


def _stretches(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all stretches of `size` words, for words whose joined length is under _LIMIT."""
    buf = np.frombuffer(b" ".join(words), np.uint8)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_SALT[buf] * _UP[: len(buf)], out=sums[1:])
    gaps = np.flatnonzero(buf == 32)
    starts = np.concatenate([[0], gaps + 1])[: len(words) - size + 1]
    ends = np.concatenate([gaps, [len(buf)]])[size - 1 :]
    return finalise((sums[ends] - sums[starts]) * _DOWN[starts])


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """One hash for each place where `size` words begin, in order; none if there are fewer words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    most = _LIMIT // (2 * size) - 1  # by size alone, so that equal words count alike in all texts; 2 * size - 1 words fit
    if most < 33:
        raise ValueError(f"stretches of {size} words are too long to hash")
    longest = max(map(len, words)) + 1
    if longest > most + 1:  # digests stand in for words of thousands of bytes
        words = [w if len(w) <= most else b"\xff" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in words]
        longest = max(map(len, words)) + 1
    step = max(size, min(_SEGMENT, _LIMIT // longest - size))
    if len(words) <= step or sum(map(len, words)) + len(words) < _LIMIT:
        return _stretches(words, size)
    return np.concatenate([_stretches(words[a : a + step + size - 1], size) for a in range(0, len(words) - size + 1, step)])


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one without words has none."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(size, len(words))))
