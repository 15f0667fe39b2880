"""Vectorised hashing of words and word shingles.

A word is a run of characters other than the white space of the contracts, lower-cased. Hashes
are worked out over the bytes of a whole batch at once: a polynomial over each word's bytes
modulo 2**64, then mixed.
"""

from __future__ import annotations

import functools

import numpy as np

#: Words in a shingle.
SHINGLE = 5
#: Bytes hashed at once; longer texts go in parts that end at white space.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MARK = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(maxsize=1)
def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def _hash_bytes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word in an array of bytes."""
    inside = np.concatenate(([False], ~_space()[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, past = edge[::2], edge[1::2]
    if not len(first):
        return first, np.zeros(0, np.uint64)
    n = 1 << max(10, int(len(b)).bit_length())
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[: len(b)], dtype=np.uint64)))
    h = (total[past] - total[first]) * _powers(_INVERSE, n)[first]
    return first, mix64(h ^ (past - first).astype(np.uint64) * _MARK)


def _parts(text: bytes) -> list[bytes]:
    """The text in parts of about CHUNK bytes, cut at white space."""
    if len(text) <= CHUNK:
        return [text]
    out, at = [], 0
    b = np.frombuffer(text, np.uint8)
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text):  # on to the next white space
            gap = np.flatnonzero(_space()[b[end : end + CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(text), end + CHUNK)
        out.append(text[at:end])
        at = end
    return out


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            starts = np.cumsum([0] + [len(p) + 1 for _, p in held])
            first, h = _hash_bytes(np.frombuffer(b" ".join(p for _, p in held), np.uint8))
            cut = np.searchsorted(first, starts)
            for i, (row, _) in enumerate(held):
                out[row].append(h[cut[i] : cut[i + 1]])
        held, size = [], 0

    for row, text in enumerate(texts):
        for part in _parts((text or "").lower().encode("utf-8", "surrogatepass")):
            held.append((row, part))
            size += len(part)
            if size >= CHUNK:
                flush()
    flush()
    return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint64) for x in out]


def shingle_counts(words: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of the n-word shingles, and how often each occurs; a shorter text is one shingle, one without words has none."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(_BASE) + words[i : len(words) - n + 1 + i]
    return np.unique(mix64(h ^ np.uint64(n)), return_counts=True)
