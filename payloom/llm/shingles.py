"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import utf8_of

#: Bytes that are hashed at once (a longer text is a chunk of its own).
CHUNK_BYTES = 2_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_FACTORS = _rng.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_TABLE = _BYTE[_LOWER]
_P = int(_FACTORS[63])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, kept up to the longest chunk so far."""

    def __init__(self, chunk: int = CHUNK_BYTES):
        self.up = self.down = np.ones(1, np.uint64)
        self.chunk = chunk

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, self.chunk + 1)
            for name, base in (("up", _P), ("down", pow(_P, -1, 2**64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up, self.down


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z in lower case) of the texts laid end to end, and where each text's words start."""
    n = len(data)
    solid = ~_SPACE[data]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers.of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:n], dtype=np.uint64, out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def shingle_sets(batch_texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) for each text: its k-word shingles, or with fewer words the one whole sequence."""
    data, offsets = utf8_of(batch_texts)
    powers = _Powers()
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, "right")) - 1)
        words, at = word_hashes(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], powers)
        if len(words) >= k:
            total = words[: len(words) - k + 1] * _FACTORS[0]
            for j in range(1, k):
                total += words[j : len(words) - k + 1 + j] * _FACTORS[j]
            total = mix(total)
        for i in range(end - start):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                found = np.sort(total[a : b - k + 1])
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield start + i, found[keep]
            elif b > a:
                yield start + i, mix((words[a:b] * _FACTORS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield start + i, np.zeros(0, np.uint64)
        start = end


def set_identity(tokens: np.ndarray) -> np.int64:
    """A 64-bit name of the set: two different sets of n in all share one with probability below n^2 / 2^65."""
    with np.errstate(over="ignore"):
        return mix(mix(tokens + _FACTORS[1]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(tokens))).view(np.int64)[0]
