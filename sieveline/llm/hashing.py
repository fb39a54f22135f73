"""Vectorised word, shingle and set hashing shared by the numpy operators.

A word is a maximal run of bytes outside ASCII white space (0x20, 0x09-0x0D). Hashes are 64-bit and depend on
nothing but the word's bytes, so every executor, run and partition computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POSITION = _rng.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = [np.uint64(0x632BE59BD9B4E019 * n % (1 << 64)) for n in range(SHINGLE_WORDS)]

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    h = h + _MULT
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(buf: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each maximal run of non-separator bytes in ``buf`` (uint8)."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~separators[buf]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    up, down = _powers.upto(len(buf))
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[buf] * up, out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``limit`` bytes together, or of one text."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if len(texts) > first:
        yield first, len(texts)


def text_parts(text: bytes, separators: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about a slice each that end at a separator."""
    buf, at = np.frombuffer(text, np.uint8), 0
    while at < len(buf):
        end = min(len(buf), at + SLICE_BYTES)
        while end < len(buf):
            found = np.flatnonzero(separators[buf[end : end + SLICE_BYTES]])
            if len(found):
                end += int(found[0])
                break
            end = min(len(buf), end + SLICE_BYTES)
        yield buf[at:end]
        at = end


def document_word_hashes(texts: list[bytes], separators: np.ndarray = WHITE, joiner: bytes = b"\n") -> Iterator[np.ndarray]:
    """Word hashes of each text, in order; memory is bounded by a slice, or one text's hashes."""
    for first, last in slices(texts):
        if last - first == 1 and len(texts[first]) > SLICE_BYTES:
            parts = [run_hashes(p, separators)[2] for p in text_parts(texts[first], separators)]
            yield np.concatenate(parts) if parts else np.empty(0, np.uint64)
            continue
        group = texts[first:last]
        starts, _, hashes = run_hashes(np.frombuffer(joiner.join(group) + joiner, np.uint8), separators)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in group]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield hashes[a:b]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of every run of five words; of the whole sequence when it is shorter; none for no words. Not distinct."""
    n = len(words) - SHINGLE_WORDS + 1
    if n > 0:
        total = words[:n] * _POSITION[0]
        for k in range(1, SHINGLE_WORDS):
            total += words[k : n + k] * _POSITION[k]
        return mix(total)
    if not len(words):
        return np.empty(0, np.uint64)
    return mix((words * _POSITION[: len(words)]).sum(keepdims=True, dtype=np.uint64) + _SHORT[len(words)])


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (UTF-8); ASCII letters are lower-cased."""
    for words in document_word_hashes([t.lower() for t in texts]):
        yield np.unique(shingles(words))


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 32-bit multipliers: x -> a * x + b mod 2**32 permutes the 32-bit numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1 << 20, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def minima(elements: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """For each permutation the least image of the elements' upper 32 bits; all ones for an empty set."""
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    x = (elements >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[at : at + 512, None] * mult + add).min(axis=0), out=low)
    return low


def encoded(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8; null counts as empty."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in column.to_pylist()]
