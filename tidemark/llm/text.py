"""Vectorised text kernels: words, polynomial fingerprints and byte-balanced batches over Arrow strings.

Texts of a batch lie in one byte array. A fingerprint of any stretch is a difference of prefix sums, so cost is a
few passes over the bytes whatever the number of words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_LETTERS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Gives what a task has freed back to the system; workers live on, and stages share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _grow(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        m = min(have, n - have)
        np.multiply(out[:m], out[have - 1] * np.uint64(base), out=out[have : have + m])
        have += m
    return out


class _Powers:
    """Powers of the base and of its inverse mod 2^64, grown to the longest batch seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 18)
            with np.errstate(over="ignore"):
                self.up, self.down = _grow(_BASE, size), _grow(_INVERSE, size)
        return self.up, self.down


POWERS = _Powers()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambler of 64 bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of values[start:end], mixed, from prefix_sums(values)."""
    _, down = POWERS.upto(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all stretches of a fixed width."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, np.uint64)
    _, down = POWERS.upto(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and len(texts) + 1 offsets. A null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def by_bytes(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer row is alone."""
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to
        at = to


class Words:
    """Words of a batch: byte starts and ends, the offset of each document's first word, fingerprints."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray, fold: bool = False) -> None:
        if fold:
            data = LOWER[data]
        inside = kind[data]
        n = len(data)
        opens, closes = np.ones(n, bool), np.ones(n, bool)
        opens[1:] = ~inside[:-1]
        closes[:-1] = ~inside[1:]
        edges = off[:-1][off[:-1] < n]
        opens[edges] = True
        closes[edges[edges > 0] - 1] = True
        self.start = np.flatnonzero(opens & inside)
        self.end = np.flatnonzero(closes & inside) + 1
        self.first = np.searchsorted(self.start, off)
        self.name = stretch(prefix_sums(_LETTERS[data]), self.start, self.end) if len(self.start) else np.empty(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_LETTERS[data])


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of a width that lie in one document, given the documents' offsets."""
    n = np.diff(first)
    count = np.maximum(n - width + 1, 0)
    total = int(count.sum())
    return np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(total)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + width) of any start."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0
