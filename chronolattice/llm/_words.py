"""Vectorised word hashing: whole batches of texts become arrays of 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes in which a batch is hashed at once; a longer text makes a batch of its own.
CHUNK_BYTES = 1 << 20

#: White space 0, all else 1.
SPACES = np.ones(256, np.uint8)
SPACES[[0x20, *range(0x09, 0x0E)]] = 0
#: White space 0, letters, digits and bytes beyond ASCII 1, signs 2.
SIGNS = SPACES.copy()
for _b in range(0x21, 0x7F):
    if not chr(_b).isalnum():
        SIGNS[_b] = 2

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(texts: list[bytes], classes: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each maximal run of one class (other than white space)."""
    joined = b"\n".join(texts)
    a = np.frombuffer(joined, np.uint8)
    n = len(a)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kinds = classes[a]
    edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [n]))
    inside = kinds[starts] != 0
    starts, ends = starts[inside], ends[inside]
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[a] * power[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return mix(raw + (ends - starts).astype(np.uint64)), doc


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of at most ``limit`` bytes, or one longer text."""
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield start, held
            start, held, size = k, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield start, held
