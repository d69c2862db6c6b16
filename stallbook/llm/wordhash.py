"""Vectorised hashes of words and byte strings (64-bit polynomials, finished by a mixer)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: bytes handled at once; a single longer word is handled whole
SLICE = 1 << 19

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least ``n`` places."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the hash of any part of ``data`` (uint8)."""
    power, _ = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the parts ``[start, end)``; equal bytes have equal hashes wherever they stand."""
    _, inverse = _grown(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _LENGTH)


def _cut(data: bytes) -> Iterator[bytes]:
    """Slices of a long text, cut at white space."""
    at = 0
    while len(data) - at > SLICE:
        end = at + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def words(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, index of the text) of every word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, in order.

    Yields bounded pieces; a long text comes in several, texts without words in none.
    """
    def hashed(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
        data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
        space = _SPACE[data]
        inside = np.empty(len(data) + 1, np.int8)
        inside[0] = 0
        inside[1:] = ~space
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])
        owner = np.asarray(owners, np.int64)[np.searchsorted(begins, starts, "right") - 1]
        return spans(prefix(data), starts, ends), owner

    parts: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for part in _cut(text):
            if parts and size + len(part) > SLICE:
                yield hashed(parts, owners)
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(i)
            size += len(part) + 1
    if parts:
        yield hashed(parts, owners)
