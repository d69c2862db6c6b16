"""Suffix arrays by induced sorting, a bucket at a time in numpy."""

from __future__ import annotations

import numpy as np

from stallbook.llm import wordhash


def _ranked_within(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, the place of each within its key, and the counts."""
    order = np.argsort(keys, kind="stable")
    counts = np.bincount(keys, minlength=size)
    begins = np.cumsum(counts) - counts
    return order, np.arange(len(keys)) - begins[keys[order]], counts


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order ``lms``."""
    n = len(text)
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    heads = ends - counts
    found = np.full(n, -1, np.int64)

    # larger suffixes, left to right: a bucket's larger suffixes stand before its smaller ones
    order, place, own = _ranked_within(text[lms], size)
    seeds = lms[order]
    seed_begins = np.concatenate([[0], np.cumsum(own)])
    filled = heads.copy()

    def push_right(at: np.ndarray, bucket: int) -> np.ndarray:
        """Appends the larger suffixes before ``at``; returns those that fall in the same bucket."""
        before = at[at > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return before
        keys = text[before]
        order, place, own = _ranked_within(keys, size)
        sorted_keys = keys[order]
        found[filled[sorted_keys] + place] = before[order]
        filled[:] += own
        return before[keys == bucket]

    for bucket in np.flatnonzero(counts).tolist():
        front = found[heads[bucket]: filled[bucket]]
        while len(front):
            front = push_right(front, bucket)
        own_seeds = seeds[seed_begins[bucket]: seed_begins[bucket + 1]]
        if len(own_seeds):
            push_right(own_seeds, -1)

    # smaller suffixes, right to left
    larger_ends = filled.copy()
    tails = ends.copy()

    def push_left(at: np.ndarray, bucket: int) -> np.ndarray:
        """Prepends the smaller suffixes before ``at`` (given from right to left)."""
        before = at[at > 0] - 1
        before = before[smaller[before]]
        if not len(before):
            return before
        keys = text[before]
        order, place, own = _ranked_within(keys, size)
        sorted_keys = keys[order]
        found[tails[sorted_keys] - 1 - place] = before[order]
        tails[:] -= own
        return before[keys == bucket]

    for bucket in np.flatnonzero(counts)[::-1].tolist():
        front = found[tails[bucket]: ends[bucket]][::-1]
        while len(front):
            front = push_left(front, bucket)
        larger = found[heads[bucket]: larger_ends[bucket]]
        if len(larger):
            push_left(larger[::-1], -1)
    return found


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Start positions of the suffixes of ``data`` (uint8) in order.

    Suffixes are classed as smaller or larger than the next one. The leftmost-smaller substrings are
    ordered by inducing from their first bytes, and named; the string of names, which has a large
    alphabet, is ranked by repeated pairing of names. From that order one more pass induces the
    whole array in linear time. With ``depth`` only the first so many bytes need be ordered.
    """
    n = len(data)
    text = np.empty(n + 1, np.int64)
    text[:n] = data
    text[:n] += 1
    text[n] = 0
    # a run of equal bytes takes the class of its last one
    differs = np.flatnonzero(text[1:] != text[:-1])
    following = differs[np.searchsorted(differs, np.arange(n))] if n else differs
    smaller = np.ones(n + 1, bool)
    smaller[:n] = text[following] < text[following + 1]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        ordered = _induce(text, smaller, lms, 257)
        is_lms = np.zeros(n + 1, bool)
        is_lms[lms] = True
        ordered = ordered[is_lms[ordered]]
        # a substring reaches to the next leftmost-smaller position, inclusive
        nth = np.empty(n + 1, np.int64)
        nth[lms] = np.arange(len(lms))
        ends = np.append(lms[1:] + 1, n + 1)
        hashes = wordhash.spans(wordhash.prefix(np.append(data, np.uint8(0))), lms, ends)
        in_order = hashes[nth[ordered]]
        names = np.empty(len(lms), np.int64)
        names[nth[ordered]] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        names = _ranks(names, None if depth is None else depth)
        lms = lms[np.argsort(names, kind="stable")]
    return _induce(text, smaller, lms, 257)[1:]


def _ranks(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Ranks of the suffixes of ``names``; a name stands for one byte of ``depth`` at least."""
    reach, m = 1, len(names)
    while names.max() + 1 < m and (depth is None or reach < depth):
        later = np.zeros(m, np.int64)
        later[: m - reach] = names[reach:] + 1
        key = names * (m + 1) + later
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        names = np.empty(m, np.int64)
        names[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        reach *= 2
    return names


def common_with_previous(data: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """For every position, whether it shares ``length`` bytes with the suffix before it in the array.

    These are the permuted common prefixes, in the order of the text, capped at ``length``.
    """
    n = len(data)
    sums = wordhash.prefix(data)
    previous = np.full(n, -1, np.int64)
    previous[suffixes[1:]] = suffixes[:-1]
    shared = np.zeros(n, bool)
    at = np.flatnonzero((previous >= 0) & (np.arange(n) + length <= n))
    at = at[previous[at] + length <= n]
    shared[at] = wordhash.spans(sums, at, at + length) == wordhash.spans(sums, previous[at], previous[at] + length)
    return shared
