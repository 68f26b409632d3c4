"""Suffix arrays of slice collections in numpy, and their common prefixes.

Texts are concatenations of slices; a suffix ends at the end of its slice,
where a sentinel of its own stands (the sentinel of an earlier slice is the
smaller).  Sorting is Larsson and Sadakane's refinement: suffixes ordered by
their first symbols, then groups of equal ones alone are split by the rank of
the suffix h symbols on, with h doubled each round.  Common prefixes come from
Kasai's theorem in its permuted form: the prefix shared with the predecessor
falls by at most one from a text position to the next, so only positions
where the preceding symbols differ are compared, and the rest follow.
"""

from __future__ import annotations

import numpy as np

_DIGITS = 7  # symbols of 9 bits in one key


def _keys(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(text)
    sym = np.zeros(n + _DIGITS, np.int64)
    sym[:n] = text.astype(np.int64) + 1
    at = np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(_DIGITS):
        key = (key << 9) | np.where(at + j < end, sym[j : j + n], 0)
    return key


def suffix_array(text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix with the predecessor) of slices bounded by ``cuts``."""
    n, s = len(text), len(cuts) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(cuts)
    of = np.repeat(np.arange(s), size)
    end = np.repeat(cuts[1:], size)
    key = _keys(text, end)
    sa = np.argsort(key)
    new = np.r_[True, key[sa[1:]] != key[sa[:-1]]]
    group = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(group, np.diff(np.r_[group, n]))
    size_of = np.repeat(np.diff(np.r_[group, n]), np.diff(np.r_[group, n]))
    active = np.flatnonzero(size_of > 1)  # places of the array in groups of several
    h = _DIGITS
    while len(active):
        pos = sa[active]
        nxt = pos + h
        inside = nxt < end[pos]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + s, of[pos])
        first = rank[pos]
        order = np.argsort(first * (n + s) + second)
        pos, first, second = pos[order], first[order], second[order]
        sa[active] = pos
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        heads = np.flatnonzero(new)
        lens = np.diff(np.r_[heads, len(pos)])
        rank[pos] = np.repeat(active[heads], lens)
        active = active[np.repeat(lens, lens) > 1]
        h *= 2
    return sa, _common(text, key, sa, end, cuts)


def _common(text, key, sa, end, cuts) -> np.ndarray:
    n = len(sa)
    before = np.empty(n, np.int64)  # the predecessor of each suffix
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    at = np.arange(n)
    start = np.zeros(n, bool)
    start[cuts[:-1][cuts[:-1] < n]] = True
    p = np.maximum(before, 0)
    fresh = (before < 0) | start | start[p] | (text[at - 1] != text[p - 1])
    irreducible = np.flatnonzero(fresh)
    value = np.zeros(n, np.int64)
    i, j = irreducible, before[irreducible]
    i, j = i[j >= 0], j[j >= 0]
    room = np.minimum(end[i] - i, end[j] - j)
    got = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + got[live], j[live] + got[live]
        short = got[live] >= room[live]
        x = key[np.minimum(a, n - 1)] ^ key[np.minimum(b, n - 1)]
        same = sum((x >> (9 * d) == 0).astype(np.int64) for d in range(_DIGITS))  # equal leading symbols
        same[short] = 0
        got[live] = np.minimum(got[live] + same, room[live])
        live = live[(same == _DIGITS) & (got[live] < room[live])]
    value[i] = got
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    plcp = np.maximum(value[last] - (at - last), 0)
    lcp = plcp[sa]
    lcp[0] = 0
    return lcp
