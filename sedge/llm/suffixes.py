"""Suffix sorting by the difference cover of 3, on whole arrays: sample, sort triples, recurse on names, merge."""

from __future__ import annotations

import numpy as np


def triple_keys(t: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A number for each triple of symbols below k, in the triples' order."""
    if k**3 < 1 << 62:
        return (t[at] * k + t[at + 1]) * k + t[at + 2]
    pair = np.unique(t[at] * k + t[at + 1], return_inverse=True)[1]
    return pair * k + t[at + 2]


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The starts of all suffixes of s in their order; symbols are from 1 to k - 1."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # the sample: places 1 and 2 modulo 3; one past the end keeps the two thirds apart
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    key = triple_keys(t, sample, k)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    top = int(fresh.sum())
    if top < len(sample):
        order = suffix_array(names, top + 1)
    sampled = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    m = len(sampled) + 2
    # the rest, by first symbol and the rank of the sampled suffix after it
    rest = np.arange(0, n, 3)
    key = t[rest] * m + rank[rest + 1]
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    sampled = sampled[sampled < n]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[ones] * m + rank[ones + 1], key)
    if k * k * m < 1 << 62:
        pair = t[:-1] * k + t[1:]
    else:
        pair = np.unique(t[:-1] * k + t[1:], return_inverse=True)[1]
    before += np.searchsorted(pair[twos] * m + rank[twos + 2], pair[rest] * m + rank[rest + 2])
    place = np.arange(len(rest)) + before
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[place], free[place] = rest, False
    out[free] = sampled
    return out
