"""Spans of many notes joined to clusters in one pass of arrays: stretches of spans that touch no other are taken side by side."""

from __future__ import annotations

import numpy as np

#: Most spans of a stretch that is taken with others; a longer one is for a loop.
SHORT = 40


def stretches(note: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int | None = None) -> np.ndarray:
    """Where a stretch begins: no span before it, of its note (numbered from 0, in order), ends behind its first span's start. Spans
    are in order of note and start; reach: the end of a stretch of the first note that is still open, or none."""
    if not len(note):
        return np.zeros(0, bool)
    base = note.astype(np.int64) << 40
    upto = base + end
    if reach is not None:
        upto[0] = max(int(upto[0]), reach)
    upto = np.maximum.accumulate(upto)
    out = np.ones(len(note), bool)
    out[1:] = (note[1:] != note[:-1]) | (base[1:] + start[1:] >= upto[:-1])
    out[0] = reach is None or start[0] >= reach
    return out


def joined(start: np.ndarray, end: np.ndarray, score: np.ndarray, heads: np.ndarray, sizes: np.ndarray, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each span, representative of each cluster). heads and sizes: where the stretches begin, which fill the rows, and
    their spans, SHORT at most. The k-th spans of all stretches are looked at together, against the clusters in the order in which they
    were begun; the representative is the member of the best score, then the shortest, then the first."""
    order = np.argsort(-sizes, kind="stable")
    first, size, m = heads[order], sizes[order], len(order)
    most = int(size[0]) if m else 0
    r_start, r_end, r_row = np.zeros((most, m), np.int64), np.full((most, m), -(1 << 60), np.int64), np.zeros((most, m), np.int64)
    r_score = np.zeros((most, m))
    begun, place = np.zeros(m, np.int64), np.zeros(len(start), np.int64)
    for j in range(most):
        row = first[: int(np.searchsorted(-size, -j, "left"))] + j
        left = np.arange(len(row))
        s, e, x = start[row], end[row], score[row]
        for t in range(int(begun[: len(row)].max(initial=0))):
            rs, re = r_start[t, left], r_end[t, left]
            inter = np.minimum(e[left], re) - np.maximum(s[left], rs)
            fits = (inter > 0) & (inter / np.maximum(np.minimum(e[left] - s[left], re - rs), 1) >= overlap)
            hit = left[fits]
            if not len(hit):
                continue
            place[row[hit]] = t
            least, span = r_score[t, hit], r_end[t, hit] - r_start[t, hit]
            better = (x[hit] > least) | ((x[hit] == least) & ((e[hit] - s[hit] < span) | ((e[hit] - s[hit] == span) & (s[hit] < r_start[t, hit]))))
            now = hit[better]
            r_start[t, now], r_end[t, now], r_score[t, now], r_row[t, now] = s[now], e[now], x[now], row[now]
            left = left[~fits]
        t = begun[left]
        place[row[left]] = t
        r_start[t, left], r_end[t, left], r_score[t, left], r_row[t, left] = s[left], e[left], x[left], row[left]
        begun[left] += 1
    upto = np.cumsum(begun) - begun
    own = np.zeros(m, np.int64)
    own[order] = upto
    cluster = np.repeat(own, sizes) + place if m else place
    best = np.zeros(int(begun.sum()), np.int64)
    for t in range(most):
        has = begun > t
        best[upto[has] + t] = r_row[t, has]
    return cluster, best
