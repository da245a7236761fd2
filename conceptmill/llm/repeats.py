"""Tandem repeats and runs of many word sequences at once, by the linear method of Gusfield and Stoye, in numpy.

The suffix tree of the sequences is held as a sorted suffix array with the ranks of all stretches of 1, 2, 4, ... words: a node is
an interval of suffixes, a child is found by search in it, and two ranks tell whether two stretches are equal, or how far. Then
  1. Lempel-Ziv blocks, from each suffix's longest earlier occurrence;
  2. squares that end in a block or reach into the next one, from extensions to both sides of the block's borders: they cover the
     leftmost occurrence of every kind of square;
  3. suffix-link walks: from a square at i the next of its kind starts at i + 1 if the word at i follows there, here (a whole stretch
     of these is one step) or at another suffix below the link's node;
  4. the suffixes below the node of each square are its occurrences; neighbouring ones of one period merge into a run.
Only squares of primitive roots are followed, so that the occurrences stay within n log n.
"""

from __future__ import annotations

import numpy as np


class SuffixRanks:
    """Suffixes of sequences: codes (their words, one after the other) and lens. Sequences share no stretch."""

    def __init__(self, codes: np.ndarray, lens: np.ndarray):
        n = len(codes)
        doc = np.repeat(np.arange(len(lens)), lens)
        self.end = np.repeat(np.cumsum(lens), lens)
        self.codes, self.n = codes, n
        self.levels: list[np.ndarray] = []
        order = np.argsort(doc * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
        key = (doc * (int(codes.max(initial=0)) + 1) + codes)[order]
        rank = np.empty(n, np.int32)
        head = np.ones(n, bool)
        head[1:] = key[1:] != key[:-1]
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.levels.append(rank)
        # refine what isn't alone yet: stretches of twice the length, by the ranks of their halves
        width = 1
        alone = head & np.append(head[1:], True)
        at = order[~alone]
        while len(at):
            old = self.levels[-1]
            after = at + width
            second = np.where(after < self.end[at], old[np.minimum(after, n - 1)], -1)
            pair = old[at].astype(np.int64) * (n + 1) + second + 1
            place = np.argsort(pair, kind="stable")
            at, pair = at[place], pair[place]
            group = old[at]
            first = np.ones(len(at), bool)
            first[1:] = group[1:] != group[:-1]
            head = np.ones(len(at), bool)
            head[1:] = pair[1:] != pair[:-1]
            starts = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            rank = old.copy()
            rank[at] = group + starts[lead]
            self.levels.append(rank)
            width *= 2
            alone = head & np.append(head[1:], True)
            at = at[~alone]
        self.sa = np.empty(n, np.int64)
        self.sa[self.levels[-1]] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i and j are different places."""
        found = np.zeros(len(i), np.int64)
        live = np.flatnonzero((i < self.n) & (j < self.n))
        live = live[self.levels[0][i[live]] == self.levels[0][j[live]]]
        a, b = i[live], j[live]
        # upwards to the longest stretch of 2^k equal words, then down; a stretch that its sequence's end cuts off has a rank of
        # its own, so that no step leaves a sequence
        top, at = np.zeros(len(live), np.int64), np.arange(len(live))
        for level in range(1, len(self.levels)):
            at = at[self.levels[level][a[at]] == self.levels[level][b[at]]]
            if not len(at):
                break
            top[at] = level
        out = np.left_shift(1, top)
        for level in range(int(top.max(initial=0)) - 1, -1, -1):
            at = np.flatnonzero(top > level)
            x, y = a[at] + out[at], b[at] + out[at]
            inside = (x < self.n) & (y < self.n)
            at, x, y = at[inside], x[inside], y[inside]
            out[at[self.levels[level][x] == self.levels[level][y]]] += 1 << level
        found[live] = out
        return found

    def behind(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words up to i equal those up to j, of at most most words; most stays within both sequences."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, width = self.levels[level], 1 << level
            go = np.flatnonzero(out + width <= most)
            a, b = i[go] - out[go] - width + 1, j[go] - out[go] - width + 1
            out[go[rank[a] == rank[b]]] += width
        return out

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the length words from i on and from j on are equal; both lie within their sequences."""
        out = np.zeros(len(i), bool)
        level = np.frexp(length.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            if k >= len(self.levels):
                out[at] = i[at] == j[at]
                continue
            rank, last = self.levels[k], length[at] - (1 << k)
            out[at] = (rank[i[at]] == rank[j[at]]) & (rank[i[at] + last] == rank[j[at] + last])
        return out

    def node(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval, in the suffix array, of the suffixes that begin with the length words from i on."""
        place = self.levels[-1][i].astype(np.int64)
        edges = []
        for sign in (-1, 1):
            edge, step = place.copy(), 1
            live = np.arange(len(i))
            steps = []
            while len(live):  # gallop away from the place, then halve the steps
                there = edge[live] + sign * step
                ok = self._begins(there, i[live], length[live])
                live = live[ok]
                edge[live] = there[ok]
                steps.append(step)
                step *= 2
            for step in reversed(steps):
                there = edge + sign * step
                ok = self._begins(there, i, length)
                edge[ok] = there[ok]
            edges.append(edge)
        return edges[0], edges[1] + 1

    def _begins(self, place: np.ndarray, i: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), bool)
        at = np.flatnonzero((place >= 0) & (place < self.n))
        j = self.sa[place[at]]
        fits = j + length[at] <= self.end[j]
        at, j = at[fits], j[fits]
        out[at] = self.same(i[at], j, length[at])
        return out

    def child(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A suffix of each interval [lo, hi) of suffixes with depth common words that goes on with word; -1 if there is none. word: the
        code's rank, as in the lowest level."""
        end = hi
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            at = np.flatnonzero(open_)
            mid = (lo[at] + hi[at]) // 2
            less = self._word(mid, depth[at]) < word[at]
            lo[at[less]] = mid[less] + 1
            hi[at[~less]] = mid[~less]
        inside = lo < end
        hit = np.zeros(len(lo), bool)
        hit[inside] = self._word(lo[inside], depth[inside]) == word[inside]
        return np.where(hit, self.sa[np.minimum(lo, self.n - 1)], -1)

    def _word(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        i = self.sa[place]
        return np.where(i + depth < self.end[i], self.levels[0][np.minimum(i + depth, self.n - 1)], -1)


def _nearest_smaller(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The place of the nearest smaller value to the left, but not left of first; some place left of that for none. By jumps, which
    double."""
    near = np.arange(len(values)) - 1
    live = np.arange(len(values))
    while True:
        live = live[near[live] >= first[live]]
        live = live[values[near[live]] > values[live]]
        if not len(live):
            return near
        near[live] = near[near[live]]


def lz_blocks(s: SuffixRanks, lens: np.ndarray) -> np.ndarray:
    """The places where Lempel-Ziv blocks begin: each is the longest stretch that also begins earlier, or one new word."""
    # a sequence's suffixes are as far on in the suffix array as in the text
    first = np.repeat(np.cumsum(lens) - lens, lens)
    left = _nearest_smaller(s.sa, first)
    right = s.n - 1 - _nearest_smaller(s.sa[::-1].copy(), s.n - s.end[::-1])[::-1]
    longest = np.zeros(s.n, np.int64)
    for other in (left, right):
        at = np.flatnonzero((other >= first) & (other < s.end))
        i = s.sa[at]
        longest[i] = np.maximum(longest[i], s.ahead(i, s.sa[other[at]]))
    step = np.maximum(longest, 1).tolist()
    blocks = []
    at, n = 0, s.n
    while at < n:  # a block doesn't leave its sequence
        blocks.append(at)
        at += step[at]
    return np.array(blocks, np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count, and 0, 1, 2, ... for each."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering_squares(s: SuffixRanks, blocks: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares that cover the leftmost of every kind: those with the centre in a block and the end in it, and
    those that start before or in it and end in the next."""
    word, first = s.levels[0], np.repeat(np.cumsum(lens) - lens, lens)
    after = np.append(blocks[1:], s.n)
    after2 = np.append(after[1:], s.n)
    after2[after2 > s.end[blocks]] = s.end[blocks][after2 > s.end[blocks]]
    starts, periods = [], []

    def add(h: np.ndarray, q: np.ndarray, k: np.ndarray, block: np.ndarray, second: bool) -> None:
        """Squares of period k across the border h, q = h +- k, whose words are equal."""
        a, b = np.minimum(h, q), np.maximum(h, q)
        behind = s.behind(a - 1, b - 1, np.minimum(a - first[a], k))
        start = np.maximum(a - behind, a - k + 1)
        some = s.ahead(a, b) + behind >= k
        if second:
            some &= (behind > 0) & (start + k <= after[block])
        starts.append(start[some])
        periods.append(k[some])

    for second, most in ((False, after - blocks), (True, after2 - blocks)):
        upto, lo = np.cumsum(most), 0
        while lo < len(blocks):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + (1 << 19))))
            index, k = _spread(most[lo:hi])
            index, k = index + lo, k + 1
            h = blocks[index] if second else after[index]
            q = h + k if second else h - k
            ok = np.flatnonzero((q >= 0) & (q < s.n) & (h < s.n))
            ok = ok[word[h[ok]] == word[q[ok]]]
            add(h[ok], q[ok], k[ok], index[ok], second)
            lo = hi
    return np.concatenate(starts), np.concatenate(periods)


def _primitive(s: SuffixRanks, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a square's root isn't itself a power: no share of the period by a prime is a period."""
    out = np.ones(len(start), bool)
    most = int(period.max(initial=1))
    least = np.arange(most + 1)  # the least prime that divides each number
    for p in range(2, int(most**0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, most + 1, p)] = p
    rest = period.copy()
    while len(at := np.flatnonzero((rest > 1) & out)):
        prime = least[rest[at]]
        d = period[at] // prime
        out[at] = ~s.same(start[at], start[at] + d, 2 * period[at] - d)
        rest[at] //= prime
    return out


def square_kinds(s: SuffixRanks, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares that have every kind (content) at least once, by suffix-link walks from covering ones."""
    seen: set[tuple[int, int, int]] = set()
    starts, periods = [], []
    while len(start):
        # squares that follow each other at one place are one step
        stretch = s.ahead(start, start + period) - period
        stretch = np.minimum(stretch, period - 1)  # after period steps the walk is where it began
        fresh = []
        for x, (i, q, k) in enumerate(zip(start.tolist(), period.tolist(), _names(s, start, 2 * period), strict=True)):
            if (q, *k) not in seen:
                seen.add((q, *k))
                fresh.append(x)
        start, period, stretch = start[fresh], period[fresh], stretch[fresh]
        index, add = _spread(stretch + 1)
        starts.append(start[index] + add)
        periods.append(period[index])
        # the link: without the first word, and then that word again, at some other suffix
        going = stretch < period - 1
        last, period = (start + stretch)[going], period[going]
        if not len(last):
            break
        depth = 2 * period - 1
        lo, hi = s.node(last + 1, depth)
        other = s.child(lo, hi, depth, s.levels[0][last].astype(np.int64))
        start, period = other[other >= 0], period[other >= 0]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def _names(s: SuffixRanks, i: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """What a stretch of a given length is known by: the ranks of its two overlapping halves."""
    level = np.minimum(np.frexp(length.astype(np.float64))[1] - 1, len(s.levels) - 1)
    a, b = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        a[at] = s.levels[k][i[at]]
        b[at] = s.levels[k][i[at] + length[at] - (1 << k)]
    return list(zip(a.tolist(), b.tolist(), strict=True))


def runs(codes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs of two periods at least of sequences of words (codes one after the other, and
    the length of each), in order of start, then period. Starts count over all sequences; no run leaves its own."""
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none
    # in no order, as words in order of their first place make long chains of ever larger suffixes
    order = np.random.default_rng(1).permutation(int(codes.max()) + 1)
    s = SuffixRanks(order[codes], lens)
    start, period = covering_squares(s, lz_blocks(s, lens), lens)
    held = _primitive(s, start, period) if len(start) else np.zeros(0, bool)
    start, period = square_kinds(s, start[held], period[held])
    if not len(start):
        return none, none, none
    # each kind once: its node, which is its name
    lo, hi = s.node(start, 2 * period)
    kinds = np.unique(np.stack([period, lo, hi], axis=1), axis=0)
    index, add = _spread(kinds[:, 2] - kinds[:, 1])
    period, place = kinds[index, 0], s.sa[kinds[index, 1] + add]
    order = np.lexsort((place, period))
    period, place = period[order], place[order]
    head = np.ones(len(place), bool)
    head[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(place)) - 1
    start, period, length = place[first], period[first], place[last] - place[first] + 2 * period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]
