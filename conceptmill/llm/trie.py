"""Self-join of binary keys within a Hamming distance, by walking pairs of trie nodes together.

A pair of nodes of the same depth stands for all pairs of keys below them. It carries the bits in which the two
prefixes differ and is dropped as soon as they exceed the budget; small pairs are compared key by key. The upper
levels are columns: each key is dealt to the subtries whose prefixes differ from its own in budget bits at most (a
subtrie with too many keys is cut by further bits), and each pair of subtries is a group of a task. Tasks emit, of
the links that they find, a spanning forest only.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, staged

#: Most bits of a subtrie's prefix, further bits of one that holds too many keys, and the keys that it should hold at most.
PREFIX_BITS, MORE_BITS, SUBTRIE_KEYS = 16, 8, 1 << 18
_CHUNK, _SMALL = 1 << 17, 16


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            ra, rb = label[a], label[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while ((up := label[label]) != label).any():
                label[:] = up


class _Trie:
    def __init__(self, keys: np.ndarray, bits: int, depth: int):
        """keys: sorted and distinct. Levels are built down to the depth at which every node holds few keys."""
        self.keys, self.starts, self.first = keys, [], []
        n = len(keys)
        for d in range(depth, bits + 1):
            head = np.ones(n, bool)
            if n > 1:
                shift = np.uint64(bits - d)
                head[1:] = (keys[1:] >> shift) != (keys[:-1] >> shift) if d else False
            starts = np.flatnonzero(head).astype(np.int64)
            if self.starts:
                self.first.append(np.searchsorted(starts, self.starts[-1]))
            self.starts.append(starts)
            if np.diff(np.append(starts, n)).max(initial=0) <= 1:
                break
        self.sizes = [np.diff(np.append(s, n)) for s in self.starts]

    def children(self, level: int, node: np.ndarray, bits_left: int) -> tuple[np.ndarray, np.ndarray]:
        """The 0 and the 1 child of each node, -1 where there is none."""
        first = self.first[level][node]
        after = np.append(self.first[level], len(self.starts[level + 1]))[node + 1]
        bit = (self.keys[self.starts[level + 1][first]] >> np.uint64(bits_left - 1)) & np.uint64(1)
        two = after - first == 2
        return np.where(bit == 0, first, -1), np.where(two, first + 1, np.where(bit == 1, first, -1))


def walk(a: np.ndarray, b: np.ndarray | None, bits: int, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs of keys within budget, in pieces. a and b: sorted distinct uint64 keys of one subtrie each, whose
    prefixes have depth bits; b None: a with itself, each pair once."""
    own = b is None
    ta = _Trie(a, bits, depth)
    tb = ta if own else _Trie(b, bits, depth)
    if not len(a) or not len(tb.keys):
        return
    used = 0 if own else int(np.bitwise_count((a[0] ^ tb.keys[0]) >> np.uint64(bits - depth))) if depth else 0
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, zero + used)]
    while stack:
        level, i, j, cost = stack.pop()
        sa, sb = ta.sizes[level][i], tb.sizes[level][j]
        last = level + 1 >= min(len(ta.starts), len(tb.starts))
        small = np.ones(len(i), bool) if last else sa * sb <= _SMALL
        if small.any():
            yield from _compare(ta, tb, level, i[small], j[small], sa[small], sb[small], budget, own)
        if last or small.all():
            continue
        i, j, cost = i[~small], j[~small], cost[~small]
        left = bits - depth - level
        a0, a1 = ta.children(level, i, left)
        b0, b1 = tb.children(level, j, left)
        found = []
        for x, y, more in ((a0, b0, 0), (a1, b1, 0), (a0, b1, 1), (a1, b0, 1)):
            ok = (x >= 0) & (y >= 0) & (cost + more <= budget)
            if own:
                ok &= x <= y
            found.append((x[ok], y[ok], cost[ok] + more))
        i, j, cost = (np.concatenate(x) for x in zip(*found, strict=True))
        for lo in range(0, len(i), _CHUNK):
            stack.append((level + 1, i[lo : lo + _CHUNK], j[lo : lo + _CHUNK], cost[lo : lo + _CHUNK]))


def _compare(ta: _Trie, tb: _Trie, level: int, i: np.ndarray, j: np.ndarray, sa: np.ndarray, sb: np.ndarray, budget: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = sa * sb
    cut = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(n)]) // (4 * _CHUNK), prepend=0))
    for part in np.split(np.arange(len(n)), cut):
        if not len(part):
            continue
        m = n[part]
        at = np.repeat(np.arange(len(part)), m)
        k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        wide = sb[part][at]
        x, y = ta.starts[level][i[part]][at] + k // wide, tb.starts[level][j[part]][at] + k % wide
        ok = np.bitwise_count(ta.keys[x] ^ tb.keys[y]) <= budget
        if own:
            ok &= x < y
        yield x[ok], y[ok]


# --- spread over tasks -----------------------------------------------------------------------------------------


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << x for x in c) for n in range(min(bits, budget) + 1) for c in itertools.combinations(range(bits), n)]


def _depth(keys: int, bits: int, target: int) -> int:
    """The bits of a prefix by which so many keys are cut into subtries of target keys."""
    return min(PREFIX_BITS, bits, max(0, (-(-keys // target) - 1).bit_length()))


def turned(keys: DataFrame, bits: int, turns: int) -> DataFrame:
    """keys, turns times over: the bits are cut into as many stretches, and each time another one is turned to the front; the bands are
    numbered anew, by the turn. Keys that differ in fewer bits than there are stretches agree in one of them."""
    step, low = bits // turns, F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("long")

    def key(s: int):
        return F.shiftleft("key", s).bitwiseAND(low).bitwiseOR(F.shiftrightunsigned("key", bits - s)) if s else F.col("key")

    each = F.explode(F.array(*[F.struct((F.col("band") * turns + k).alias("band"), key(k * step).alias("key")) for k in range(turns)]))
    rest = [c for c in keys.columns if c not in ("band", "key")]
    return keys.select(each.alias("turned"), *rest).select("turned.band", "turned.key", *rest)


def met(keys: DataFrame, bits: int, budget: int, target: int, exact: int = 0) -> DataFrame:
    """keys with a row for each subtrie that a key meets: lo and hi (the pair of subtries: its own and the other), depth (the bits
    that both prefixes have) and side (0: its own is lo). Subtries have equal prefix lengths, so that they hold target keys on
    average; one that holds four times as many is cut by up to MORE_BITS further bits. Subtries that differ in one of the first exact
    bits don't meet."""
    most = keys.groupBy("band").count().agg(F.max("count")).first()[0] or 0
    depth = _depth(most, bits, target)
    more = min(MORE_BITS, bits - depth)
    prefix = lambda n: F.shiftrightunsigned("key", bits - n) if n else F.lit(0).cast("long")
    rows = keys.withColumn("p", prefix(depth))
    hot = rows.groupBy("band", "p").count().filter(F.col("count") > 4 * target).select("band", "p", F.lit(True).alias("cut")) if more else None
    deep = hot is not None and bool((hot := staged(hot, "trie-hot")).head(1))
    other = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(max(0, depth - exact), budget)]))).withColumn("q", F.col("p").bitwiseXOR(F.col("mask")))
    if not deep:
        other = other.withColumn("own", F.col("p")).withColumn("of", F.col("q")).withColumn("depth", F.lit(depth))
    else:
        other = other.join(sized(hot), ["band", "p"], "left").withColumnRenamed("cut", "own_cut").join(sized(hot.withColumnRenamed("p", "q")), ["band", "q"], "left")
        # a cut subtrie's number has a bit of its own, so that it equals no other's
        name = lambda p: p.bitwiseOR(F.lit(1 << 40))
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(more, budget)])
        left = F.filter(masks, lambda m: F.bit_count(m) + F.bit_count("mask") <= budget)
        other = other.withColumn("more", F.explode(F.when(F.col("cut"), left).otherwise(F.array(F.lit(0).cast("long")))))
        far = F.shiftleft("mask", more).bitwiseOR(F.col("more")).bitwiseXOR(prefix(depth + more))
        other = other.withColumn("own", F.when(F.col("own_cut"), name(prefix(depth + more))).otherwise(F.col("p"))).withColumn("of", F.when(F.col("cut"), name(far)).otherwise(F.col("q")))
        other = other.withColumn("depth", F.when(F.col("own_cut") & F.col("cut"), depth + more).otherwise(depth))
    return other.select(*keys.columns, F.least("own", "of").alias("lo"), F.greatest("own", "of").alias("hi"), "depth", (F.col("own") > F.col("of")).cast("int").alias("side"))


def trie_forest(keys: DataFrame, bits: int, budget: int, members: list[str] | None = None, check: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, tasks: int = 8) -> DataFrame:
    """keys: band int, key long (bits low bits), node long, and the columns members; read more than once, so staged or cheap. Returns u, v: nodes linked within a band by
    keys of Hamming distance budget at most and, if given, by check(member rows of u, of v); of each task's links a spanning
    forest, so that components over u, v are those over all links. Rows of one band with equal keys are linked likewise.

    A key meets the more subtries the longer their prefixes. If they were more than budget + 1, keys are turned instead as often, and
    meet subtries of their own stretch alone: so the rows of a key don't grow with the keys, as long as a stretch cuts them finely enough."""
    members = members or []
    bands, total = keys.agg(F.countDistinct("band"), F.count("*")).first()
    each = -(-total // max(1, bands))
    target = min(SUBTRIE_KEYS, max(1 << 12, -(-each // tasks)))
    depth, exact, turns = _depth(each, bits, target), 0, 1
    if bits > budget and len(_masks(depth, budget)) > budget + 1:
        turns, exact = budget + 1, bits // (budget + 1)
        keys = turned(keys, bits, turns)
    dealt = met(keys, bits, budget, target, exact)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        key, side = frame["key"].to_numpy().view(np.uint64), frame["side"].to_numpy()
        rows = [frame[m].to_numpy() for m in members]
        full = np.stack(rows, axis=1).view(np.uint64) if rows else None
        order = np.lexsort((key, side))
        key, side = key[order], side[order]
        half = int(np.searchsorted(side, 1))
        two = bool(frame["lo"].iloc[0] != frame["hi"].iloc[0])
        if two and half in (0, len(key)):  # one of the subtries is empty
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        sets = Forest(len(key))
        blocks = []
        for lo, hi in ((0, half), (half, len(key))):
            uniq, starts = np.unique(key[lo:hi], return_index=True)
            blocks.append((uniq, np.append(starts, hi - lo) + lo))
        (ka, ba), (kb, bb) = blocks

        def verify(x: np.ndarray, y: np.ndarray) -> None:
            apart = sets.label[x] != sets.label[y]
            x, y = x[apart], y[apart]
            if check is not None:
                ok = check(full[order[x]], full[order[y]])
                x, y = x[ok], y[ok]
            sets.link(x, y)

        def blocks_meet(x: np.ndarray, y: np.ndarray) -> None:
            """All of block x against all of block y: single ones at once, others row by row, skipping what is linked already."""
            one = (ba[x + 1] - ba[x] == 1) & (bb_[y + 1] - bb_[y] == 1)
            verify(ba[x[one]], bb_[y[one]])
            for i, j in zip(x[~one].tolist(), y[~one].tolist(), strict=True):
                left, right = np.arange(ba[i], ba[i + 1]), np.arange(bb_[j], bb_[j + 1])
                for r in left.tolist():
                    verify(np.full(len(right), r), right)

        bb_ = bb if two else ba
        if not two and frame["band"].iloc[0] % turns == 0:  # equal keys are together in each turn
            for i in np.flatnonzero(np.diff(ba) > 1).tolist():
                block = np.arange(ba[i], ba[i + 1])
                if check is None:
                    sets.link(block[1:], np.full(len(block) - 1, block[0]))
                    continue
                for r in range(len(block) - 1):
                    verify(np.full(len(block) - 1 - r, block[r]), block[r + 1 :])
        for x, y in walk(ka, kb if two else None, bits, int(frame["depth"].iloc[0]), budget):
            if check is None:
                sets.link(ba[x], bb_[y])
            else:
                blocks_meet(x, y)
        node = frame["node"].to_numpy()[order]
        held = np.flatnonzero(sets.label != np.arange(len(node)))
        return pd.DataFrame({"u": node[held], "v": node[sets.label[held]]})

    # few bytes, much work: a number of partitions of our own, which isn't coalesced; about two groups in each
    groups = turns * len(_masks(max(0, depth - exact), budget)) * -(-total // target)
    return dealt.repartition(max(1, min(groups, 200_000)), "band", "lo", "hi").groupBy("band", "lo", "hi").applyInPandas(join, "u long, v long")
