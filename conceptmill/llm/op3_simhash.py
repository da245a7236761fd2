"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

Two uses. simhash_components links fingerprints of 64 bits at a small Hamming distance, nothing else. near_duplicates
takes five-word shingles and a similarity: it finds loose groups by the trie self-join of sixteen 32-bit fingerprints of
two-word shingles, checked by fingerprints of 256 bits of the five-word shingles with a wide margin, and compares the
members of each group by the exact Jaccard similarity of their sets of five-word shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, slices, staged, table, text_or_empty
from .components import components
from .trie import Forest, trie_forest

#: Shingles handled at a time, so that the longest text needs bounded memory.
_BLOCK = 1 << 16
#: Bytes of texts whose shingle sets are held at a time; a longer text is held alone.
_TEXT_BYTES = 1 << 21
#: Spreads a byte's bits over the bytes of a word.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


# --- fingerprints ----------------------------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle, repeats included, in blocks; fewer words than width: of the whole sequence."""
    if not words:
        return
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        yield np.array([h(joined, 42)], np.uint64)
        return
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    ends = (starts + lens)[width - 1 :]
    starts = starts[: len(ends)]
    for lo in range(0, len(ends), _BLOCK):
        yield np.array([h(joined[a:b], 42) for a, b in zip(starts[lo : lo + _BLOCK].tolist(), ends[lo : lo + _BLOCK].tolist(), strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """How many of the hashes of each run (of lens hashes) have each bit, least significant first: a row of 64 for each run."""
    out = np.zeros((len(lens), 64), np.int64)
    # a byte holds up to 255 ones: longer runs are summed in parts
    parts = -(-lens // 255)
    run = np.repeat(np.arange(len(lens)), parts)
    starts = np.repeat(np.cumsum(lens) - lens, parts) + 255 * (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts))
    view = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    lo = 0
    while lo < len(run):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _BLOCK)))
        end = int(starts[hi]) if hi < len(run) else len(hashes)
        sums = np.add.reduceat(_SPREAD[view[starts[lo] : end]], starts[lo:hi] - starts[lo], axis=0)
        heads = np.flatnonzero(np.diff(run[lo:hi], prepend=-1))
        out[run[lo:hi][heads]] += np.add.reduceat(sums.view(np.uint8).reshape(len(sums), 64).astype(np.int64), heads, axis=0)
        lo = hi
    return out


def _remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of the same shingle; the 0th is the hash itself."""
    if k:
        hashes = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(32)
    return hashes


def fingerprints_of(hashes: np.ndarray, lens: np.ndarray, n: int = 1) -> np.ndarray:
    """n fingerprints of 64 bits of each run of hashes: a bit is set if over half of them have it. An empty run: zero."""
    made = [np.packbits(2 * bit_counts(_remix(hashes, k), lens) > lens[:, None], axis=1, bitorder="little").view("<u8") for k in range(n)]
    return np.concatenate(made, axis=1)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, key: the fingerprint (as signed long) of the whole text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                rows = [list(shingle_hashes(words_of(t), width)) for t in piece.column(1).to_pylist()]
                lens = np.array([sum(map(len, r)) for r in rows], np.int64)
                flat = np.concatenate([np.zeros(0, np.uint64), *(x for r in rows for x in r)])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprints_of(flat, lens)[:, 0].view(np.int64))], names=["id", "key"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(make, "id long, key long")


# --- groups ----------------------------------------------------------------------------------------------------


def simhash_components(docs: DataFrame, width: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, fingerprint (16 hex digits), component_id: the least id over all fingerprints reachable by
    steps of budget bits at most. Null and empty texts have fingerprint zero, linked like any other; repeated rows stay;
    null ids stay and don't count as least (a component of null ids alone has a null component_id); extra columns are left
    out; an empty table gives no row. Equal fingerprints are one node, so a group of copies of any size costs one row in the join."""
    made = staged(fingerprints(docs, width, id_col, text_col), "op3-fingerprints")
    distinct = staged(made.groupBy("key").agg(F.min("id").alias("least")), "op3-distinct")
    links = staged(trie_forest(distinct.select(F.lit(0).alias("band"), "key", F.col("key").alias("node")), 64, budget), "op3-links")
    groups = components(links).withColumnRenamed("node", "key")
    least = groups.join(distinct, "key").groupBy("component").agg(F.min("least").alias("group_least"))
    linked = staged(groups.join(least, "component").select("key", "group_least"), "op3-groups")
    found = distinct.join(linked, "key", "left").select("key", F.coalesce("group_least", "least").alias("component_id"))
    return made.join(found, "key").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of the long fingerprint (256 bits), and the bands of the candidate search: each 32 bits, with up to three of them apart.
FULL, BANDS, BAND_BITS, BAND_BUDGET = 4, 16, 32, 3
#: Representatives that one task compares with each other, and those that a task of small groups holds in about.
_GROUP, _TASK = 512, 2000


def similarity_bits(similarity: float, bits: int) -> int:
    """The Hamming distance that fingerprints of bits bits have at most, but for four standard deviations, at a Jaccard similarity
    of two sets of equal size."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * apart + 4 * math.sqrt(bits * apart * (1 - apart)))


def shingle_sets(texts: pa.Array, widths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width, the distinct hashes of each text's shingles, ascending, flat, and how many each text has; fewer words than
    width: of the whole sequence. A shingle's hash is a polynomial of its words' hashes, mixed; each distinct word is hashed once."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    held = real[codes] if len(codes) else np.zeros(0, bool)
    n = np.diff(np.append(0, np.cumsum(held))[offsets - offsets[0]])
    words = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    words = words[codes[held]] if len(codes) else np.zeros(0, np.uint64)
    starts = np.cumsum(n) - n
    out = []
    for width in widths:
        sums, first = words.copy(), np.zeros(len(n), np.uint64)
        for j in range(1, width + 1):
            here = (n >= j) if j == width else n == j
            first[here] = sums[starts[here]]
            if j < width:
                sums *= np.uint64(0x9E3779B97F4A7C15)
                sums[: max(0, len(words) - j)] += words[j:]
        m = np.where(n >= width, n - width + 1, n > 0)
        ends = np.cumsum(m)
        flat = sums[np.repeat(starts - (ends - m), m) + np.arange(int(m.sum()))]
        flat[(ends - m)[(n > 0) & (n < width)]] = first[(n > 0) & (n < width)]
        flat = _remix(flat, width)
        for lo, hi in zip((ends - m).tolist(), ends.tolist(), strict=True):
            flat[lo:hi].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[(ends - m)[m > 0]] = True
        out.append((flat[new], np.diff(np.append(0, np.cumsum(new))[np.append(0, ends)])))
    return out


def _as_bytes(flat: np.ndarray, lens: np.ndarray) -> list[bytes]:
    data, ends = flat.tobytes(), np.cumsum(8 * lens).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _set_prints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, h (a hash of the text), node (a hash of its set of width-word shingles), full (FULL fingerprints of that set) and short
    (those of the set of two-word shingles, two bands each)."""
    short = BANDS * BAND_BITS // 64

    def column(flat: np.ndarray, lens: np.ndarray, n: int) -> pa.Array:
        made = fingerprints_of(flat, lens, n)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(lens) + 1, n), pa.int32()), pa.array(made.reshape(-1).view(np.int64)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2, n_bytes=_TEXT_BYTES):
                whole, pairs = shingle_sets(piece.column(2), (width, 2))
                node = np.array([xxhash.xxh64_intdigest(x, 42) for x in _as_bytes(*whole)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(node), column(*whole, FULL), column(*pairs, short)], names=["id", "h", "node", "full", "short"])
        pa.default_memory_pool().release_unused()

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    return rows.mapInArrow(make, "id long, h long, node long, full array<long>, short array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """component, node, shingles (the hashes of the whole set, as bytes) of rows component, node, t; texts without a word are left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                made = pa.array(_as_bytes(*shingle_sets(piece.column(2), (width,))[0]), pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), made], names=["component", "node", "shingles"])

    return texts.select("component", "node", "t").mapInArrow(make, "component long, node long, shingles binary").filter(F.length("shingles") > 0)


def similar_links(sets: list[np.ndarray], ask: np.ndarray, similarity: float) -> np.ndarray:
    """The least row that each row reaches by pairs, one of them in ask, whose sets' Jaccard similarity is similarity at least."""
    forest, sizes = Forest(len(sets)), np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(int(ids.max()) + 1, np.int32)
    for r in ask.tolist():
        if not forest.label.any():  # all are one group
            break
        own = ids[starts[r] : starts[r] + sizes[r]]
        held[own] = 1
        both = np.add.reduceat(held[ids], starts)
        held[own] = 0
        near = np.flatnonzero(both >= similarity * (sizes[r] + sizes - both) - 1e-9)
        forest.link(np.full(len(near), r), near)
    return forest.label


def _compared(rows: DataFrame, similarity: float, unit: list[str]) -> DataFrame:
    """u, v: a forest of the links within each unit and component of rows (with component, node, side, shingles) that have a row of side 0."""

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), np.int64)]
        for _, group in frame.groupby("component", sort=False):
            node = group["node"].to_numpy()
            label = similar_links([np.frombuffer(x, np.uint64) for x in group["shingles"]], np.flatnonzero(group["side"].to_numpy() == 0), similarity)
            held = np.flatnonzero(label != np.arange(len(node)))
            found.append(np.stack([node[held], node[label[held]]], axis=1))
        made = np.concatenate(found)
        return pd.DataFrame({"u": made[:, 0], "v": made[:, 1]})

    return rows.groupBy(*unit).applyInPandas(link, "u long, v long").filter("u <> v")


def _near_pivots(sets: DataFrame, similarity: float) -> DataFrame:
    """component, node, pivot: for large components, the rows similar to one of a few of the component's own rows."""
    pivots = sets.groupBy("component", F.pmod(F.xxhash64("node"), F.lit(8)).alias("k")).agg(F.min("node").alias("node"))
    pivots = sets.join(pivots.select("component", "node"), ["component", "node"])
    pivots = staged(pivots.groupBy("component").agg(F.collect_list(F.struct("node", "shingles")).alias("pivots")), "op3-pivots")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = np.frombuffer(row["shingles"], np.uint64)
                for p in row["pivots"]:
                    other = np.frombuffer(p["shingles"], np.uint64)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both >= similarity * (len(own) + len(other) - both) - 1e-9:
                        out.append((row["component"], row["node"], p["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["component", "node", "pivot"])

    return sets.join(sized(pivots, 1000), "component").select("component", "node", "shingles", "pivots").mapInArrow(near, "component long, node long, pivot long")


def exact_links(sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: links whose components are those of all pairs of sets (component, node, shingles; staged) of one component with the
    given Jaccard similarity. Small components are compared within a task. Of a large one, the rows similar to its best pivot are
    linked to it by one pass, and only the rest is compared with all, a block of each in a task."""
    sizes = staged(sets.groupBy("component").agg(F.count("*").alias("n")), "op3-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    sized_ = sets.join(sized(sizes), "component")
    small = sized_.filter(F.col("n").between(2, _GROUP)).withColumn("side", F.lit(0)).withColumn("unit", F.pmod(F.xxhash64("component"), F.lit(total // _TASK + 1)))
    # few bytes, much work: a number of partitions of our own, which isn't coalesced
    links = _compared(small.repartition(total // _TASK + 1, "unit"), similarity, ["unit"])
    if not sizes.filter(F.col("n") > _GROUP).head(1):
        return links
    large = staged(sized_.filter(F.col("n") > _GROUP), "op3-large")
    near = staged(_near_pivots(large.select("component", "node", "shingles"), similarity), "op3-near")
    best = near.groupBy("component", "pivot").count().groupBy("component").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    done = near.join(best, ["component", "pivot"]).select("node")
    rest = staged(large.join(done, "node", "left_anti"), "op3-rest")
    parts = rest.groupBy("component").agg(F.ceil(F.count("*") / _GROUP).alias("rests"))
    block = lambda k: F.pmod(F.xxhash64(F.lit(k), "node"), F.ceil(F.col("n") / _GROUP) if k else F.col("rests"))
    both = rest.join(parts, "component").withColumn("i", block(0)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / _GROUP) - 1))).withColumn("side", F.lit(0))
    both = both.unionByName(large.join(parts, "component").withColumn("j", block(1)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1))).withColumn("side", F.lit(1)))
    across = _compared(both, similarity, ["component", "i", "j"])
    return links.union(near.filter("node <> pivot").select("node", "pivot")).union(across)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, h (XXH64 of the text), node (of its set of shingles), least_id, least_h: the row of its group that
    is least by id (null first), then h. A group is what pairs of the given similarity reach: the exact Jaccard similarity of their
    sets of distinct width-word shingles. Pairs are sought among representatives of equal sets that the fingerprints, compared with
    a wide margin, bring into one loose group. Texts without a word are one group; repeated rows stay; other columns are left out;
    an empty table gives no row."""
    most = similarity_bits(similarity, 64 * FULL)
    words = BANDS * BAND_BITS // 64
    names = [f"f{k}" for k in range(FULL)]
    made = _set_prints(docs, width, id_col, text_col)
    made = staged(made.select("id", "h", "node", *[F.col("full")[k].alias(n) for k, n in enumerate(names)], "short"), "op3-fingerprints")
    firsts = staged(made.groupBy("node").agg(F.min(F.struct("id", "h")).alias("least"), F.first(F.struct(*names, "short")).alias("f")), "op3-distinct")
    half = [F.struct(F.lit(2 * k + s).alias("band"), F.shiftrightunsigned(F.col("f.short")[k], 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")) for k in range(words) for s in (0, 1)]

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(axis=1) <= most

    def joined(bands: list[Column]) -> DataFrame:
        keys = firsts.select("node", "f", F.explode(F.array(*bands)).alias("b")).select("b.band", "b.key", "node", *[F.col(f"f.{n}") for n in names])
        return staged(trie_forest(keys, BAND_BITS, BAND_BUDGET, names, close, tasks=2), "op3-loose")

    # a few bands at a time: the driver holds a histogram of each
    loose = reduce(DataFrame.union, [joined(half[lo : lo + 4]) for lo in range(0, BANDS, 4)])
    wanted = components(loose).join(firsts, "node").select("node", "component", F.col("least.id").alias("__id"), F.col("least.h").alias("__h"))
    wanted = staged(wanted, "op3-wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    texts = texts.join(sized(wanted), F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).dropDuplicates(["node"])
    sets = staged(_sets(texts, width), "op3-sets")
    links = staged(exact_links(sets, similarity), "op3-links")
    groups = components(links)
    least = groups.join(firsts, "node").groupBy("component").agg(F.min("least").alias("group_least"))
    linked = staged(groups.join(least, "component").select("node", "group_least"), "op3-groups")
    found = firsts.join(linked, "node", "left").select("node", F.coalesce("group_least", "least").alias("least"))
    return made.join(found, "node").select("id", "h", "node", F.col("least.id").alias("least_id"), F.col("least.h").alias("least_h"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with one row of each group of near_duplicates: the one of the least id (null first), then the least hash of the text;
    of rows alike in both, one. Columns stay as they are, but docs may have none named __id, __h, __gone_id, __gone_h, __again_id or
    __again_h. Texts without a word, null ones too, are one group; an empty table stays empty."""
    groups = staged(near_duplicates(docs, width, similarity, id_col, text_col), "op3-rows")
    first = F.col("id").eqNullSafe(F.col("least_id")) & (F.col("h") == F.col("least_h"))
    gone = groups.filter(~first).select(F.col("id").alias("__gone_id"), F.col("h").alias("__gone_h")).distinct()
    again = groups.filter(first).groupBy("id", "h").count().filter("count > 1").select(F.col("id").alias("__again_id"), F.col("h").alias("__again_h"))
    keyed = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__h", F.xxhash64(text_or_empty(text_col)))
    keyed = keyed.join(sized(staged(gone, "op3-gone")), F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__h") == F.col("__gone_h")), "left_anti")
    if again.head(1):
        same = F.col("__id").eqNullSafe(F.col("__again_id")) & (F.col("__h") == F.col("__again_h"))
        again = staged(again, "op3-again")
        keyed = keyed.join(sized(again), same, "left_anti").unionByName(keyed.join(sized(again), same, "left_semi").dropDuplicates(["__id", "__h"]))
    return keyed.select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, fingerprint, component_id."""
    return simhash_components(table(spark, sf_dir, "documents"))
