"""MinHash near-duplicates by an inverted join of signature coordinates.

Each distinct set of shingles has a signature of minima. It is posted under its pairs of coordinate and value; only the rarest are
needed (prefix): two signatures that agree in MATCHES of COORDINATES coordinates meet under one of the COORDINATES - MATCHES + 1
rarest pairs of each, and a set that shares fewer than MATCHES of its pairs with any other set meets none. Under each pair the
collisions are counted, but not for sets that are joined already (skip). What is retained is compared by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, slices, staged, table, text_or_empty
from .components import components
from .links import group_links, near_pairs
from .op3_simhash import shingle_sets
from .trie import Forest

#: Coordinates of a signature, and the collisions that a pair must have to be compared: at a similarity of 0.85 one pair in
#: about 110,000 has fewer (a binomial of 64 trials, checked in the tests).
COORDINATES, MATCHES = 64, 41
_RNG = np.random.default_rng(20240613)
_FACTORS = _RNG.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 2**63, COORDINATES, np.uint64)


# --- signatures ------------------------------------------------------------------------------------------------


def signatures(flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The least of the upper 32 bits of each of COORDINATES hashes of each run of shingle hashes; runs have a length above 0."""
    out = np.zeros((len(lens), COORDINATES), np.uint32)
    starts = np.cumsum(lens) - lens
    block = 1 << 17
    first = 0
    while first < len(lens):  # few shingles at a time, for the caches' sake
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + block)))
        end = int(starts[last]) if last < len(lens) else len(flat)
        some, at = flat[starts[first] : end], starts[first:last] - starts[first]
        for k in range(COORDINATES):
            out[first:last, k] = np.minimum.reduceat(((some * _FACTORS[k] + _OFFSETS[k]) >> np.uint64(32)).astype(np.uint32), at)
        first = last
    return out


def _signed(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, h (a hash of the text), n (distinct shingles), node (a hash of their set; null for none) and tokens: coordinate and value
    as one number, ascending by coordinate."""
    names = ["id", "h", "n", "node", "tokens"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                flat, lens = shingle_sets(piece.column(2), (width,))[0]
                ends, data = np.cumsum(8 * lens).tolist(), flat.tobytes()
                node = np.array([xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip([0, *ends], ends, strict=False)], np.uint64).view(np.int64)
                held = lens > 0
                tokens = signatures(flat, lens[held]).astype(np.int64) + (np.arange(COORDINATES, dtype=np.int64) << 32)
                offsets = np.append(0, np.cumsum(held * COORDINATES)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.reshape(-1)))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(lens.astype(np.int64)), pa.array(node, mask=~held), lists], names=names)
        pa.default_memory_pool().release_unused()

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    return rows.mapInArrow(make, "id long, h long, n long, node long, tokens array<long>")


# --- candidates ------------------------------------------------------------------------------------------------


def _bytes_of(data: pa.Array) -> np.ndarray:
    """The rows of an array of binaries of COORDINATES bytes, as a matrix."""
    at = np.frombuffer(data.buffers()[1], np.int32)[data.offset] if len(data) else 0
    return np.frombuffer(data.buffers()[2], np.uint8)[at : at + COORDINATES * len(data)].reshape(len(data), COORDINATES)


def _collide(a: pa.Array, i: np.ndarray, b: pa.Array, j: np.ndarray) -> np.ndarray:
    return (_bytes_of(a)[i] == _bytes_of(b)[j]).sum(axis=1) >= MATCHES


def candidate_links(firsts: DataFrame) -> DataFrame:
    """u, v: a forest whose trees hold all pairs of nodes with MATCHES equal coordinates. firsts (staged): node, tokens.

    A posting carries the lowest byte of each coordinate: equal coordinates have equal ones, others one in 256 times, so that none
    is missed."""
    posted = firsts.select("node", F.explode("tokens").alias("token"))
    shared = staged(posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "op13-shared")
    rarest = posted.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    rarest = rarest.filter(F.size("held") >= MATCHES).select("node", F.slice("held", F.lit(1), F.size("held") - (MATCHES - 1)).alias("held"))
    low = F.unhex(F.array_join(F.transform("tokens", lambda t: F.lpad(F.hex(t.bitwiseAND(F.lit(255))), 2, "0")), ""))
    lists = rarest.join(firsts.select("node", low.alias("data")), "node").select("node", F.explode("held.token").alias("group"), "data")
    return group_links(staged(lists, "op13-postings"), _collide, near_pairs(_collide))


# --- confirmation ----------------------------------------------------------------------------------------------


def _set(data: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(data[k].as_buffer(), np.uint64)


def _similar(percent: int):
    """The test of pairs of whole sets (ascending hashes, as bytes)."""

    def near(a: pa.Array, i: np.ndarray, b: pa.Array, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            p, q = _set(a, x), _set(b, y)
            small, large = (p, q) if len(p) <= len(q) else (q, p)
            if 100 * len(small) >= percent * len(large):
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                out[k] = 100 * both >= percent * (len(p) + len(q) - both)
        return out

    return near


def _similar_groups(percent: int):
    """The same for whole groups: the sets of a group are numbered once, and a row meets all rows of another tree at once."""

    def link(data: pa.Array, group: np.ndarray, ask: np.ndarray) -> np.ndarray:
        label = np.arange(len(group))
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(group)).tolist(), strict=True):
            if hi - lo > 1:
                label[lo:hi] = lo + _one_group([_set(data, k) for k in range(lo, hi)], np.flatnonzero(ask[lo:hi]), percent)
        return label

    return link


def _one_group(sets: list[np.ndarray], ask: np.ndarray, percent: int) -> np.ndarray:
    forest, sizes = Forest(len(sets)), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.zeros(int(ids.max()) + 1, np.int32)
    for r in ask.tolist():
        if (forest.label == forest.label[0]).all():
            break
        own = ids[starts[r] : starts[r] + sizes[r]]
        held[own] = 1
        both = np.add.reduceat(held[ids], starts)
        held[own] = 0
        near = np.flatnonzero(100 * both >= percent * (sizes[r] + sizes - both))
        forest.link(np.full(len(near), r), near)
    return forest.label


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """group, node, data: the hashes of the whole set, as bytes, of rows group, node, t."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                flat, lens = shingle_sets(piece.column(2), (width,))[0]
                ends, data = np.cumsum(8 * lens).tolist(), flat.tobytes()
                whole = pa.array([data[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), whole], names=["group", "node", "data"])

    return texts.select("group", "node", "t").mapInArrow(make, "group long, node long, data binary")


def minhash_components(docs: DataFrame, width: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, n_shingles (distinct width-word shingles; of fewer words, the whole sequence), component_id (the
    least id that links reach, its own included), kept.

    A link is a Jaccard similarity of percent hundredths or more of two whole sets, A-Z in lower case; percent from 85 on finds
    all of them but one in about 110,000 just at 85. Equal sets are one node, so copies cost a row each. Null and empty texts have
    no set, link with nothing and are kept; repeated rows stay and share their fate; null ids stay and don't count as least (a
    component of null ids alone has a null component_id, and its rows are kept); extra columns are left out, whatever their names;
    an empty table gives no row."""
    if percent < 85:
        raise ValueError("MATCHES fits similarities of 85 hundredths or more")
    made = staged(_signed(docs, width, id_col, text_col), "op13-signatures")
    firsts = made.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "h")).alias("one"), F.first("tokens").alias("tokens"))
    firsts = staged(firsts, "op13-distinct")
    loose = components(staged(candidate_links(firsts.select("node", "tokens")), "op13-candidates"))
    wanted = loose.join(firsts.select("node", "one"), "node").select("node", F.col("component").alias("group"), F.col("one.id").alias("__id"), F.col("one.h").alias("__h"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    texts = texts.join(sized(staged(wanted, "op13-wanted")), F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).dropDuplicates(["node"])
    links = group_links(staged(_sets(texts, width), "op13-sets"), _similar(percent), _similar_groups(percent), 2000)
    groups = components(staged(links, "op13-links"))
    least = groups.join(firsts.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("group_least"))
    linked = staged(groups.join(least, "component").select("node", "group_least"), "op13-groups")
    found = firsts.select("node", "least").join(linked, "node", "left").select("node", F.coalesce("group_least", "least").alias("component_id"))
    out = made.select("id", "n", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id, kept, at 85 hundredths of five-word shingles. Null texts are kept."""
    return minhash_components(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, by whole sets; equal sets are one.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
hashed AS (SELECT doc_id, r, len(s) AS n, md5(array_to_string(s, chr(10))) AS node, s FROM sets),
nodes AS (SELECT node, min(n) AS n, min(doc_id) AS least, any_value(s) AS s FROM hashed WHERE n > 0 GROUP BY node),
shingles AS (SELECT node, n, hash(x) AS x FROM (SELECT node, n, unnest(s) AS x FROM nodes)),
pairs AS (SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT DISTINCT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a AS node, min(least) AS component_id FROM reach JOIN nodes ON nodes.node = b GROUP BY a)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE coalesce(component_id, nodes.least) END AS component_id,
  doc_id = CASE WHEN n = 0 THEN doc_id ELSE coalesce(component_id, nodes.least) END AS kept
FROM (SELECT doc_id, n, node FROM hashed) h LEFT JOIN (SELECT node, least FROM nodes) nodes USING (node) LEFT JOIN least USING (node)
"""
