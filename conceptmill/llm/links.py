"""Links between the rows of a group that pass a test, as a forest: whatever pairs the test joins end in one tree.

Small groups are compared within a task, many groups of them at a time. In a large one every row first meets a few pivots of the
group, dealt to as many parts as the group needs; rows that the best pivot accepts are linked to it, and only the rest is compared
with all, a block against a block. No group is gathered in one task and no pair within a tree is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, staged
from .trie import Forest

#: Takes the data of some rows (a binary array) with the group of each, ascending, and which may ask (only pairs with one that may
#: are wanted); returns for each row a row of the same group and tree.
Linker = Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray]
#: Rows of a block of a large group, and pivots of one.
BLOCK, PIVOTS = 512, 4
_LINKS = "u long, v long"


def _runs(batches: Iterator[pa.RecordBatch], keys: int, n_bytes: int = 1 << 24) -> Iterator[pa.Table]:
    """Sorted batches, regrouped so that no run of rows with equal first keys columns is cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < n_bytes:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = _cut(table, keys)
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _keys(table: pa.Table, keys: int) -> np.ndarray:
    """The number of each row's run."""
    new = np.zeros(table.num_rows, bool)
    for k in range(keys):
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _cut(table: pa.Table, keys: int) -> int:
    run = _keys(table, keys)
    return int(np.searchsorted(run, run[-1]))


def _linked(rows: DataFrame, keys: list[str], link: Linker, parts: int | None = None) -> DataFrame:
    """u, v for rows (keys, node, side, data), which are dealt and sorted by keys; rows of side 0 may ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, len(keys)):
            node, ask = table.column("node").to_numpy(), table.column("side").to_numpy() == 0
            data = table.column("data").combine_chunks()
            label = link(data.chunk(0) if isinstance(data, pa.ChunkedArray) else data, _keys(table, len(keys)), ask)
            tree = np.flatnonzero(node != node[label])
            yield pa.RecordBatch.from_pydict({"u": pa.array(node[tree]), "v": pa.array(node[label[tree]])})

    dealt = rows.repartition(parts, *keys) if parts else rows.repartition(*keys)
    return dealt.select(*keys, "node", "side", "data").sortWithinPartitions(*keys).mapInArrow(run, _LINKS)


def near_pairs(near: Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray], np.ndarray]) -> Linker:
    """A linker by a test of pairs (rows of two arrays); pairs that are in one tree already aren't tested."""

    def link(data: pa.Array, group: np.ndarray, ask: np.ndarray) -> np.ndarray:
        forest = Forest(len(group))
        apart = np.arange(len(group))
        for d in range(1, len(group)):
            apart = apart[apart + d < len(group)]
            apart = apart[group[apart] == group[apart + d]]
            if not len(apart):
                break
            a = apart[(forest.label[apart] != forest.label[apart + d]) & (ask[apart] | ask[apart + d])]
            for lo in range(0, len(a), 1 << 15):
                some = a[lo : lo + (1 << 15)]
                some = some[near(data, some, data, some + d)]
                forest.link(some, some + d)
        return forest.label

    return link


def group_links(rows: DataFrame, near: Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray], np.ndarray], link: Linker, work: int = 20_000) -> DataFrame:
    """u, v: a forest of the pairs of rows (group, node, data; staged; a node once in a group) that are in one group and near.

    near tests pairs of rows of two arrays; link does the same for whole groups of bounded size. work: rows dealt to a task."""
    spark = rows.sparkSession
    sizes = staged(rows.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1"), "links-sizes")
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return spark.createDataFrame([], _LINKS)
    small = sizes if most <= BLOCK else sizes.filter(F.col("n") <= BLOCK)
    asks = rows.join(small.select("group"), "group").withColumn("side", F.lit(0))
    parts = max(total // work + 1, spark.sparkContext.defaultParallelism)
    found = _linked(asks, ["group"], link, parts)
    if most <= BLOCK:
        return found

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = staged(sizes.filter(F.col("n") > BLOCK), "links-large")
    held = staged(rows.join(sized(large), "group").withColumn("part", F.pmod(F.xxhash64("node"), blocks).cast("int")), "links-rows")
    # pivots: the least of each of a few classes, sent to every part of their group
    least = held.groupBy("group", F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(PIVOTS)).alias("k")).agg(F.min("node").alias("node"))
    pivots = held.join(sized(staged(least.select("group", "node"), "links-least")), ["group", "node"])
    pivots = staged(pivots.select("group", F.col("node").alias("pivot"), F.col("data").alias("like"), "n"), "links-pivots")
    sent = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), blocks - 1))).select("group", "part", "pivot", "like")
    meet = held.select("group", "part", "node", "data").join(sent, ["group", "part"]).select("group", "node", "pivot", "data", "like")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            held = pa.array(near(batch.column(3), at, batch.column(4), at)) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select([0, 1, 2]).filter(held)

    met = staged(meet.mapInArrow(accept, "group long, node long, pivot long"), "links-met")
    best = met.groupBy("group", "pivot").count().groupBy("group").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    done = met.join(best, ["group", "pivot"]).select("group", "node")
    rest = staged(held.join(done, ["group", "node"], "left_anti"), "links-rest")
    found = found.unionByName(met.filter("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")))
    left = staged(rest.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rests")), "links-left")
    if not left.head(1):
        return found
    i = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("rests")).cast("int")
    asking = rest.join(sized(left), "group").withColumn("i", i).withColumn("part", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(0))
    asked = held.join(sized(left), "group").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("side", F.lit(1))
    columns = ["group", "i", "part", "node", "side", "data"]
    both = asking.select(*columns).unionByName(asked.select(*columns))
    # a row of the rest meets itself as well, which makes no link
    return found.unionByName(_linked(both, ["group", "i", "part"], link))
