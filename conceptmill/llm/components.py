"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long, no nulls). Returns node, component (the least node reachable) for every node with an edge to another.

    Each round needs shuffles of what is left of the edges, with partial minima before them, and ends in a staged table; the
    number of rounds grows with the logarithm of the size. No component is gathered in one task."""
    e = staged(edges.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).filter("lo < hi").distinct(), "edges")
    mark = _mark(e)
    while True:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lows = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lows, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = staged(small.union(lows.select("hi", F.col("m").alias("lo"))).distinct().select("lo", "hi"), "edges")
        last, mark = mark, _mark(e)
        if mark == last:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())
