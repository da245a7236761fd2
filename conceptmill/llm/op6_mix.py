"""Mixing sources to target weights with histograms of a hash: a threshold per source, and no sort.

Each document has a hash; a source takes the documents whose hash lies below its threshold. Sizes are summed by source and
the hash's first ten bits; the bucket where the sum passes the budget is the boundary, and only its documents are summed by
the next ten bits, and so on, until the boundary holds one hash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, sized, staged, table

LEVEL_BITS, LEVELS = 10, 6


def targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """totals: source, source_size, a row a source. Adds target: share of all sizes by weight, at most most times source_size,
    the excess reshared by weight among the sources below that until none is above. Sources take the weights in turn by code
    point, null last. With t = target / weight, a source stops at its own most * source_size / weight, so the level of the
    others is found by one pass over the sources in that order."""
    n = len(weights)
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    at = (F.row_number().over(order) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    out = totals.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every, by = W.partitionBy(F.lit(0)), W.orderBy("ratio", F.col("source").isNull(), "source")
    out = out.withColumn("budget", F.least(F.lit(float(share)) * F.sum("source_size").over(every), F.sum("cap").over(every)))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    capped, lighter = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", (F.col("budget") - capped) / (F.sum("weight").over(every) - lighter))
    # the first source that isn't stopped by its cap sets the level of all after it
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return out.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _bits(level: int):
    """The hash's bits of a level, from the most significant; the last level has what is left."""
    left = 64 - LEVEL_BITS * (level + 1)
    if level == LEVELS:
        return F.col("hash").bitwiseAND(F.lit((1 << (64 - LEVEL_BITS * LEVELS)) - 1))
    return F.shiftrightunsigned("hash", left).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per row of docs: id_col, h (XXH64 of the text), source, size (words), source_size, target, copies (how often the mix
    takes the row: whole passes over the source and, below its threshold, once more).

    Rows of one hash (repeated rows) share their fate. The threshold lies where the taken words come nearest to the
    target. A null text has size 0; null ids and sources are fine; a source of size 0 takes nothing; an empty table gives none.
    Sources with a third of all rows are summed on the map side first; nothing is sorted or gathered by source."""
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"), F.col(source_col).cast("string").alias("source"), F.when(F.col(text_col).isNull(), 0).otherwise(size).alias("size"))
    rows = staged(rows.withColumn("hash", F.xxhash64("id", "h", "source")), "op6-sizes")
    goal = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "op6-targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    # what the whole passes leave to be taken, and below which hash: prefix (bits so far), left (still to take inside it)
    edge = goal.select("source", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("left"), F.lit(True).alias("open"))
    edge = staged(edge, "op6-edge")
    for level in range(LEVELS + 1):
        inside = rows.join(sized(edge.select(F.col("source").alias("s"), *[F.col(f"b{k}").alias(f"e{k}") for k in range(level)])), F.col("source").eqNullSafe(F.col("s")))
        for k in range(level):
            inside = inside.filter(_bits(k) == F.col(f"e{k}"))
        sums = inside.groupBy("source", _bits(level).alias("bucket")).agg(F.sum("size").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("bucket")))
        placed = run.join(edge.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        # the first bucket that would pass what is left
        first = placed.filter(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "n")).alias("x"))
        edge = edge.join(first.select(F.col("source").alias("s"), "x"), F.col("source").eqNullSafe(F.col("s")), "left")
        # no such bucket: everything inside is taken, as if the boundary lay behind the last bucket
        edge = edge.select("source", "full", (F.col("left") - F.coalesce("x.before", F.lit(0))).alias("left"), *[f"b{k}" for k in range(level)], F.coalesce("x.bucket", F.lit(1 << LEVEL_BITS)).alias(f"b{level}"), F.coalesce("x.n", F.lit(0)).alias("n"))
        edge = staged(edge, "op6-edge")
    # the one hash at the boundary is taken if that comes nearer
    edge = edge.withColumn("with_it", (F.col("n") - F.col("left") < F.col("left")).cast("int"))
    full_rows = rows.join(sized(edge.drop("n", "left").withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    below, same = F.lit(False), F.lit(True)
    for k in range(LEVELS + 1):
        below, same = below | (same & (_bits(k) < F.col(f"b{k}"))), same & (_bits(k) == F.col(f"b{k}"))
    copies = F.col("full") + F.when(below, 1).when(same, F.col("with_it")).otherwise(0)
    out = full_rows.select("id", "h", "source", "size", F.least(copies, F.lit(math.ceil(most))).cast("int").alias("copies"))
    out = out.join(sized(goal.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("id").alias(id_col), "h", "source", "size", "source_size", "target", "copies")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, size, source_size, target, taken, copies. Null texts have size 0."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
