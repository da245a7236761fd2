"""Positions of rows in an order, counted over partitions: limits and exact order statistics without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

_IN_PARTITION = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column], name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """rows with their place in the order, from 0; rows that the order doesn't tell apart are placed as they lie.

    Rows are dealt by ranges, sorted there and staged, so that places don't change if a task runs again; a partition's first place is
    the number of rows in those before it. The driver sees a number per partition."""
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    held = dealt.sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))
    return _placed(staged(held, "numbered"), name)


def in_file_order(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """rows, just read from files, with their place: by the files' names, then the place in the file."""
    place = {"__f": F.col("_metadata.file_path"), "__b": F.col("_metadata.file_block_start"), "__i": F.monotonically_increasing_id()}
    held = staged(rows.withColumns(place), "file-order")
    # a split of a file lies within one task, but a task may hold several
    parts = held.groupBy("__f", "__b").agg(F.count("*").alias("__n"), F.min("__i").alias("__first")).orderBy("__f", "__b").collect()
    return _joined(held, parts, ["__f", "__b"], name)


def _placed(held: DataFrame, name: str) -> DataFrame:
    parts = held.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first")).orderBy("__p").collect()
    return _joined(held, parts, ["__p"], name)


def _joined(held: DataFrame, parts: list, keys: list[str], name: str) -> DataFrame:
    bases, upto = [], 0
    for p in parts:
        bases.append((*[p[k] for k in keys], upto - p["__first"]))
        upto += p["__n"]
    kinds = ", ".join(f"{k} {held.schema[k].dataType.simpleString()}" for k in keys)
    table = held.sparkSession.createDataFrame(bases, f"{kinds}, __base long")  # a row per partition or split
    return held.join(F.broadcast(table), keys).withColumn(name, F.col("__base") + F.col("__i")).drop(*keys, "__i", "__base")


def first(rows: DataFrame, n: int, order: list[Column] | None = None, name: str = "ordinal") -> DataFrame:
    """The first n rows in the order, or of files as they lie; n of 0 or less: none. All partitions are looked at, one task never holds
    n rows."""
    placed = numbered(rows, order, name) if order else in_file_order(rows, name)
    return placed.filter(F.col(name) < max(0, n)).drop(name)


def order_statistics(rows: DataFrame, column: str, ranks: Iterable[int], bins: int = 1024, few: int = 2000) -> dict[int, float | None]:
    """The values at places (from 0) of the numeric column's values in ascending order, nulls left out, NaN last; None for a place
    beyond them. rows are read once a level, so stage what is dear.

    A level counts a range's values by equal bins and goes on in the bin that holds the place, between its least and its greatest
    value, until these are one, or few values are left, which are then sorted. The driver sees bins."""
    values = rows.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    top = F.lit(float("inf"))
    finite = (F.col("x") > -top) & (F.col("x") < top)  # NaN is above all
    n_low, n_finite, n_top, n_all, lo, hi = values.agg(F.count_if(F.col("x") == -top), F.count_if(finite), F.count_if(F.col("x") == top), F.count("*"), F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x")))).first()
    out: dict[int, float | None] = {}
    # a range: least, greatest, rows before it, rows in it
    open_: dict[tuple, list[int]] = {}
    for r in set(ranks):
        if not 0 <= r < n_all:
            out[r] = None
        elif n_low <= r < n_low + n_finite:
            open_.setdefault((lo, hi, n_low, n_finite), []).append(r)
        else:
            out[r] = float("-inf" if r < n_low else "inf" if r < n_low + n_finite + n_top else "nan")
    while open_:
        (lo, hi, before, n), wanted = open_.popitem()
        if lo == hi:
            out |= dict.fromkeys(wanted, lo)
            continue
        inside = values.filter(finite & F.col("x").between(lo, hi))
        if n <= few:
            held = sorted(r.x for r in inside.collect())
            out |= {r: held[r - before] for r in wanted}
            continue
        half = 1.0 if hi - lo < float("inf") else 2.0  # the width of a very wide range isn't finite
        share = (F.col("x") / half - lo / half) / (hi / half - lo / half) * bins
        found = inside.groupBy(F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for b in sorted(found.collect()):
            mine = [r for r in wanted if before <= r < before + b["n"]]
            if mine:
                open_.setdefault((b["lo"], b["hi"], before, b["n"]), []).extend(mine)
            before += b["n"]
    return out


def median(rows: DataFrame, column: str) -> float | None:
    """The exact median: of an even count the mean of the two in the middle; None without values."""
    n = rows.filter(F.col(column).isNotNull()).count()
    if not n:
        return None
    found = order_statistics(rows, column, {(n - 1) // 2, n // 2})
    return (found[(n - 1) // 2] + found[n // 2]) / 2
