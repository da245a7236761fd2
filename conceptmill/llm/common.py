"""Shared folder, staged tables and small helpers of the operators in this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, in Java and in Python: a run without space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and the master is
    local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="conceptmill-")
        spark.sparkContext.setCheckpointDir(root)
        root = f"file://{root}"
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts the lineage: a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int, rows: int = 2000, n_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """A batch in slices of few rows and, but for a longer text, of few bytes of a text column."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        base = int(upto[lo - 1]) if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(upto, base + n_bytes, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Most rows and bytes of a side that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 1 << 25


def _bytes(field: T.StructField) -> Column:
    """About the bytes of a column in a row."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, n_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows, counted, and their bytes, summed, are few enough; to be called on staged tables."""
    n, total = df.agg(F.count("*"), F.sum(reduce(add, [_bytes(f) for f in df.schema], F.lit(16)).cast("long"))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= n_bytes else df
