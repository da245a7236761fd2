"""Tables written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset and the master is local, as in tests."""
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


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later steps don't compute it again, on a lost executor either."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, times: int = 4) -> DataFrame:
    """df, a table as it is read, with its rows dealt over some tasks for each core if the files have fewer pieces (a row group is one)."""
    wanted = times * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def _bytes(field: T.StructField) -> Column:
    """About the bytes of a column in a row."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def small(df: DataFrame, rows: int = 100_000, n_bytes: int = 1 << 25) -> DataFrame:
    """df, marked for broadcast if its rows, counted, and their bytes, summed, are few enough; to be called on staged or tiny tables."""
    n, total = df.agg(F.count("*"), F.sum(reduce(add, [_bytes(f) for f in df.schema], F.lit(16)).cast("long"))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= n_bytes else df
