"""An inverted file that is stored: vectors in lists by their nearest centroid, a folder a list, opened with checks and searched by
reading only the lists that the queries probe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from . import vector


@dataclass(frozen=True)
class Index:
    """An open index: lists (concept_row, v, list_id; partitioned by list_id), centroids (list_id, c), and what its files say."""

    path: str
    lists: DataFrame
    centroids: DataFrame
    dim: int
    nlist: int
    nprobe: int
    rows: int


def _nearest(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors (concept_row, v) with the list_id of the nearest centroid, the smaller one of equally near ones. The nearest is that of
    the largest 2vc - cc: an inner product of vectors with one more number."""
    one = F.array(F.lit(1.0))
    q = vectors.select(F.col("concept_row").alias("query_id"), F.concat(F.transform("v", lambda x: x.cast("double")), one).alias("v"))
    c = centroids.select(F.col("list_id").cast("long").alias("concept_row"), F.concat(F.transform("c", lambda x: 2 * x), F.array(-vector.dot(F.col("c"), F.col("c")))).alias("v"))
    near = vector.exact_topk(q, c, 1).select(F.col("query_id").alias("concept_row"), F.col("concept_row").cast("int").alias("list_id"))
    return vectors.select("concept_row", "v").join(near, "concept_row")


def build(base: DataFrame, path: str, nlist: int = 2048, nprobe: int = 32, centroids: DataFrame | None = None, sample: int = 200_000, seed: int = 7) -> None:
    """Writes the index of base (concept_row, v) at path, which must be new. centroids (list_id, c) are found by KMeans over at most sample
    rows unless they are given. Vectors of different lengths, null ones and repeated rows are errors."""
    spark = base.sparkSession
    base = staged(base.select(F.col("concept_row").cast("long").alias("concept_row"), F.col("v").cast("array<float>").alias("v")), "index-base")
    n, distinct, least, most = base.agg(F.count("v"), F.count_distinct("concept_row"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if n != base.count() or n != distinct or least != most:
        raise ValueError("an index needs a vector a row, rows of their own, and vectors of one length")
    if centroids is None:
        centroids = vector.ivf_lists(base, nlist, sample, seed)[1]
    centroids = centroids.select(F.col("list_id").cast("int").alias("list_id"), F.col("c").cast("array<double>").alias("c"))
    centroids.coalesce(1).write.parquet(f"{path}/centroids")  # as many rows as lists
    centroids = spark.read.parquet(f"{path}/centroids")
    spark.createDataFrame([(most, centroids.count(), nprobe, sample, seed)], "dim int, nlist int, nprobe int, train_sample int, seed int").coalesce(1).write.parquet(f"{path}/config")
    _add(_nearest(base, centroids), path)


def _add(assigned: DataFrame, path: str) -> None:
    spark = assigned.sparkSession
    held = staged(assigned, "index-rows")
    # a list's rows in as many files as its size asks for: a hot list isn't one task
    dealt = held.repartition("list_id", F.pmod(F.xxhash64("concept_row"), F.lit(16)))
    dealt.write.mode("append").partitionBy("list_id").parquet(f"{path}/lists")
    spark.createDataFrame([(held.count(),)], "rows long").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append(vectors: DataFrame, path: str) -> None:
    """Adds vectors (concept_row, v) whose rows the index lacks to the lists of their nearest centroids, which stay as they are; so a call
    that is made twice adds once. An append that was cut short is seen when the index is opened."""
    index = open_index(vectors.sparkSession, path)
    new = vectors.select(F.col("concept_row").cast("long").alias("concept_row"), F.col("v").cast("array<float>").alias("v"))
    new = staged(new.dropDuplicates(["concept_row"]).join(index.lists.select("concept_row"), "concept_row", "left_anti"), "index-new")
    odd = new.filter(F.coalesce(F.size("v") != index.dim, F.lit(True))).count()
    if odd:
        raise ValueError(f"{odd} vectors don't have {index.dim} numbers")
    _add(_nearest(new, index.centroids), path)


def open_index(spark: SparkSession, path: str, dim: int | None = None, rows: int | None = None) -> Index:
    """The index at path, or an error: it must have the length of vectors of the encoder (dim) and as many rows as the metadata of its
    concepts (rows), where these are given, and as many rows as were added to it."""
    config = spark.read.parquet(f"{path}/config").first()
    centroids = spark.read.parquet(f"{path}/centroids")
    lists = spark.read.schema("concept_row long, v array<float>, list_id int").parquet(f"{path}/lists")
    added, held = spark.read.parquet(f"{path}/commits").agg(F.sum("rows")).first()[0], lists.count()
    if dim is not None and dim != config.dim:
        raise ValueError(f"the encoder's vectors have {dim} numbers, the index's {config.dim}")
    if added != held:
        raise ValueError(f"{added} rows were added, but {held} are there: an append was cut short")
    if rows is not None and rows != held:
        raise ValueError(f"{rows} rows of metadata for {held} vectors")
    return Index(path, lists, centroids, config.dim, config.nlist, config.nprobe, held)


def search(index: Index, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
    """query_id, rank (from 0), concept_row, score of the k best rows in the nprobe lists whose centroids have the largest inner product
    with the query (query_id, v). Folders of lists that no query probes aren't read: their ids reach the scan as a pruning filter."""
    probes = staged(queries.join(vector._probes(queries, index.centroids, nprobe or index.nprobe), "query_id").select("list_id", "query_id", "v"), "index-probes")
    return vector._rank(vector._blocked(probes, probed(index, probes), k, vector.QUERY_BLOCK, vector.BASE_BLOCK), k)


def probed(index: Index, probes: DataFrame) -> DataFrame:
    """The rows of the lists in probes (list_id, ...). There are as many ids as lists at most, so that they may be broadcast."""
    wanted = staged(probes.select("list_id").distinct(), "index-probed").filter("list_id >= 0")
    return index.lists.join(F.broadcast(wanted), "list_id").select("list_id", "concept_row", "v")


def sizes(index: Index) -> DataFrame:
    """list_id, n, dim: rows of each list and the length of their vectors."""
    n: Column = F.count("*")
    return index.lists.groupBy("list_id").agg(n.alias("n"), F.max(F.size("v")).alias("dim"))
