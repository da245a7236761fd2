"""Vector search: exact top-k by blocks, and an inverted file of centroid lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import small, staged
from .fold import fold

#: Most queries and base rows of a block; a block of each meets in one group of a task.
QUERY_BLOCK, BASE_BLOCK = 4096, 32_768
#: Most scores of a step within a block: some arrays of as many numbers are held beside the block.
_SCORES = 1 << 20
#: Most numbers of the queries that are sent to every task.
DIRECT_NUMBERS = 1 << 21


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalised(v: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def pooled(rows: DataFrame, key: str, mask: str | None = "mask") -> DataFrame:
    """key, v, n: the mean of the vectors (column v) of each key whose mask is above 0, weighted by it, and the sum of the masks; without a
    mask column of all. A key whose rows are all masked has a vector of zeros and n 0; null vectors and null masks count as masked.

    Vectors are summed by key in each partition first, then over partitions; vectors of one key must have one length."""
    weight = F.coalesce(F.col(mask).cast("double"), F.lit(0.0)) if mask else F.lit(1.0)
    given = rows.select(F.col(key).alias("k"), F.when(F.col("v").isNull(), 0.0).otherwise(weight).alias("w"), F.col("v").cast("array<double>").alias("v"))
    kind = rows.schema[key].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for k, w, v in zip(batch["k"], batch["w"], batch["v"], strict=True):
                k = None if pd.isna(k) else k
                s = sums.setdefault(k, [0.0, None])
                s[0] += w
                if v is not None:
                    s[1] = w * np.asarray(v) if s[1] is None else s[1] + w * np.asarray(v)
            if len(sums) > 10_000:
                yield _sums(sums)
                sums = {}
        yield _sums(sums)

    def _sums(sums: dict) -> pd.DataFrame:
        return pd.DataFrame({"k": pd.Series(list(sums), dtype=object), "w": [s[0] for s in sums.values()], "v": pd.Series([None if s[1] is None else s[1].tolist() for s in sums.values()], dtype=object)})

    schema = f"k {kind}, w double, v array<double>"
    parts = given.mapInPandas(add, schema)

    class Sum:
        """The sums of a key's parts."""

        def __init__(self) -> None:
            self.w, self.v = 0.0, None

        def feed(self, columns: list[list], lo: int, hi: int, out: list[tuple]) -> None:
            for w, v in zip(columns[0][lo:hi], columns[1][lo:hi], strict=True):
                self.w += w
                if v is not None:
                    self.v = np.asarray(v) if self.v is None else self.v + np.asarray(v)

        def end(self, out: list[tuple]) -> None:
            out.append(((self.v / max(self.w, 1e-12 if self.w > 0 else 1.0)).tolist() if self.v is not None else None, self.w))

    return fold(parts, ["k"], [], ["w", "v"], Sum, "v array<double>, n double").withColumnRenamed("k", key)


def best(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line of scores, the smaller row first of equal ones; rows: of each column, or of each score."""
    rows = np.broadcast_to(rows, scores.shape)
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        # ties at the k-th score: few lines, sorted whole
        tied = np.flatnonzero((scores >= kth).sum(axis=1) > k)
        at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        if len(tied):
            at[tied] = np.lexsort((rows[tied], -scores[tied]), axis=1)[:, :k]
        scores, rows = np.take_along_axis(scores, at, 1), np.take_along_axis(rows, at, 1)
    order = np.lexsort((rows, -scores), axis=1)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(rows, order, 1)


def _step(queries: int) -> int:
    """Base rows that meet so many queries at once."""
    return min(2048, max(64, _SCORES // max(1, queries)))


def _search(k: int):
    def search(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query_id": [], "concept_row": [], "score": []}).astype({"query_id": "int64", "concept_row": "int64"})
        m, rows = np.stack(q["v"].to_list()).astype(np.float64), b["concept_row"].to_numpy(np.int64)
        found = None
        step = _step(len(m))
        for lo in range(0, len(b), step):
            s, r = best(m @ np.stack(b["v"].iloc[lo : lo + step].to_list()).astype(np.float64).T, rows[None, lo : lo + step], k)
            found = (s, r) if found is None else best(np.concatenate([found[0], s], axis=1), np.concatenate([found[1], r], axis=1), k)
        return pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(np.int64), found[1].shape[1]), "concept_row": found[1].ravel(), "score": found[0].ravel()})

    return search


def _rank(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "concept_row")
    return found.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k).select("query_id", "rank", "concept_row", "score")


def _blocked(queries: DataFrame, base: DataFrame, k: int, query_block: int, base_block: int) -> DataFrame:
    """Both have list_id: the k best base rows of a query within its lists. Each list is cut into blocks of queries and of base rows by
    hash, and each pair of blocks is a group; a group emits k rows a query. Neither side passes the driver, and no list is one task."""
    sizes = queries.groupBy("list_id").agg(F.count("*").alias("n_q")).join(base.groupBy("list_id").agg(F.count("*").alias("n_b")), "list_id")
    sizes = small(staged(sizes.select("list_id", F.ceil(F.col("n_q") / query_block).cast("int").alias("nq"), F.ceil(F.col("n_b") / base_block).cast("int").alias("nb")), "vector-sizes"))
    groups = sizes.agg(F.coalesce(F.sum(F.col("nq") * F.col("nb")), F.lit(0))).first()[0]
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, "list_id").select("list_id", "query_id", "v", own("query_id", "nq").alias("qb"), every("nb").alias("bb"))
    b = base.join(sizes, "list_id").select("list_id", "concept_row", "v", own("concept_row", "nb").alias("bb"), every("nq").alias("qb"))
    n, keys = max(1, min(groups, 20_000)), ("list_id", "qb", "bb")
    q, b = q.repartition(n, *keys).groupBy(*keys), b.repartition(n, *keys).groupBy(*keys)
    return _rank(q.cogroup(b).applyInPandas(_search(k), "query_id long, concept_row long, score double"), k)


def _direct(asked: list, base: DataFrame, k: int) -> DataFrame:
    """The k best base rows of a few queries, which every task gets; base isn't moved, and a partition sends k rows a query."""
    ids, m = np.array([r.query_id for r in asked], np.int64), np.array([r.v for r in asked], np.float64)
    step = _step(len(m))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = None
        for b in frames:
            rows = b["concept_row"].to_numpy(np.int64)
            for lo in range(0, len(b), step):
                s, r = best(m @ np.stack(b["v"].iloc[lo : lo + step].to_list()).astype(np.float64).T, rows[None, lo : lo + step], k)
                found = (s, r) if found is None else best(np.concatenate([found[0], s], axis=1), np.concatenate([found[1], r], axis=1), k)
        if found is not None:
            yield pd.DataFrame({"query_id": np.repeat(ids, found[1].shape[1]), "concept_row": found[1].ravel(), "score": found[0].ravel()})

    return _rank(base.mapInPandas(search, "query_id long, concept_row long, score double"), k)


def _to_each(queries: DataFrame, held: list, k: int, least: float | None) -> DataFrame:
    """The k best of a few base rows, which every task gets, for each query; queries aren't moved."""
    rows, m = np.array([r.concept_row for r in held], np.int64), np.array([r.v for r in held], np.float64)
    step = max(64, _SCORES // len(rows))
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("concept_row", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                v = batch.column(1)
                if v.null_count or pc.any(pc.not_equal(pc.list_value_length(v), m.shape[1])).as_py():
                    raise ValueError(f"vectors of queries must have {m.shape[1]} numbers, as those of the base")
                s, r = best(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64) @ m.T, rows[None, :], k)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                if least is not None:
                    near = s[:, 0] >= least
                    s, r, ids = s[near], r[near], ids[near]
                n, found = s.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found), pa.int64()), pa.array(np.tile(np.arange(found, dtype=np.int32), n)), pa.array(r.ravel(), pa.int64()), pa.array(s.ravel(), pa.float64())], schema=schema)

    return queries.mapInArrow(search, "query_id long, rank int, concept_row long, score double")


def reaching(found: DataFrame, least: float) -> DataFrame:
    """found without the queries whose best score is below least."""
    return found.withColumn("best", F.max("score").over(W.partitionBy("query_id"))).filter(F.col("best") >= least).drop("best")


def exact_topk(queries: DataFrame, base: DataFrame, k: int, query_block: int | None = None, base_block: int = BASE_BLOCK, least: float | None = None) -> DataFrame:
    """queries: query_id, v; base: concept_row, v (both cheap to read again, or staged). Returns query_id, rank (from 0), concept_row,
    score (double, inner product), ties to the smaller concept_row, whatever the blocks; with least, only queries whose best score reaches
    it. Up to QUERY_BLOCK queries, whose vectors are some ten megabytes at most, go to the base; so few base rows go to the queries; more
    of both meet in blocks."""
    if least is not None and query_block is not None:
        return reaching(exact_topk(queries, base, k, query_block, base_block), least)
    own = base.select(F.col("concept_row").cast("long").alias("concept_row"), F.col("v").alias("v"))
    if query_block is None:
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").alias("v"))
        held = asked.limit(QUERY_BLOCK + 1)
        n, numbers = held.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
        if 0 < n <= QUERY_BLOCK and numbers <= DIRECT_NUMBERS:  # bounded by the limit
            found = _direct(held.collect(), own, k)
            return found if least is None else reaching(found, least)
        near = own.limit(QUERY_BLOCK + 1)
        rows, numbers = near.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
        if 0 < rows <= QUERY_BLOCK and numbers <= DIRECT_NUMBERS:
            return _to_each(asked, near.collect(), k, least)
        # blocks for every core
        query_block = QUERY_BLOCK if n > QUERY_BLOCK else max(256, -(-n // queries.sparkSession.sparkContext.defaultParallelism))
    one = F.lit(0).alias("list_id")
    found = _blocked(queries.select(one, "query_id", F.col("v").alias("v")), own.select(one, "concept_row", "v"), k, query_block, base_block)
    return found if least is None else reaching(found, least)


def ivf_lists(base: DataFrame, nlist: int, sample: int = 200_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(base with list_id, centroids): KMeans over at most sample rows, every row assigned to its nearest list."""
    total = max(1, base.count())
    data = base.withColumn("features", array_to_vector(normalised(F.col("v"))))
    model = KMeans(k=nlist, seed=seed, maxIter=10, featuresCol="features", predictionCol="list_id").fit(data.sample(min(1.0, sample / total), seed=seed))
    spark = base.sparkSession
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "list_id int, c array<double>")
    return staged(model.transform(data).drop("features"), "vector-lists"), centroids


def _probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    near = exact_topk(queries, centroids.select(F.col("list_id").cast("long").alias("concept_row"), F.col("c").alias("v")), nprobe)
    return near.select("query_id", F.col("concept_row").cast("int").alias("list_id"), F.col("rank").alias("probe"))


def ivf_topk(queries: DataFrame, lists: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Searches the nprobe lists whose centroids have the largest inner product: an equi-join on list_id, by blocks."""
    probes = queries.join(_probes(queries, centroids, nprobe), "query_id").select("list_id", "query_id", "v")
    return _rank(_blocked(staged(probes, "vector-probes"), lists.select("list_id", "concept_row", "v"), k, QUERY_BLOCK, BASE_BLOCK), k)


def probes_for(lists: DataFrame, centroids: DataFrame, k: int = 10, recall: float = 0.9, queries: int = 512, seed: int = 7) -> int:
    """The fewest lists to probe for the wanted recall at k, measured against the exact search over all rows, with about so many base
    rows as queries."""
    asked = lists.select(F.col("concept_row").alias("query_id"), "v")
    asked = staged(asked.sample(min(1.0, queries / max(1, asked.count())), seed=seed), "vector-asked")
    found = exact_topk(asked, lists.select("concept_row", "v"), k).join(lists.select("concept_row", "list_id"), "concept_row")
    nlist = centroids.count()
    need = found.join(_probes(asked, centroids, nlist), ["query_id", "list_id"]).groupBy("probe").count().orderBy("probe").collect()
    total, upto = sum(r["count"] for r in need), 0
    for r in need:
        upto += r["count"]
        if upto >= recall * total:
            return r["probe"] + 1
    return nlist


def index_config(lists: DataFrame, centroids: DataFrame, nprobe: int, sample: int = 200_000, seed: int = 7) -> DataFrame:
    """One row: index_type, n_vectors, dim, nlist, nprobe, train_sample, seed."""
    return lists.agg(F.lit("ivf").alias("index_type"), F.count("*").alias("n_vectors"), F.max(F.size("v")).alias("dim"), F.lit(centroids.count()).alias("nlist"), F.lit(nprobe).alias("nprobe"), F.lit(sample).alias("train_sample"), F.lit(seed).alias("seed"))


def self_test(base: DataFrame, first: int = 3, k: int = 5) -> DataFrame:
    """The k nearest rows of the first vectors; each must find itself."""
    q = base.filter(F.col("concept_row") < first).select(F.col("concept_row").alias("query_id"), "v")
    return exact_topk(q, base, k)


def checked(base: DataFrame, dim: int, rows: int | None = None) -> DataFrame:
    """base (concept_row, v), or an error: every vector has dim numbers, rows are 0, 1, 2 and so on, and as many as the metadata says."""
    n, least, most, distinct, odd = base.agg(F.count("*"), F.min("concept_row"), F.max("concept_row"), F.count_distinct("concept_row"), F.count_if(F.coalesce(F.size("v") != dim, F.lit(True)))).first()
    if odd:
        raise ValueError(f"{odd} vectors don't have {dim} numbers")
    if n and (least, most, distinct) != (0, n - 1, n):
        raise ValueError("rows must be numbered from 0 without gaps")
    if rows is not None and rows != n:
        raise ValueError(f"{rows} rows of metadata for {n} vectors")
    return base


def info_nce(pairs: DataFrame, batch: int = 32, temperature: float = 0.07) -> DataFrame:
    """pairs: idx (numbered from 0), pred, target (vectors). idx and loss: the cross entropy of each row's own target among those of its
    batch (batch rows in order of idx), vectors normalised. A batch is a group."""
    return _loss(pairs.withColumn("negatives", F.lit(None).cast("array<array<double>>")), batch, temperature)


def hard_negative_loss(pairs: DataFrame, batch: int = 32, temperature: float = 0.07) -> DataFrame:
    """As info_nce, with the row's own hard negatives (column negatives, an array of vectors) beside the targets of its batch."""
    return _loss(pairs, batch, temperature)


def _loss(pairs: DataFrame, batch: int, temperature: float) -> DataFrame:
    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)

    def loss(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        p, t = (unit(np.stack(frames[c].to_list()).astype(np.float64)) for c in ("pred", "target"))
        logits = p @ t.T / temperature
        extra = [unit(np.stack(list(x)).astype(np.float64)) @ p[i] / temperature if x is not None and len(x) else np.zeros(0) for i, x in enumerate(frames["negatives"])]
        out = [math.log(np.exp(logits[i]).sum() + np.exp(e).sum()) - logits[i, i] for i, e in enumerate(extra)]
        return pd.DataFrame({"idx": frames["idx"], "loss": out})

    return pairs.withColumn("b", F.floor(F.col("idx") / batch)).groupBy("b").applyInPandas(loss, "idx long, loss double")
