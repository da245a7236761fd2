"""Importance resampling towards a target: hashed n-grams weigh each document, Gumbel noise makes the draw a top-k by score.

Scores are integers, so that an exact histogram of them, summed from the top, gives the rank at which each score begins; only the
rows of the scores that survive are numbered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, staged, table, text_or_empty
from .words import LOWER_ALNUM, coded_words

#: Buckets of the hashed features; the only thing that the driver gathers from a corpus, and what it sends to the tasks.
BUCKETS = 10_000


def hashed_features(texts: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CRC-32 of each run of 1 to most consecutive words (joined by a space), the text that holds it, and the words of each text."""
    codes, words, n = coded_words(texts, LOWER_ALNUM)
    names = [w.encode() for w in words.to_pylist()]
    owner = np.repeat(np.arange(len(n)), n)
    gram, sums = codes, [zlib.crc32(w) for w in names]
    hashes, owners = [np.array(sums, np.int64)[gram]] if names else [codes], [owner]
    for width in range(2, most + 1):
        # a run of width words is a run of one less and a further word; each distinct one is hashed once
        whole = np.flatnonzero(owner[width - 1 :] == owner[: max(0, len(owner) - width + 1)])
        pairs, gram_of = np.unique(gram[whole] * max(1, len(names)) + codes[whole + width - 1], return_inverse=True)
        sums = [zlib.crc32(b" " + names[k % len(names)], sums[k // len(names)]) for k in pairs.tolist()]
        gram = np.zeros(len(codes), np.int64)
        gram[whole] = gram_of
        hashes.append(np.array(sums, np.int64)[gram_of] if len(pairs) else pairs)
        owners.append(owner[whole])
    return np.concatenate(hashes), np.concatenate(owners), n


def bucket_counts(texts: DataFrame, text_col: str = "text", most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A partition sends a sum per bucket, and so does the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in slices(batch, 0):
                held += np.bincount(hashed_features(piece.column(0), most)[0] % buckets, minlength=buckets)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int64()), "n": pa.array(held[found])})

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text_or_empty(text_col).alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of (target's smoothed share) / (source's)) of each bucket."""
    S, T, B = float(source.sum()), float(target.sum()), float(len(source))
    pairs = zip(target.tolist(), source.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (S + B) / ((s + 1) * (T + B)))) for t, s in pairs], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, most: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_words, n_features, weight: the mean gain of its features, rounded down; 0 for none."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                hashes, owner, n_words = hashed_features(piece.column(1), most)
                n = np.bincount(owner, minlength=len(n_words))
                total = np.zeros(len(n_words), np.int64)
                np.add.at(total, owner, gain[hashes % len(gain)])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def with_scores(rows: DataFrame, seed: int) -> DataFrame:
    """rows (id, weight) with score: weight plus Gumbel noise in thousandths, which depends on the id and the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """scored (staged: id, n_words, score) with rank: 1, 2, 3... by score, the smaller id (null first) first among equals, of the best
    percent of the rows with least_words words at least, rounded down; null for all others.

    The driver gathers the histogram: a row per integer score. The noise spans 26,000 values and a mean of logarithms a few
    ten thousand, whatever the number of documents."""
    spark, fit = scored.sparkSession, F.col("n_words") >= least_words
    held = sorted(scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")).collect(), reverse=True)
    counts = np.array([r.n for r in held], np.int64)
    drawn = percent * int(counts.sum()) // 100
    before = np.cumsum(counts) - counts
    alive = int(np.searchsorted(before, drawn, "left"))  # scores that begin before the last rank
    empty = scored.withColumn("rank", F.lit(None).cast("long"))
    if not alive:
        return empty
    cutoff = held[alive - 1].score
    offsets = pa.table({"score": pa.array([r.score for r in held[:alive]], pa.int64()), "before": pa.array(before[:alive])})
    within = F.row_number().over(Window.partitionBy("score").orderBy("id"))
    top = scored.filter(fit & (F.col("score") >= cutoff)).join(F.broadcast(spark.createDataFrame(offsets)), "score")
    top = top.withColumn("rank", F.col("before") + within).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return empty.filter(~fit | (F.col("score") < cutoff)).unionByName(top.drop("before"))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, n_features, weight, score, rank (null: not drawn).

    Features are the runs of 1 to most words of the whole text; texts are read twice, to count and to weigh. Null and empty texts
    have none: weight 0, never drawn. Repeated rows are rows of their own with one score, ranked one after the other; null ids
    share the noise of an empty id and come first among equals; extra columns are left out, whatever their names. An empty table
    of documents gives no row; without a target text every bucket's target count is 0."""
    gain = gains(bucket_counts(docs, text_col, most), bucket_counts(target, target_col, most))
    scored = staged(with_scores(weighted(docs, gain, most, id_col, text_col), seed), "op12-scored")
    return ranked(scored, least_words, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its rank in the tenth that is drawn towards the benchmark's texts. Null texts: weight 0 and no rank."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 by its table of 256 entries (polynomial 0xEDB88320), once for each distinct word.
ORACLE = r"""
WITH RECURSIVE crc_table(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM crc_table WHERE k = 8),
doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
words AS (SELECT DISTINCT w FROM (SELECT unnest(w) AS w FROM doc UNION ALL SELECT unnest(w) FROM goal)),
bytes AS (SELECT w, list_transform(range(length(hex(encode(w))) // 2), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS b FROM words),
bucket AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM bytes, tab),
s AS (SELECT b, count(*) AS s FROM (SELECT unnest(w) AS w FROM doc) JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM (SELECT unnest(w) AS w FROM goal) JOIN bucket USING (w) GROUP BY b),
gain AS (SELECT range AS b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM range(10000) LEFT JOIN s ON s.b = range LEFT JOIN t ON t.b = range),
weights AS (SELECT r, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM (SELECT r, unnest(w) AS w FROM doc) JOIN bucket USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT doc_id, r, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weights USING (r)),
top AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM top) THEN rank END AS rank FROM scored LEFT JOIN top USING (r)
"""
