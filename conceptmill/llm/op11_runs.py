"""Periodic runs of words: stretches that repeat a period of theirs several times, and texts without the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, slices, table, text_or_empty
from .repeats import runs
from .words import coded_words

#: Bytes of texts that are indexed together; a longer text is indexed alone.
_BYTES = 1 << 19
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _held(codes: np.ndarray, n: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, length, period = runs(codes, n)
    long = length >= np.maximum(least, times * period)
    return start[long], length[long], period[long]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, n_words, runs (array of start, length, period; by start, then period), collapsed.

    A run is a stretch of words with the smallest period `period`, as long as can be, of least words and times periods at least
    (times is 2 or more); start is the number of its first word, from 0. collapsed: the words that no run contains after its first
    period, joined by one space. Each text is a job of its own within a task, so no row is shuffled. Null and empty texts have no
    word, no run and an empty collapsed text; repeated rows and null ids stay; extra columns are left out, whatever their names;
    an empty table gives no row."""
    if times < 2:
        raise ValueError("a run has two periods at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, n_bytes=_BYTES):
                codes, words, n = coded_words(piece.column(1))
                start, length, period = _held(codes, n, least, times)
                first = np.cumsum(n) - n
                doc = np.searchsorted(first + n, start, "right")
                each = np.append(0, np.cumsum(np.bincount(doc, minlength=len(n)))).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(length), pa.array(period)], fields=list(_RUN))
                # words within a run, but for its first period
                edge = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                kept = np.cumsum(edge[:-1]) == 0
                left = np.append(0, np.cumsum(kept))[np.append(0, first + n)].astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.take(pa.array(codes[kept]))), " ")
                columns = [piece.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(each), parts), texts]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed"])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(find, f"`{id_col}` long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, of which every tenth, by CRC-32 of its id, repeats a part of itself to its end: each word i >= a
    becomes word a + (i - a) % p, where h is the CRC-32, g = h // 10, a = g % n, and p = 1 + (n - a) // (3 + g % 8)."""
    words = F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("doc_id").isNotNull() & (F.col("h") % 10 == 0), words))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    part = F.slice("words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.when(n > 0, F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its runs, the longest one, and digests of all runs and of the collapsed text. Null texts have
    no run."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    # the longest; of equal ones the first, which has the smallest start, then period
    best = F.element_at(F.filter("runs", lambda r: r["length"] == F.array_max(F.col("runs.length"))), 1)
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
