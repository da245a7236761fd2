"""Concept tables from terminology rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ordinal


def first_per_key(rows: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def last_value(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def ordered_list(rows: DataFrame, key: str, value: str, order: str, distinct: bool = False) -> DataFrame:
    """The values of a key in order; with distinct, each at its first place."""
    out = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return rows.groupBy(key).agg((F.array_distinct(out) if distinct else out).alias(f"{value}s"))


def edges(rel: DataFrame, concepts: DataFrame, undirected: bool = True) -> DataFrame:
    """src, dst: concept rows of both ends; ends that aren't concepts drop the row, repeats stay."""
    a, b = concepts.select(F.col("cui").alias("cui1"), F.col("concept_row").alias("src")), concepts.select(F.col("cui").alias("cui2"), F.col("concept_row").alias("dst"))
    e = rel.join(a, "cui1").join(b, "cui2").select("src", "dst")
    if not undirected:
        return e
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))  # rel is read once
    return e.select(F.explode(both).alias("e")).select("e.src", "e.dst")


def out_degrees(e: DataFrame) -> DataFrame:
    return e.groupBy("src").agg(F.count("*").alias("degree"))


def in_universe(rows: DataFrame, universe: DataFrame, key: str = "cui") -> DataFrame:
    """Rows whose key the universe has."""
    return rows.join(universe.select(key).distinct(), key, "left_semi")


def with_tuis(concepts: DataFrame, tuis: DataFrame) -> DataFrame:
    """concepts (cui, ...) and tuis (cui, tui, place): each concept with its types in file order, repeats kept; none: an empty array."""
    lists = ordered_list(tuis, "cui", "tui", "place")
    return concepts.join(lists, "cui", "left").withColumn("tuis", F.coalesce("tuis", F.array().cast("array<int>")))


def synonym_lists(terms: DataFrame) -> DataFrame:
    """terms: cui, text, place. cui, texts in file order, n."""
    return ordered_list(terms, "cui", "text", "place").withColumn("n", F.size("texts"))


def synonym_totals(lists: DataFrame, cap: int | None = None) -> DataFrame:
    """One row: cuis, synonyms, average, filled (CUIs with cap synonyms or more)."""
    return lists.agg(F.count("*").alias("cuis"), F.coalesce(F.sum("n"), F.lit(0)).alias("synonyms"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average"), F.count_if(F.col("n") >= (cap or 2**31 - 1)).alias("filled"))


def synonym_rows(synonyms: DataFrame, concepts: DataFrame) -> DataFrame:
    """synonyms (cui, ...) with the concept_row of concepts (cui, concept_row); an error when it runs if a cui has none."""
    miss = F.when(F.col("concept_row").isNull(), F.raise_error(F.format_string("no concept has cui %d", "cui"))).otherwise(F.col("concept_row"))
    return synonyms.join(concepts.select("cui", "concept_row"), "cui", "left").withColumn("concept_row", miss.cast("long"))


def prefix_sums(rows: DataFrame, key: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """rows with the sum of value over all rows of a smaller or equal key (a long, at least 0). Keys are summed by ranges of width first,
    so that one task sees a row a range, and each range is a window of its own."""
    rows = rows.withColumn("__r", F.floor(F.col(key) / width))
    before = W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    ranges = rows.groupBy("__r").agg(F.sum(value).alias("s")).select("__r", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__b"))
    own = F.sum(value).over(W.partitionBy("__r").orderBy(key))
    return rows.withColumn("__o", own).join(ranges, "__r").withColumn(name, F.col("__b") + F.col("__o")).drop("__r", "__o", "__b")


def adjacency(e: DataFrame, concepts: DataFrame, order: str | None = None) -> DataFrame:
    """concept_row, start and end (its stretch of all neighbours, end to end), neighbours (dst in order: of column order, else of dst).
    Concepts without edges have an empty stretch. A row holds a concept's neighbours; hubs are what relation_hits cuts."""
    lists = e.groupBy(F.col("src").alias("concept_row")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order or "dst", F.col("dst").alias("d")))), lambda x: x["d"]).alias("neighbours"))
    every = concepts.select("concept_row").join(lists, "concept_row", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<long>"))).withColumn("n", F.size("neighbours").cast("long"))
    out = prefix_sums(every, "concept_row", "n", "end")
    return out.select("concept_row", (F.col("end") - F.col("n")).alias("start"), "end", "neighbours")


def adjacency_chunks(e: DataFrame, most: int = 1024) -> DataFrame:
    """concept_row, chunk (from 0), start (place of its first neighbour among all, end to end), neighbours (at most so many, by dst): the
    adjacency of e (src, dst) with no concept's neighbours in one row or task. Concepts without edges have no chunk."""
    placed = ordinal.numbered(e.select("src", "dst"), [F.col("src"), F.col("dst")], "__at")
    firsts = placed.groupBy("src").agg(F.min("__at").alias("__first"))
    chunk = F.floor((F.col("__at") - F.col("__first")) / most)
    cut = placed.join(firsts, "src").withColumn("chunk", chunk)
    lists = cut.groupBy(F.col("src").alias("concept_row"), "chunk").agg(F.min("__at").alias("start"), F.array_sort(F.collect_list("dst")).alias("neighbours"))
    return lists.select("concept_row", "chunk", "start", "neighbours")


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """src, dst of chunks, as relations are counted by."""
    return chunks.select(F.col("concept_row").alias("src"), F.explode("neighbours").alias("dst"))


def relation_meta(e: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row: n_concepts, n_edges, with_edges, max_degree."""
    totals = out_degrees(e).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("n_edges"), F.count("*").alias("with_edges"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))
    return totals.crossJoin(concepts.agg(F.count("*").alias("n_concepts")))  # two single rows
