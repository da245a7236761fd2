"""Runs over notes and their figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..staging import staged
from .ordinal import median


def file_summary(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """notes: note_file, bytes_read, text; rows: note_file of each extraction. note_file, bytes_read, chars, extractions, also of
    notes without any."""
    n = rows.groupBy("note_file").agg(F.count("*").alias("extractions"))
    out = notes.select("note_file", "bytes_read", F.char_length("text").alias("chars")).join(n, "note_file", "left")
    return out.withColumn("extractions", F.coalesce("extractions", F.lit(0)).cast("long"))


def eval_rows(notes: DataFrame, rows: DataFrame, context_chars: int = 80) -> DataFrame:
    """rows (note_file, start, end, ...) with left_context, span and right_context from the notes' texts."""
    w = X.window(F.col("__text"), F.col("start"), F.col("end"), context_chars)
    out = rows.join(notes.select("note_file", F.col("text").alias("__text")), "note_file").withColumn("__w", w)
    return out.select(*rows.columns, F.col("__w.left").alias("left_context"), F.col("__w.span").alias("span"), F.col("__w.right").alias("right_context"))


def run_stats(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: rows, notes_with_rows, notes, mean_score, mean_jaccard, median_jaccard (of span and preferred term)."""
    lex = X.jaccard(X.token_set(F.col("text")), X.token_set(F.col("preferred_term")))
    each = staged(rows.select("note_file", "score", lex.alias("lex")), "run-stats")
    out = each.agg(F.count("*").alias("rows"), F.count_distinct("note_file").alias("notes_with_rows"), F.avg("score").alias("mean_score"), F.avg("lex").alias("mean_jaccard"), F.lit(median(each, "lex")).cast("double").alias("median_jaccard"))
    return out.crossJoin(notes.agg(F.count("*").alias("notes")))  # two single rows


def validation(rows: DataFrame) -> DataFrame:
    """rows: cosine, gold and predicted labels. One row: mean_cosine, median_cosine, accuracy; nulls without rows."""
    each = staged(rows.select("cosine", (F.col("gold") == F.col("predicted")).cast("int").alias("right")), "validation")
    return each.agg(F.round(F.avg("cosine"), 6).alias("mean_cosine"), F.round(F.lit(median(each, "cosine")).cast("double"), 6).alias("median_cosine"), F.round(F.avg("right"), 6).alias("accuracy"))


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))
