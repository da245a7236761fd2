"""The viewer's and the reports' operations on rows of an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: The columns of an exported row, and of a report's row.
EXPORT = "note start end span cui preferred_term score assertion semantic_group subject tui semantic_type severity laterality temporality".split()
REPORT = "note_file start end span expanded_text normalized_text cui preferred_term tui semantic_group semantic_type assertion subject score severity laterality temporality".split()


def shown(rows: DataFrame, query: str = "", assertions: list[str] | None = None, hidden_groups: list[str] = ()) -> DataFrame:
    """Rows of the given assertions (none given: all), of groups that aren't hidden, whose text, preferred term or cui holds query in any case."""
    keep = F.lit(True) if assertions is None else F.col("assertion").isin(list(assertions))
    keep = keep & ~F.col("semantic_group").isin(list(hidden_groups)) if hidden_groups else keep
    q = query.strip().lower()
    return rows.filter(keep & (F.lower("text").contains(q) | F.lower("preferred_term").contains(q) | F.lower("cui").contains(q)) if q else keep)


def counts(rows: DataFrame) -> DataFrame:
    """kind (assertion or group), value, n."""
    each = rows.select(F.explode(F.array(F.struct(F.lit("assertion").alias("kind"), F.col("assertion").alias("value")), F.struct(F.lit("group").alias("kind"), F.col("semantic_group").alias("value")))).alias("x"))
    return each.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def available(rows: DataFrame) -> DataFrame:
    """One row: the groups and the assertions that occur, in order."""
    return rows.agg(F.sort_array(F.collect_set("semantic_group")).alias("groups"), F.sort_array(F.collect_set("assertion")).alias("assertions"))


def key(start: Column, end: Column, cui: Column, assertion: Column, subject: Column) -> Column:
    """What tells a note's rows apart."""
    return F.concat_ws(":", start, end, cui, assertion, subject)


def valid(spans: Column, length: Column) -> Column:
    """Spans (start, end, ...) that lie in a text of that length and aren't empty."""
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= length))


def segments(text: Column, kept: Column) -> Column:
    """array<struct<text, at>>: text cut at spans that don't overlap and are in order (see review.non_overlapping); at is the span's
    place among them, null between spans. All of text, once."""
    ends = F.concat(F.array(F.lit(0)), F.transform(kept, lambda s: s["end"]))
    pieces = F.flatten(F.transform(kept, lambda s, i: F.array(F.struct(F.get(ends, i).alias("lo"), s["start"].alias("hi"), F.lit(None).cast("int").alias("at")), F.struct(s["start"].alias("lo"), s["end"].alias("hi"), i.cast("int").alias("at")))))
    last = F.struct(F.element_at(ends, -1).alias("lo"), F.char_length(text).alias("hi"), F.lit(None).cast("int").alias("at"))
    cut = F.filter(F.concat(pieces, F.array(last)), lambda p: p["hi"] > p["lo"])
    return F.transform(cut, lambda p: F.struct(F.substr(text, p["lo"] + 1, p["hi"] - p["lo"]).alias("text"), p["at"].alias("at")))


def displayed(segment: Column, preferred: Column, show_preferred: bool = True) -> Column:
    """A segment's text or, of a span, the preferred term at its place in preferred (an array)."""
    return F.when(segment["at"].isNotNull() & F.lit(show_preferred), F.get(preferred, segment["at"])).otherwise(segment["text"])


def export_rows(rows: DataFrame, note: str = "note_id") -> DataFrame:
    """The columns of EXPORT, nulls as empty strings."""
    named = rows.withColumnRenamed(note, "note").withColumn("span", F.col("text"))
    return named.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT])


def csv_line(*columns: Column) -> Column:
    """One line of quoted fields; a quote inside is doubled."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def report_rows(rows: DataFrame, context: bool = True) -> DataFrame:
    """The columns of REPORT, the fills of group and assertion and, with context, what stands left and right of the span."""
    more = [X.group_color(F.col("semantic_group")).alias("group_fill"), X.assertion_color(F.col("assertion")).alias("assertion_fill")]
    return rows.select(*REPORT, *more, *(["left_context", "right_context"] if context else []))


def group_summary(rows: DataFrame) -> DataFrame:
    """semantic_group, rows, present, absent, possible; to be shown by rows descending, then group."""
    named = [F.count_if(F.col("assertion") == a).alias(a.lower()) for a in ("PRESENT", "ABSENT", "POSSIBLE")]
    return rows.groupBy(F.upper(F.coalesce("semantic_group", F.lit(""))).alias("semantic_group")).agg(F.count("*").alias("rows"), *named)


def totals(rows: DataFrame, note: str = "note_file") -> DataFrame:
    """One row: rows, unique_notes."""
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(note).alias("unique_notes"))


def top_notes(rows: DataFrame, seq: str, note: str = "note_file", n: int = 50) -> DataFrame:
    """The n notes of most rows, of equal ones the first seen."""
    counted = rows.groupBy(F.col(note).alias("note_file")).agg(F.count("*").alias("rows"), F.min(seq).alias("first"))
    return counted.orderBy(F.desc("rows"), "first").limit(n).select("note_file", "rows")
