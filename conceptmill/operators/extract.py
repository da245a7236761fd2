"""Notes to mentions: the part of the extraction that needs no vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.mentions import content, found_or_whole, pieces_of, start_of, text_of, to_cut_from
from ..functions.pieces import let, plain


def sentences(notes: DataFrame, id_col: str = "note_id", text_col: str = "text", extract_all: bool = True) -> DataFrame:
    """note_id, start, end, sentence, prefix, assertion, subject (rules only): one row a sentence, narrow, no shuffle."""
    each = notes.select(F.col(id_col).alias("note_id"), F.explode(X.sentence_spans(F.col(text_col), extract_all)).alias("s"))
    each = each.select("note_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("sentence"))
    return each.withColumn("c", X.context(F.col("sentence"))).select("note_id", "start", "end", "sentence", "c.prefix", "c.assertion", "c.subject")


Labeler = Callable[[Column], tuple[Column, Column]]


def constant_labels(sentence: Column) -> tuple[Column, Column]:
    """Assertion and subject of a sentence that no rule labels."""
    return F.lit("PRESENT"), F.lit("PATIENT")


def note_mentions(notes: DataFrame, id_col: str = "note_id", text_col: str = "text", extract_all: bool = True, labeler: Labeler = constant_labels, dictionary: dict[str, str] = K.ABBREVIATIONS) -> DataFrame:
    """One row a mention: spans, the place of its sentence, expansion, modifiers, normalised text, and the sentence's labels: those of
    the rules, else of labeler. The filters run before anything that embeds; of a sentence's equal expansions the first stays, while
    they are one array. Narrow, no shuffle, no Python."""
    each = sentences(notes, id_col, text_col, extract_all).withColumnsRenamed({"start": "s_start", "end": "s_end"})
    assertion, subject = labeler(F.col("sentence"))
    each = each.withColumn("assertion", F.coalesce("assertion", assertion)).withColumn("subject", F.coalesce("subject", subject))
    # steps are columns, not steps within an expression, as those are interpreted and copied
    sentence, body, found = F.col("sentence"), F.col("body"), F.col("found")
    each = each.withColumn("body", content(sentence, F.col("prefix"))).withColumn("found", pieces_of(body)).withColumn("found", found_or_whole(sentence, body, found))
    # a piece is cut where no word is, so that one with a key of the dictionary is in a content with one
    each = each.withColumn("key", X.holds_key(sentence, dictionary) | X.holds_key(body["part"], dictionary)).withColumn("base", start_of(body)).withColumn("cut_from", to_cut_from(sentence))
    text = lambda p: text_of(F.col("cut_from"), p, F.col("base") + p["at"])
    keys = lambda of: F.transform(found, lambda p: F.lower(F.trim(of(text(p)))))
    each = each.withColumn("keys", F.when(F.size("found") > 1, F.when(F.col("key"), keys(lambda t: X.expand(t, dictionary))).otherwise(keys(plain))))
    repeated = F.size(F.array_distinct("keys")) < F.size("keys")
    once = F.when(repeated, _first_wanted(found, F.col("keys"), text, dictionary)).otherwise(found)
    # an expression: of a column Spark would infer a filter, and push it below the columns that it reads, which are then made twice
    each = each.select("note_id", "s_start", "assertion", "subject", "key", "base", "cut_from", F.explode(once).alias("p"))
    each = each.withColumn("at", F.col("base") + F.col("p.at")).withColumn("text", text(F.col("p")))
    e, normal = F.col("expanded_text"), F.col("normalized_text")
    each = each.withColumn("expanded_text", F.when(F.col("key"), X.expand(F.col("text"), dictionary)).otherwise(plain(F.col("text")))).withColumn("modified", X.is_modified(e)).withColumn("normalized_text", F.trim(X.without_modifiers(e, F.col("modified"))))
    each = each.withColumn("normalized_text", F.when(normal != "", normal).otherwise(F.trim(e)))
    # not a filter, for the same reason
    each = each.select("*", F.explode(F.when(mention_filter(F.col("text"), normal), F.array(F.lit(True)))).alias("wanted"))
    return each.select(
        "note_id", "s_start", (F.col("s_start") + F.col("at")).alias("start"), (F.col("s_start") + F.col("at") + F.char_length("p.part")).alias("end"), "text", "expanded_text", "normalized_text", "assertion", "subject",
        *[F.when(F.col("modified"), f(e)).alias(f.__name__) for f in (X.severity, X.laterality, X.temporality)],
    )


def _first_wanted(found: Column, keys: Column, text: Callable[[Column], Column], dictionary: dict[str, str]) -> Column:
    """Of a sentence's pieces those that the filter keeps, and of these the first of each key."""

    def normal(e: Column) -> Column:
        return let(F.trim(X.without_modifiers(e)), lambda n: F.when(n != "", n).otherwise(F.trim(e)))

    kept = F.transform(found, lambda p: let(X.expand(text(p), dictionary), lambda e: mention_filter(text(p), normal(e))))
    asked = lambda flags: F.transform(keys, lambda k, i: F.when(F.get(flags, i), k))
    return let(let(kept, asked), lambda ks: F.filter(found, lambda p, i: F.array_position(ks, F.get(ks, i)) == i + 1))


def scaffold(raw, candidate):
    """Field labels and result headers of a template."""
    low = F.lower(F.trim(candidate))
    results = low.contains("lab results") | low.contains("laboratory results")
    # a plain search first, where it rules a pattern out
    field = (low.contains("date") | low.contains("type")) & candidate.rlike(r"(?i)\s+(?:start\s+date|end\s+date|stop\s+date|types?)\s*$")
    return (low == "") | (results & (low.rlike(r"\b(?:lab|laboratory)\s*\d+\b") | (F.char_length(low) <= 48))) | (raw.contains(":") & F.lower(raw).contains("types:")) | field


def mention_filter(raw, candidate):
    stop = F.lower(candidate).isin(K.STOP_MENTIONS)
    other = candidate.contains(":") & candidate.rlike(r"(?i)^\s*other\s*:\s*")
    return ~X.is_section_header(raw) & X.allowed_span(raw) & candidate.rlike("[A-Za-z]") & ~other & ~stop & ~scaffold(raw, candidate)


def best_of_each(rows: DataFrame, keys: list[str], score: str = "score", seq: str = "seq") -> DataFrame:
    """The row of the highest score for each key, the first of equal ones."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), seq)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
