"""Training rows: templates, mined phrases, labelled lines, and the joins that deal examples to steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.pieces import SPACE, matches
from . import silver


def filled(spark: SparkSession, templates: list[tuple[str, str]], conditions: list[str]) -> DataFrame:
    """text, label, entity, source: every template with every condition, two lists that the code holds."""
    return filled_with(spark.createDataFrame([(c,) for c in conditions], "entity string"), templates).select("text", "label", "entity", "source")


def filled_with(entities: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """entities (entity, ...) with text, label and source: a row for every template, which are a list that the code holds. A null entity
    gives a null text."""
    each = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(template).alias("template")) for label, template in templates]))
    text = F.replace(F.col("t.template"), F.lit("{condition}"), F.col("entity"))
    return entities.withColumn("t", each).select(*entities.columns, text.alias("text"), F.col("t.label").alias("label"), F.lit("synthetic").alias("source"))


def mined(notes: DataFrame, patterns: list[str] = K.MINED_PATTERNS, around: int = 50, most: int | None = None) -> DataFrame:
    """note_id, pattern, start, end, phrase, window: all that each pattern finds in a note, in the order of the patterns, with up to around
    characters on both sides of its own place; the first most of a note, if that is given."""
    def found_by(k: int, pattern: str) -> Column:
        return F.transform(matches(F.col("text"), f"(?i){pattern}"), lambda m: F.struct(F.lit(k).alias("pattern"), m["at"].alias("start"), (m["at"] + F.char_length(m["part"])).alias("end")))

    found = F.concat(*[found_by(k, p) for k, p in enumerate(patterns)])
    each = notes.select("note_id", "text", F.explode(F.slice(found, 1, most) if most else found).alias("m")).select("note_id", "text", "m.*")
    left = F.greatest(F.lit(0), F.col("start") - around)
    cut = lambda a, b: F.substr("text", a + 1, b - a)
    return each.select("note_id", "pattern", "start", "end", cut(F.col("start"), F.col("end")).alias("phrase"), cut(left, F.col("end") + around).alias("window"))


def confident(examples: DataFrame, least: float = 0.7) -> DataFrame:
    """Labelled examples of which the labeller is sure."""
    return examples.filter(F.col("confidence") > least)


def marked(text: Column, entity: Column, tag: str = "[entity]") -> Column:
    """The first place of entity in text between tags; text without it stays."""
    at = F.instr(text, entity)
    return F.when(at > 0, F.overlay(text, F.concat(F.lit(f"{tag} "), entity, F.lit(f" {tag}")), at, F.char_length(entity))).otherwise(text)


def subject_lines(notes: DataFrame, family: list[str] = K.FAMILY_LINES, patient: list[str] = K.PATIENT_LINES, least: int = 10, most: int = 200) -> DataFrame:
    """note_id, line, label: trimmed lines that a pattern of one of the two sets finds, and none of the other."""
    each = notes.select("note_id", F.explode(F.split("text", "\n")).alias("line")).select("note_id", F.regexp_replace("line", rf"^{SPACE}+|{SPACE}+$", "").alias("line")).filter(F.char_length("line").between(least, most))
    f, p = (F.col("line").rlike("(?i)" + "|".join(f"(?:{x})" for x in xs)) for xs in (family, patient))
    return each.filter(f != p).select("note_id", "line", F.when(f, "FAMILY").otherwise("PATIENT").alias("label"))


def dealt(steps: DataFrame, examples: DataFrame, step: str = "idx", place: str = "pos") -> DataFrame:
    """Each step with the example at step modulo their number; examples number from 0 in place."""
    n = max(1, examples.count())
    return steps.withColumn("__p", F.pmod(step, F.lit(n))).join(examples, F.col("__p") == F.col(place)).drop("__p")


def neighbours(rows: DataFrame, total: int) -> DataFrame:
    """Missing neighbours (-1) become the next row, around the end."""
    return rows.withColumn("neighbours", F.transform("neighbours", lambda x: F.when(x < 0, F.pmod(F.col("concept_row") + 1, F.lit(total))).otherwise(x)))


def concept_sample(concepts: DataFrame, synonyms: DataFrame, n: int, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """n concepts (cui, ...) by MD5, and the synonyms that belong to them."""
    chosen = silver.hash_sample(concepts, "cui", n, seed)
    return chosen, synonyms.join(chosen.select("cui"), "cui", "left_semi")


def split(rows: DataFrame, key: str, share: float = 0.9, seed: int = 13) -> DataFrame:
    """is_train by the MD5 of seed and key."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("is_train", h < int(share * 2**32))


def all_synthetic(spark: SparkSession) -> DataFrame:
    return filled(spark, K.ASSERTION_TEMPLATES, K.CONDITIONS).unionByName(filled(spark, K.SUBJECT_TEMPLATES, K.CONDITIONS))


def with_clinical(synthetic: DataFrame, clinical: DataFrame) -> DataFrame:
    """Synthetic examples (text, label, entity, source) and those from notes (text, label, entity, confidence); synthetic ones have no confidence."""
    return synthetic.withColumn("confidence", F.lit(None).cast("double")).unionByName(clinical.withColumn("source", F.lit("clinical_note")).select("text", "label", "entity", "source", "confidence"))
