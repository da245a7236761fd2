"""Readers of terminology releases and of dumps: lines in, typed tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.pieces import SPACE, let


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, and its place (file, then position in it): a table's order where the last or the first row counts."""
    return spark.read.text(path).select(F.regexp_replace("value", "�", "").alias("line"), F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).alias("place"))


def _fields(df: DataFrame, least: int, line: str = "line") -> DataFrame:
    """Pipe-delimited fields; a quote is an ordinary character. Lines of fewer fields are dropped."""
    return df.withColumn("f", F.split(line, r"\|")).filter(F.size("f") >= least)


def mrsty(df: DataFrame) -> DataFrame:
    f = F.col("f")
    return _fields(df, 2).select(X.cui_of(f[0]).alias("cui"), F.regexp_replace(F.trim(f[1]), "^[Tt]", "").try_cast("int").alias("tui")).filter("cui is not null and tui is not null")


def mrconso(df: DataFrame, sab: list[str] = (), tty: list[str] = (), suppress: str | None = "N", min_chars: int = 3) -> DataFrame:
    """English names; an empty list lets all through."""
    f = F.col("f")
    out = _fields(df, 17).select(X.cui_of(f[0]).alias("cui"), f[1].alias("lat"), f[11].alias("sab"), f[12].alias("tty"), F.trim(f[14]).alias("str"), f[16].alias("suppress"))
    keep = (F.col("lat") == "ENG") & (F.char_length("str") >= min_chars) & F.col("cui").isNotNull()
    for name, wanted in (("sab", sab), ("tty", tty)):
        keep = keep & F.col(name).isin(list(wanted)) if wanted else keep
    return out.filter(keep & (F.col("suppress") == suppress) if suppress else keep)


def mrrel(df: DataFrame, rels: list[str] = ("PAR", "CHD", "RB", "RN")) -> DataFrame:
    def one(f: Column) -> Column:
        return F.struct(X.cui_of(F.get(f, F.lit(0))).alias("cui1"), F.get(f, F.lit(3)).alias("rel"), X.cui_of(F.get(f, F.lit(4))).alias("cui2"))

    # a line is cut once, and only wanted ones are looked at further; filters over a cut column would cut it again for each condition
    good = let(F.split("line", r"\|"), lambda f: F.when((F.size(f) >= 15) & F.get(f, F.lit(3)).isin(list(rels)) & (F.get(f, F.lit(14)) == "N"), F.array(one(f))))
    return df.select(F.explode(good).alias("r")).select("r.*").filter("cui1 is not null and cui2 is not null")


def insert_values(line: Column, table: str) -> Column:
    """The values of `INSERT INTO table VALUES(...)`: cut at commas outside quotes, without white space and then quotes at both ends; quotes
    inside stay as they are; a last value of no characters is dropped; null for other lines."""
    body = F.regexp_extract(line, rf"(?i)^INSERT INTO {table} VALUES\((.*)\)", 1)
    parts = F.regexp_extract_all(body, F.lit(r"((?:'[^']*(?:'|\z)|[^',])*)(?:,|\z)"), F.lit(1))
    # the pattern finds an empty part at the end, whatever stands before
    values = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.regexp_replace(F.regexp_replace(p, rf"^{SPACE}+|{SPACE}+$", ""), "^'+|'+$", ""))
    return F.when(line.startswith(f"INSERT INTO {table}") & line.rlike(rf"(?i)^INSERT INTO {table} VALUES\(.*\)"), values)
