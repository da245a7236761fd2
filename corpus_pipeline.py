"""A corpus from raw documents to token shards: quality, near duplicates, benchmark leaks, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last keep the columns of documents. SQL can't express the fingerprints, so there is no ORACLE_SQL; the tests hold
each stage against a brute-force version.
"""

from __future__ import annotations

from conceptmill.llm import op1_repair, op3_simhash, op5_decontaminate, op6_mix, op8_quality
from conceptmill.llm.common import new_path, sized, staged, table, text_or_empty
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words; repeated rows and null ids are passed on."""
    return op8_quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): that of the least doc_id, null
    first; of rows alike in id and text, one. Texts without a word, null or empty, are one group. An empty table stays empty."""
    return op3_simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item: thirteen tokens in a row that differ in two at most;
    of a shorter item, all of it. Null and empty texts hold none and stay, as do null ids; repeated rows share their fate; an empty
    table, of documents or items, is fine."""
    return op5_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows alike in doc_id, text and source share their fate."""
    mixed = op6_mix.mix(docs).filter("copies > 0").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("source").alias("__source"), F.col("copies").alias("__copies")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty()) == F.col("__h")) & F.col("source").eqNullSafe(F.col("__source"))
    taken = docs.join(sized(staged(mixed, "mixture")), same)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder; a row per document of the mix, read back from them: doc_id, start, n_tokens, ids_crc32. A
    null text is the end id alone; null ids come first; repeated rows stay; other columns are left out; an empty table gives no row."""
    return op1_repair.read_digests(op1_repair.token_shards(docs))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
