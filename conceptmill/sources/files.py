"""Notes and rows from files, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import json_arrays
from . import npy as npy_files


def notes(spark: SparkSession, path: str, recursive: bool = False, max_bytes: int | None = None, limit: int | None = None) -> DataFrame:
    """note_file, note_type, bytes_read, text of the .txt files (any case) under path, by name. The cap counts bytes; a character cut by
    it is dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    raw = raw.withColumn("note_file", F.element_at(F.split("path", "/"), -1)).filter(F.lower("note_file").endswith(".txt"))
    content = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)
    out = raw.select("note_file", F.regexp_replace("note_file", r"(?i)\.txt$", "").alias("note_type"), F.octet_length(content).alias("bytes_read"), F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "").alias("text"))
    return out.orderBy("note_file").limit(limit) if limit else out


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines, blank lines skipped, damaged fields null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def jsonl_all(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of all *.jsonl files of a folder (or of one file), with note of the file and a sequence that follows the files' names."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.jsonl").json(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return rows.withColumn("seq", place)


def json_array(spark: SparkSession, path: str, item: str) -> DataFrame:
    """pos, item of a file that is one JSON array of items of a type; see json_arrays, which reads it in splits."""
    return json_arrays.array(spark, path, item)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value of a file that is one JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """concept_row, cui, prefterm, embedding_dim of a metadata file of parallel arrays; an error when it runs if one is shorter."""
    cuis = json_arrays.array(spark, path, "int", "cuis").withColumnRenamed("item", "cui").withColumn("__c", F.lit(True))
    terms = json_arrays.array(spark, path, "string", "prefterms").withColumnRenamed("item", "prefterm").withColumn("__t", F.lit(True))
    dim = spark.read.option("lineSep", ",").text(path).select(F.regexp_extract("value", r'"embedding_dim"\s*:\s*(\d+)', 1).alias("d")).filter("d <> ''").agg(F.max(F.col("d").cast("int")).alias("embedding_dim"))
    both = cuis.join(terms, "pos", "full_outer")
    row = F.when(F.col("__c").isNull() | F.col("__t").isNull(), F.raise_error(F.format_string("cuis and prefterms differ at %d", "pos"))).otherwise(F.col("pos"))
    return both.crossJoin(F.broadcast(dim)).select(row.cast("long").alias("concept_row"), "cui", "prefterm", "embedding_dim")  # one row of dim


def dictionary(spark: SparkSession, path: str, min_length: int = 2) -> dict[str, str]:
    """An abbreviation dictionary, a JSON object that the code then holds; keys shorter than min_length are left out."""
    return {r.key: r.value for r in json_map(spark, path, "string").collect() if len(r.key) >= min_length}


def positional(spark: SparkSession, path: str, wanted: DataFrame, item: str = "string") -> DataFrame:
    """Items of a JSON array at the wanted positions (column pos); an error when it runs if the array is too short for one."""
    return json_arrays.positional(spark, path, wanted, item)


def npy(spark: SparkSession, path: str) -> DataFrame:
    """concept_row, v of a NumPy file with a matrix or a folder of them; see the data source in npy."""
    return npy_files.read(spark, path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Files that each are one JSON array, a file a partition, rows in the order of the partition."""
    json_arrays.write(df, path)


def append_vectors(texts: DataFrame, embed, path: str, key: str = "concept_row") -> None:
    """Adds key, v of the texts (key, text) that the table at path lacks: a run that was cut short goes on where it ended."""
    spark = texts.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        texts = texts.join(spark.read.parquet(path).select(key), key, "left_anti")
    texts.select(key, embed(F.col("text")).alias("v")).write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    writer = df.write.option("ignoreNullFields", "false")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("quoteAll", "true").option("escape", '"').option("header", "true").option("emptyValue", "").csv(path)
