"""Token counts through a digest cache: a text is encoded once per tokenizer version, whoever holds it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, sized, slices, staged, table, text_or_empty

#: Rows of one digest that are joined to its count in one part.
PART_ROWS = 200
CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

_counters: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file, and the settings of the count."""
    with open(path, "rb") as f:
        return f"{hashlib.sha256(f.read()).hexdigest()}:plain"


def counter(path: str):
    """Counts the ids of each of a list of whole texts; tokenizers for .json, sentencepiece for .model."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from .byte_bpe import ByteBpe
            from tokenizers import Tokenizer

            if Tokenizer.from_file(path).to_str().find('"type":"ByteLevel","add_prefix_space":false') >= 0:
                codec = ByteBpe(path)
                _counters[path] = lambda texts: codec.encode(pa.array(texts, pa.string()))[1].tolist()
            else:
                model = Tokenizer.from_file(path)
                model.no_truncation()
                model.no_padding()
                _counters[path] = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _counters[path]


def open_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored counts, or None if nothing has been stored there."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(CACHE).parquet(path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, n_bytes (UTF-8), n_tokens.

    The content is the whole text, null taken as empty; nothing else is normalised, as any change could change the count.
    Its SHA-256 and the tokenizer's version are the key. Distinct keys that the cache at cache_path lacks are encoded, each
    by the row with the least id that holds it, and appended; equal counts stored twice (by two runs at once) do no harm.
    Repeated rows, null ids and clashing extra columns are fine; an empty table gives no row."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    keyed = rows.select("id", F.octet_length("t").cast("long").alias("n_bytes"), F.unhex(F.sha2("t", 256)).alias("digest"))
    known = staged(keyed, "op7-digests")

    stored = open_cache(spark, cache_path)
    sizes = staged(known.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")), "op7-distinct")
    misses = sizes
    if stored is not None:
        stored = stored.filter(F.col("tokenizer") == version).select("digest", "n_tokens")
        misses = staged(sizes.join(stored.select("digest").distinct(), "digest", "left_anti"), "op7-misses")
    # a digest that many rows have is dealt to parts of PART_ROWS, so that no task gets them all
    parts = lambda n: F.ceil(n / PART_ROWS).cast("int")
    salted = known.join(sized(staged(sizes.filter(F.col("n") > PART_ROWS).select("digest", parts(F.col("n")).alias("parts")), "op7-large")), "digest", "left")
    salted = salted.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts"))).otherwise(0).cast("int"))
    mine = rows.withColumn("digest", F.unhex(F.sha2("t", 256)))
    # the rows that hold the misses: where nothing is stored, all but those that repeat another's text
    firsts = misses if stored is not None else misses.filter("n > 1")
    firsts = sized(staged(firsts.select("digest", "least"), "op7-firsts"))
    first = F.col("least").eqNullSafe(F.col("id"))
    work = mine.join(firsts, "digest").filter(first) if stored is not None else mine.join(firsts.withColumn("again", F.lit(True)), "digest", "left").filter(first | F.col("again").isNull())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            for piece in slices(batch, 1, 500):
                yield pa.RecordBatch.from_pydict({"tokenizer": pa.array([version] * piece.num_rows, pa.string()), "digest": piece.column(0).cast(pa.binary()), "n_tokens": pa.array(count(piece.column(1).to_pylist()), pa.int64())})

    work.select("digest", "t").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    counts = open_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = counts.join(sizes.select("digest", "n"), "digest").select("digest", F.explode(F.sequence(F.lit(0), parts(F.col("n")) - 1)).alias("part"), "n_tokens")
    return salted.join(counts, ["digest", "part"]).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    """Every document: doc_id, n_bytes, n_tokens, over_limit. The query's cache is new, so that its result is all its own."""
    counts = token_counts(table(spark, sf_dir, "documents"), default_tokenizer(), new_path(spark, "op7-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
