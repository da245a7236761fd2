"""Abbreviations by a table of keys: windows of a text's words meet the keys in an equi-join, so that a dictionary may have any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..staging import small, staged
from .fold import apart

_SMALL, _CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def keys_of(table: DataFrame, min_length: int = 2, safe_pairs: tuple[str, ...] = tuple(K.SAFE_PAIRS)) -> DataFrame:
    """key (in capitals), expanded, parts (runs of word characters and of others) of a dictionary (key, value), the greatest value of
    equal keys. Left out are keys shorter than min_length, of two letters that aren't safe, and such as don't begin and end with a
    word character, as no whole word does."""
    key = F.translate(F.trim("key"), _SMALL, _CAPITAL)
    good = (F.char_length("key") >= max(2, min_length)) & ((F.char_length("key") > 2) | F.col("key").isin(list(safe_pairs)))
    whole = F.col("key").rlike(r"^\w") & F.col("key").rlike(r"\w$")
    held = table.select(key.alias("key"), F.col("value").alias("expanded")).filter(good & whole).groupBy("key").agg(F.max("expanded").alias("expanded"))
    return staged(held.withColumn("parts", F.size(F.split("key", r"\b", -1)) - F.when(F.col("key").rlike(r"\b$"), 1).otherwise(0)), "dictionary")


def _windows(notes: DataFrame, lengths: list[int], id_col: str, text_col: str, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """id_col, key (in capitals), start, end, original of every window of so many parts that begins with a word; with wanted (keys by
    their first part) of those that are among them."""
    kind = notes.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("key", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("original", T.StringType())])
    known = {k for ks in wanted.values() for k in ks} if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a text at a time: its windows are a few times its size
                parts = batch.column(1)[i].as_py() or []
                upper = [p.translate(_UPPER) for p in parts]
                # a key's first part is a word
                words = [k for k, p in enumerate(upper) if p in wanted] if wanted is not None else [k for k, p in enumerate(parts) if p[:1].isalnum() or p[:1] == "_"]
                if not words:
                    continue
                ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
                keys, start, end, original = [], [], [], []
                for n in lengths:
                    for k in words:
                        if k + n <= len(parts):
                            key = "".join(upper[k : k + n]) if n > 1 else upper[k]
                            if known is None or key in known:
                                keys.append(key)
                                start.append(int(ends[k]) - len(parts[k]))
                                end.append(int(ends[k + n - 1]))
                                original.append("".join(parts[k : k + n]))
                if keys:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(keys), i))), pa.array(keys), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(original, pa.string())], names=[id_col, "key", "start", "end", "original"])

    # the JVM cuts, so that a word ends where it does in its patterns
    return notes.select(id_col, F.split(F.coalesce(text_col, F.lit("")), r"\b").alias("parts")).mapInArrow(run, schema)


_UPPER = str.maketrans(_SMALL, _CAPITAL)


def _few(keys: DataFrame, rows: int = 100_000, n_bytes: int = 1 << 24) -> dict[str, list[str]] | None:
    """The keys by their first part, if they are few enough to be sent to every task; none if they are more."""
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    if n > rows or total > n_bytes:
        return None
    found: dict[str, list[str]] = {}
    for r in keys.select("key", F.split("key", r"\b").getItem(0).alias("first")).collect():
        found.setdefault(r["first"], []).append(r.key)
    return found


def expansions(notes: DataFrame, keys: DataFrame, id_col: str = "note_id", text_col: str = "text") -> DataFrame:
    """id_col, start, end, original, expanded of the whole-word keys (see keys_of) in each text, in any case, but keys of two letters in
    capitals only; from left to right, the longest key at a place, without overlap.

    Keys that are few enough meet the windows in the task that cut them; more are joined by a shuffle, windows by key. Ids must be
    unique. Null and empty texts have none; an empty dictionary finds nothing."""
    lengths = sorted(r.parts for r in keys.select("parts").distinct().collect())  # odd numbers up to twice a key's words
    if not lengths:
        return notes.sparkSession.createDataFrame([], T.StructType([notes.schema[id_col], *T.StructType.fromDDL("start int, end int, original string, expanded string").fields]))
    hits = _windows(notes, lengths, id_col, text_col, _few(keys)).join(small(keys.select("key", "expanded")), "key")
    hits = staged(hits, "dictionary-hits")
    out = apart(hits.select(id_col, "start", "end"), [id_col]).join(hits, [id_col, "start", "end"]).select(id_col, "start", "end", "original", "expanded")
    return out.filter((F.char_length("original") > 2) | (F.col("original") == F.upper("original")))


def expand(notes: DataFrame, keys: DataFrame, id_col: str = "note_id", text_col: str = "text") -> DataFrame:
    """id_col, expanded: each text (null: empty) with its keys replaced by what they stand for, see expansions. A row holds a text and
    what is replaced in it."""
    found = expansions(notes, keys, id_col, text_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "expanded"))).alias("hits"))
    both = notes.select(id_col, F.coalesce(text_col, F.lit("")).alias("t")).join(found, id_col, "left")
    schema = T.StructType([notes.schema[id_col], T.StructField("expanded", T.StringType())])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                made, at = [], 0
                for h in hits or []:
                    made += [text[at : h["start"]], h["expanded"]]
                    at = h["end"]
                out.append("".join([*made, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "expanded"])

    return both.select(id_col, "t", "hits").mapInArrow(replace, schema)
