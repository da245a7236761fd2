"""Notes to concepts: mentions, vectors, search, choice, deduplication."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from .. import constants as K
from ..functions import text as X
from ..options import ExtractOptions
from ..staging import staged
from . import extract, rerank, vector

#: Code points of the texts that ngram_vectors holds at once.
_POINTS = 1 << 20


def ngram_vectors(texts: pd.Series, dim: int = 64) -> list[list[float]]:
    """Counts of hashed character trigrams, of length one; a list a text."""
    return [v for block in ngram_blocks(texts.tolist(), dim) for v in block.tolist()]


def ngram_blocks(texts: list[str | None], dim: int) -> Iterator[np.ndarray]:
    """The vectors of texts, in order, by blocks. Each text stands alone; texts of about _POINTS code points are held at once, a longer
    one alone."""
    upto, lo = np.cumsum(np.fromiter((len(t or "") for t in texts), np.int64, len(texts))), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _POINTS, "right")))
        padded = [f"  {(t or '').lower()} " for t in texts[lo:hi]]
        # all code points; each distinct trigram is hashed once
        points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, padded), np.int64, len(padded))
        row = np.repeat(np.arange(len(padded)), lens)
        at = np.flatnonzero(row[2:] == row[:-2]) if len(points) > 2 else np.zeros(0, np.int64)
        grams, which = np.unique((points[at] << 42) | (points[at + 1] << 21) | points[at + 2], return_inverse=True)
        slot = np.array([zlib.crc32("".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))).encode()) % dim for g in grams.tolist()], np.int64)
        counts = np.bincount(row[at] * dim + slot[which], minlength=len(padded) * dim).reshape(len(padded), dim).astype(np.float64)
        # squares of counts are whole numbers, so that their sum is exact in any order
        yield counts / np.maximum(np.sqrt((counts * counts).sum(axis=1)), 1e-12)[:, None]
        lo = hi


def ngram_vector(text: Column, dim: int = 64) -> Column:
    """ngram_vectors as a column, a stand-in for a learned encoder; batches don't change it."""

    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            blocks = [b.ravel() for b in ngram_blocks(texts.to_pylist(), dim)]
            values = np.concatenate(blocks) if blocks else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(values))

    return F.arrow_udf(embed, "array<double>", ArrowUDFType.SCALAR_ITER)(text)


def _info(concepts: DataFrame) -> DataFrame:
    return rerank.semantic_info(concepts.drop("v"))


def extract_concepts(notes: DataFrame, concepts: DataFrame, options: ExtractOptions = ExtractOptions(), edges: DataFrame | None = None, embed=ngram_vector, index: tuple[DataFrame, DataFrame, int] | None = None, labeler: extract.Labeler = extract.constant_labels, dictionary: dict[str, str] = K.ABBREVIATIONS) -> DataFrame:
    """notes: note_id, text; concepts: concept_row, cui, prefterm, tuis, v. One row a mention that links, a note's rows together, the
    best score first. Mentions are staged; every distinct text is embedded once and searched exactly, at any size; index (lists,
    centroids, probes) asks for the inverted file instead. labeler counts under use_model_labels only."""
    o = options
    if o.relation_rerank and edges is None:
        raise ValueError("relation_rerank needs edges")
    m = extract.note_mentions(notes, extract_all=o.extract_all, labeler=labeler if o.use_model_labels else extract.constant_labels, dictionary=dictionary)
    m = staged(m, "concept-mentions").withColumn("mention_id", F.struct("note_id", "start", "end")).withColumn("sentence_id", F.struct("note_id", "s_start"))
    # texts are staged, not their vectors, which are many times as large
    texts = staged(m.select("normalized_text").distinct(), "concept-texts").select(F.xxhash64("normalized_text").alias("query_id"), embed(F.col("normalized_text")).alias("v"))
    base = concepts.select("concept_row", "v")
    # the threshold holds for a text's best similarity, so texts below it end here
    found = vector.exact_topk(texts, base, o.top_k, least=o.threshold) if index is None else vector.reaching(vector.ivf_topk(staged(texts, "concept-vectors"), index[0], index[1], o.top_k, index[2]), o.threshold)
    # a candidate below the threshold is never chosen, only listed
    found = staged(found if o.include_candidates else found.filter(F.col("score") >= o.threshold), "concept-found")
    c = m.withColumn("query_id", F.xxhash64("normalized_text")).join(found, "query_id").join(_info(concepts), "concept_row")
    c = rerank.scored(c.withColumnsRenamed({"text": "raw", "expanded_text": "expanded"}), o)
    picked = rerank.choose(c, o)
    if o.relation_rerank:
        c, picked = staged(c, "concept-candidates"), staged(picked, "concept-picked")
        chosen = c.select("sentence_id", "mention_id", "rank", "concept_row").join(picked.select("mention_id", "rank"), ["mention_id", "rank"])
        c = rerank.relation_hits(c, chosen.select("sentence_id", "mention_id", "concept_row"), edges, o.relation_max_degree)
        picked = rerank.choose_again(picked, c, o)
    rows = c.drop("score", "lex").join(picked.select("mention_id", "rank", "score", "rerank_score"), ["mention_id", "rank"])
    rows = rows.select(
        "mention_id", "note_id", F.col("raw").alias("text"), F.col("expanded").alias("expanded_text"), "normalized_text", X.cui_text(F.col("cui")).alias("cui"), F.col("prefterm").alias("preferred_term"),
        "tui", "semantic_type", "semantic_group", "semantic_group_name", "assertion", "subject", "score", "rerank_score", "severity", "laterality", "temporality", "start", "end",
    )
    rows = rows.repartition("note_id")
    if o.dedupe:
        rows = extract.best_of_each(rows, ["note_id", "cui", "assertion", "subject"], "score", "start")
    if o.groups:
        rows = rows.filter(F.col("semantic_group").isin(list(o.groups)))
    if o.include_candidates:
        rows = rows.join(candidate_lists(c, o), "mention_id").repartition("note_id")
    return rows.drop("mention_id").sortWithinPartitions("note_id", F.desc("score"), "start")


def candidate_lists(c: DataFrame, o: ExtractOptions) -> DataFrame:
    """mention_id, candidates: an array of the mention's candidates by rank; relation hits raise the rerank score of those in the band."""
    hits = F.col("relation_hits").cast("int") if "relation_hits" in c.columns else F.lit(0)
    top = F.max("score").over(W.partitionBy("mention_id"))
    c = c.withColumn("__hits", hits).withColumn("__band", (F.col("score") >= o.threshold) & ((F.col("score") >= top - o.rerank_margin) if o.rerank_margin >= 0 else F.lit(True)))
    raised = F.col("rerank") + F.when(F.col("__band"), o.relation_weight * F.col("__hits")).otherwise(0.0)
    one = F.struct(
        F.col("rank").cast("int").alias("rank"), X.cui_text(F.col("cui")).alias("cui"), F.col("prefterm").alias("preferred_term"), "tui", "semantic_group", "score", "lex",
        (F.col("score") >= o.threshold).alias("meets_threshold"), F.col("__hits").alias("relation_hits"), "bias", "penalty", raised.alias("rerank_score"),
    )
    return c.groupBy("mention_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))


def extract_single(notes: DataFrame, concepts: DataFrame, options: ExtractOptions = ExtractOptions(threshold=0.5), **given) -> DataFrame:
    """The best row of each note, whose text is taken as one span."""
    rows = extract_concepts(notes, concepts, replace(options, extract_all=False, dedupe=True), **given)
    return extract.best_of_each(rows, ["note_id"], "score", "start")


def as_json(rows: DataFrame) -> DataFrame:
    """note_id, json: a row of an extraction as JSON, nulls kept."""
    return rows.select("note_id", F.to_json(F.struct(*[c for c in rows.columns if c != "note_id"]), {"ignoreNullFields": "false"}).alias("json"))


def batch_results(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a note, those without rows included: note_id, extractions (array, best first), count."""
    fields = [c for c in rows.columns if c != "note_id"]
    each = rows.groupBy("note_id").agg(F.collect_list(F.struct((-F.col("score")).alias("__s"), F.col("start").alias("__t"), F.struct(*fields).alias("row"))).alias("x"))
    found = F.transform(F.array_sort("x", lambda a, b: F.when(a["__s"] < b["__s"], -1).when(a["__s"] > b["__s"], 1).when(a["__t"] < b["__t"], -1).when(a["__t"] > b["__t"], 1).otherwise(0)), lambda r: r["row"])
    out = notes.select("note_id").join(each, "note_id", "left").select("note_id", found.alias("extractions"))
    return out.withColumn("count", F.coalesce(F.size("extractions"), F.lit(0))).withColumn("count", F.greatest("count", F.lit(0)))


def extract_batch(notes: DataFrame, concepts: DataFrame, options: ExtractOptions = ExtractOptions(), **given) -> tuple[DataFrame, dict[str, int]]:
    """batch_results of the notes, written once into the shared folder, and meta: ms, notes and count (of extractions). The counts are
    taken as the rows are written, so that they cost no further pass."""
    began, seen = time.monotonic(), Observation("extract_batch")
    results = batch_results(notes, extract_concepts(notes, concepts, options, **given))
    watched = results.observe(seen, F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    done = staged(watched, "extract-batch")
    return done, {"ms": int(1000 * (time.monotonic() - began)), "notes": int(seen.get["notes"]), "count": int(seen.get["count"])}
