"""Choice of a concept for each mention: lexical, type and relation signals inside a band below the best similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..options import ExtractOptions


def semantic_info(concepts: DataFrame) -> DataFrame:
    """concepts: concept_row, cui, prefterm, tuis (array, order counts). Adds tui, type, group, name."""
    first = F.get("tuis", F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in K.TUI_NAMES.items() for x in kv])
    groups = F.create_map(*[F.lit(x) for kv in K.TUI_GROUPS.items() for x in kv])
    labels = F.create_map(*[F.lit(x) for kv in K.SEMANTIC_GROUPS.items() for x in kv])
    code = F.when(first.isNull(), "UNKN").otherwise(F.coalesce(F.try_element_at(groups, first), F.lit("CONC")))
    return concepts.select(
        "*", F.when(first.isNull(), "T000").otherwise(F.format_string("T%03d", first)).alias("tui"),
        F.when(first.isNull(), "Unknown").otherwise(F.coalesce(F.try_element_at(names, first), F.lit("Concept"))).alias("semantic_type"),
        code.alias("semantic_group"), F.coalesce(F.try_element_at(labels, code), F.lit("Unknown")).alias("semantic_group_name"),
    )


def scored(candidates: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """candidates: score, raw, expanded, prefterm, tui, semantic_group. Adds lex (0 where it isn't looked at), bias, penalty (none where
    the overlap is whole) and rerank, their sum with the similarity."""
    o = options
    groups, tuis = o.biases()
    lex = X.jaccard(X.token_set(F.col("expanded")), X.token_set(F.col("prefterm"))) if o.lexical else F.lit(0.0)
    c = candidates.withColumn("lex", lex).withColumn("bias", _bias(groups, "semantic_group") + _bias(tuis, "tui"))
    penalty = F.when(F.col("lex") < 0.999, X.term_penalty(F.col("prefterm")) + X.span_penalty(F.col("raw"), F.col("prefterm"))).otherwise(0.0)
    c = c.withColumn("penalty", penalty if o.clinical_rerank else F.lit(0.0))
    weight = o.lexical_weight if o.top_k > 1 and o.rerank else 0.0
    return c.withColumn("rerank", F.col("score") + weight * F.col("lex") + F.col("bias") + F.col("penalty"))


def _bias(table: dict[str, float], column: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column)), F.lit(0.0)) if table else F.lit(0.0)


def choose(candidates: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """candidates: mention_id, rank, score, raw, expanded, prefterm, tui, semantic_group. One row a mention whose best similarity
    reaches threshold: rank, score, rerank_score, lex and top (the best similarity). The choice has the highest rerank score of those
    in the band; the first candidate keeps its bare similarity as a floor, which any, itself included, must beat."""
    o = options
    c = scored(candidates, o) if "rerank" not in candidates.columns else candidates
    c = c.withColumn("top", F.max("score").over(W.partitionBy("mention_id"))).filter(F.col("top") >= o.threshold)
    banded = o.rerank_margin >= 0 and (o.rerank or o.relation_rerank or o.clinical_rerank)
    band = (F.col("score") >= o.threshold) & ((F.col("score") >= F.col("top") - o.rerank_margin) if banded else F.lit(True))
    # order: rerank first, the earlier rank on ties; the floor (rank 0, bare similarity) wins ties against all
    beats = band & (F.round("rerank", 9) > F.round("top", 9))
    out = c.groupBy("mention_id").agg(F.max("top").alias("top"), F.max(F.when(F.col("rank") == 0, F.col("lex"))).alias("lex0"), F.max_by(F.struct("rank", "score", "rerank", "lex"), F.when(beats, F.struct(F.round("rerank", 9).alias("a"), (-F.col("rank")).alias("b")))).alias("x"))
    return out.select("mention_id", F.coalesce("x.rank", F.lit(0)).alias("rank"), F.coalesce("x.score", "top").alias("score"), F.coalesce("x.rerank", "top").alias("rerank_score"), F.coalesce("x.lex", "lex0").alias("lex"), "top")


def choose_again(picked: DataFrame, candidates: DataFrame, options: ExtractOptions) -> DataFrame:
    """The second pass. picked: of choose; candidates: scored, with relation_hits. Edges to what the sentence's other mentions chose
    raise a candidate of the band; it must beat the first choice, and doesn't replace one whose lexical overlap is whole."""
    o = options
    first = picked.select("mention_id", F.col("rank").alias("r0"), F.col("rerank_score").alias("x0"), F.col("lex").alias("l0"), "top")
    c = candidates.withColumn("raised", F.col("rerank") + o.relation_weight * F.col("relation_hits")).join(first, "mention_id")
    band = (F.col("score") >= o.threshold) & ((F.col("score") >= F.col("top") - o.rerank_margin) if o.rerank_margin >= 0 else F.lit(True))
    better = c.filter(band & (F.round("raised", 9) > F.round("x0", 9)) & ((F.col("l0") < 0.999) | (F.col("rank") == F.col("r0"))))
    best = better.groupBy("mention_id").agg(F.max_by(F.struct("rank", "score", "raised"), F.struct(F.round("raised", 9), -F.col("rank"))).alias("x"))
    return picked.join(best, "mention_id", "left").select("mention_id", F.coalesce("x.rank", "rank").alias("rank"), F.coalesce("x.score", "score").alias("score"), F.coalesce("x.raised", "rerank_score").alias("rerank_score"))


def relation_hits(candidates: DataFrame, chosen: DataFrame, edges: DataFrame, max_degree: int = 2000) -> DataFrame:
    """candidates: mention_id, sentence_id, rank, concept_row; chosen: sentence_id, mention_id, concept_row; edges: src, dst (repeats
    count). Adds relation_hits: edges to concepts chosen in the same sentence, the mention's own concept aside. Hubs, over
    max_degree, are cut before the join, so none is exploded."""
    degree = edges.groupBy("src").count().filter(F.col("count") <= max_degree).select("src")
    kept = edges.join(degree, "src")
    mine = chosen.select("mention_id", F.col("concept_row").alias("own"))
    context = chosen.select("sentence_id", F.col("concept_row").alias("dst")).distinct()
    hits = candidates.join(mine, "mention_id").join(kept, F.col("concept_row") == F.col("src")).join(context, ["sentence_id", "dst"]).filter("dst != own")
    counts = hits.groupBy("mention_id", "rank").agg(F.count("*").alias("relation_hits"))
    return candidates.join(counts, ["mention_id", "rank"], "left").withColumn("relation_hits", F.coalesce("relation_hits", F.lit(0)))
