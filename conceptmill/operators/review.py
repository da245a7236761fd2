"""Review sets and their scores, run comparisons, retrieval metrics, and the viewer's operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def margin(candidates: Column) -> Column:
    """Between the two best rerank scores; 999 if there is no second."""
    s = F.sort_array(F.transform(candidates, lambda c: c["rerank_score"]), asc=False)
    return F.when(F.size(s) < 2, F.lit(999.0)).otherwise(s[0] - s[1])


#: Terms that a reviewer should see; as the rules stand, the pattern finds backslashes and so hardly anything: see fix below.
_WEIRD = r"(?i)\bctcae\b|\brndx\b|\breported\s+by\s+patient\b|\bhow\s+often\b|\bquestion\b|\bwere\s+you\b|^when\b"


def weird(term: Column, fix: bool = False) -> Column:
    """Whether a term is one of a form or a grading scale. Without fix nothing but a leading `when` and a backslash counts."""
    return F.coalesce(term, F.lit("")).rlike(_WEIRD if fix else r"(?i)^when\\b")


def own_candidate(candidates: Column, cui: Column) -> Column:
    """The first candidate with the predicted cui, and null if there is none."""
    return F.get(F.filter(candidates, lambda c: c["cui"] == cui), F.lit(0))


def tricky(extraction: Column, fix_weird_terms: bool = False) -> Column:
    """How much a row deserves a review. extraction: cui, preferred_term, semantic_group, tui, score, candidates (cui, preferred_term,
    lex, rerank_score)."""
    e, cands = extraction, extraction["candidates"]
    m, at = margin(cands), F.array_position(F.transform(cands, lambda c: c["cui"]), e["cui"])
    lex = F.coalesce(own_candidate(cands, e["cui"])["lex"], F.lit(0.0))
    other = F.exists(F.filter(cands, lambda c, i: i + 1 != at), lambda c: c["lex"] >= 0.50)
    return (
        F.when(weird(e["preferred_term"], fix_weird_terms), 10).otherwise(0) + F.when(F.exists(F.slice(cands, 1, 15), lambda c: weird(c["preferred_term"], fix_weird_terms)), 5).otherwise(0)
        + F.when(m < 0.010, 5).when(m < 0.020, 3).when(m < 0.040, 1).otherwise(0)
        + F.when((lex < 0.20) & other, 2).otherwise(0) + F.when(e["score"] < 0.55, 1).otherwise(0)
        + F.when(e["semantic_group"].isin("CONC", "UNKN"), 2).otherwise(0) + F.when(F.upper(e["tui"]) == "T170", 2).otherwise(0)
    )


def with_candidates(rows: DataFrame, candidates: str = "candidates") -> DataFrame:
    """rows, or an error if none has candidates."""
    if rows.filter(F.size(candidates) > 0).isEmpty():
        raise ValueError("no row has candidates: extract with include_candidates")
    return rows


def _tie(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def review_sample(rows: DataFrame, n: int, key: str, stratum: str = "note_type", seed: int = 13) -> DataFrame:
    """rows: key, stratum, tricky, score. About n // strata rows (one at least) of each stratum: 67 % of them tricky (5 or more), the rest of low
    score, then others; then, over all, what is missing to n: tricky ones, those of low score, others, the trickiest first. Ties by MD5 of seed and key."""
    strata = max(1, rows.select(stratum).distinct().count())
    per = max(1, n // strata)
    c = rows.withColumn("__t", _tie(key, seed)).withColumn("__class", F.when(F.col("tricky") >= 5, 0).when(F.col("score") < 0.55, 1).otherwise(2))
    c = c.withColumn("__tricky_at", F.row_number().over(W.partitionBy(stratum, "__class").orderBy("__t")))
    n_tricky = F.least(F.sum((F.col("__class") == 0).cast("int")).over(W.partitionBy(stratum)), F.lit(round(per * 0.67)))
    c = c.withColumn("__n_tricky", n_tricky)
    # after the tricky ones, low scores and others share what is left of the stratum's part
    rest = F.row_number().over(W.partitionBy(stratum, F.col("__class") > 0).orderBy("__t"))
    c = c.withColumn("__rest_at", rest)
    first = F.when(F.col("__class") == 0, F.col("__tricky_at") <= F.col("__n_tricky")).otherwise(F.col("__rest_at") <= per - F.col("__n_tricky"))
    c = c.withColumn("__first", first.cast("int"))
    out = c.orderBy(F.desc("__first"), F.when(F.col("__first") == 0, F.col("__class")), F.when(F.col("__first") == 0, -F.col("tricky")), "__t").limit(n)
    return out.select(*rows.columns)


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key: the last row's values at the first row's place."""
    values = [c for c in rows.columns if c not in (*keys, seq)]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("v"), F.min(seq).alias(seq))
    return out.select(*keys, "v.*", seq)


def _joined(review: DataFrame, run: DataFrame, seq: str) -> DataFrame:
    keys = ["note_file", "start", "end"]
    unset = lambda df: df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in keys[1:]})
    last = unset(run).groupBy(*keys).agg(F.max_by(F.struct("note_type", "cui", "candidates"), seq).alias("r"))
    # spans may be unset, by null or -1; unset ones of a note match each other
    review = unset(review)
    j = review.join(last, keys, "left")
    gold, cui = F.trim(F.coalesce("gold_cui", F.lit(""))), F.coalesce("r.cui", F.lit(""))
    none = F.upper(gold).isin("NONE", "NO", "NULL", "N/A")
    return j.select(
        F.coalesce("r.note_type", review["note_type"], F.lit("Unknown")).alias("note_type"), (gold != "").alias("labeled"), none.alias("none"), (cui == "").alias("missing"),
        F.when(none, cui == "").otherwise((cui != "") & (cui == gold)).alias("right"), F.coalesce(F.array_contains("r.candidates", gold), F.lit(False)).alias("in_topk"),
    )


def scores(review: DataFrame, run: DataFrame, seq: str = "seq") -> DataFrame:
    """review: note_file, start, end, note_type, gold_cui (a cui, a word for none, or empty); run: note_file, start, end, note_type, cui,
    candidates (cuis), seq. One row of counters: of a span's rows in the run the last counts; gold among the candidates counts only
    where something was predicted."""
    c = F.col
    real = c("labeled") & ~c("none")
    out = _joined(review, run, seq).agg(
        F.count("*").alias("n_rows"), F.count_if("labeled").alias("labeled"), F.count_if(real).alias("labeled_positive"), F.count_if(c("labeled") & c("none")).alias("labeled_none"),
        F.count_if(c("labeled") & c("right")).alias("correct"), F.count_if(real & c("right")).alias("correct_positive"), F.count_if(c("labeled") & c("none") & ~c("missing")).alias("false_positives"),
        F.count_if(real & c("missing")).alias("false_negatives"), F.count_if(real & ~c("missing") & ~c("right")).alias("wrong_link"), F.count_if(real & ~c("missing") & c("in_topk")).alias("gold_in_topk"),
    )
    share = lambda a, b: F.when(c(b) > 0, F.round(c(a) / c(b), 6))
    return out.withColumn("accuracy", share("correct", "labeled")).withColumn("positive_accuracy", share("correct_positive", "labeled_positive"))


def scores_by_type(review: DataFrame, run: DataFrame, seq: str = "seq") -> DataFrame:
    """note_type, correct, labeled, accuracy; to be shown by labeled descending, then type."""
    out = _joined(review, run, seq).filter("labeled").groupBy("note_type").agg(F.count_if("right").alias("correct"), F.count("*").alias("labeled"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("labeled"), 6))


def run_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    j = a.select(*keys, F.col("cui").alias("a_cui")).join(b.select(*keys, F.col("cui").alias("b_cui")), keys, "full_outer")
    both = F.col("a_cui").isNotNull() & F.col("b_cui").isNotNull()
    return j.agg(F.count_if(both).alias("overlap"), F.count_if(F.col("b_cui").isNull()).alias("base_only"), F.count_if(F.col("a_cui").isNull()).alias("new_only"), F.count_if(both & (F.col("a_cui") != F.col("b_cui"))).alias("changed"))


def retrieval(found: DataFrame, k: int) -> DataFrame:
    """found: query_id, rank (from 0), hit. hit@1, hit@k and the mean reciprocal rank within k."""
    each = found.groupBy("query_id").agg(F.min(F.when(F.col("hit") & (F.col("rank") < k), F.col("rank"))).alias("r"))
    return each.agg(F.round(F.avg((F.coalesce("r", F.lit(99)) == 0).cast("int")), 6).alias("hit_1"), F.round(F.avg(F.col("r").isNotNull().cast("int")), 6).alias("hit_k"), F.round(F.avg(F.coalesce(1 / (F.col("r") + 1), F.lit(0.0))), 6).alias("mrr"))


def non_overlapping(spans: Column) -> Column:
    """Spans (start, end, ...) in order of start, the longer first, each that begins before the last kept one's end skipped; empty
    ones and those before the text are left out (see view.valid for those past its end). For the few spans that a row of a page has:
    each kept one copies the kept ones before it. fold.apart does the same over rows, for any number."""
    good = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]))
    ordered = F.array_sort(F.transform(good, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"))))
    zero = F.struct(F.lit(-1).alias("upto"), F.array().cast("array<struct<start:int,neg_end:int>>").alias("out"))
    kept = F.aggregate(ordered, zero, lambda acc, s: F.when(s["start"] >= acc["upto"], F.struct((-s["neg_end"]).alias("upto"), F.array_append(acc["out"], s).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (-s["neg_end"]).alias("end")))
