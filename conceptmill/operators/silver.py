"""Silver labels: votes of annotators merged to spans, filtered pairs, deterministic samples."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as X
from .clusters import SHORT, joined, stretches

MERGED = "note_id long, start int, end int, text string, normalized string, label string, teachers array<string>, teacher_count int, max_score double, mean_score double, score double"


def _good(min_score: float, text_length: str | None, by_teacher: Mapping[str, float] | None) -> Column:
    least = F.lit(float(min_score))
    for name, score in (by_teacher or {}).items():
        least = F.when(F.col("teacher") == name, float(score)).otherwise(least)
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & ((F.col("end") <= F.col(text_length)) if text_length else F.lit(True))
    return F.coalesce((F.col("score") >= least) & inside & (F.trim("text") != ""), F.lit(False))


def marked(rows: DataFrame, min_score: float = 0.20, text_length: str | None = None, by_teacher: Mapping[str, float] | None = None) -> DataFrame:
    """rows (note_id, start, end, text, score, teacher, seq) with usable: the score is min_score at least, or what by_teacher says for
    its teacher, the span is in the note (of that length, if the column is given), the text isn't blank, and no usable row before
    has the same note, span, text in lower case and teacher. Rows of a note end in one partition, which merge can use."""
    good = _good(min_score, text_length, by_teacher)
    w = W.partitionBy("note_id", "start", "end", F.lower(F.trim("text")), "teacher", "__good").orderBy("seq")
    dealt = rows.repartition("note_id").withColumn("__good", good)
    return dealt.withColumn("usable", F.col("__good") & (F.row_number().over(w) == 1)).drop("__good")


def usable(rows: DataFrame, min_score: float = 0.20, text_length: str | None = None, by_teacher: Mapping[str, float] | None = None) -> DataFrame:
    """The rows that marked finds usable."""
    return marked(rows, min_score, text_length, by_teacher).filter("usable").drop("usable")


def _merging(overlap: float, bonus: float):
    class Merging:
        """Clusters that a later span may still join: [representative, teachers, best score, sum of scores, spans, last end]."""

        def __init__(self) -> None:
            self.near: list[list] = []

        def feed(self, columns: list[list], lo: int, hi: int, out: list[tuple]) -> None:
            near = self.near
            for start, end, score, teacher, text, normalized, label in zip(*[c[lo:hi] for c in columns], strict=True):
                # spans come in order of start: a cluster whose representative could only end before it is settled
                if near and any(c[5] <= start for c in near):
                    for c in near:
                        if c[5] <= start:
                            self.settle(c, out)
                    near = [c for c in near if c[5] > start]
                for c in near:
                    r = c[0]
                    inter = min(end, r[2]) - max(start, r[1])
                    if inter > 0 and inter / min(end - start, r[2] - r[1]) >= overlap:
                        if (-score, end - start, start) < (r[0], r[2] - r[1], r[1]):
                            c[0] = (-score, start, end, text, normalized, label)
                        c[1].add(teacher)
                        c[2], c[3], c[4], c[5] = max(c[2], score), c[3] + score, c[4] + 1, max(c[5], end)
                        break
                else:
                    near.append([(-score, start, end, text, normalized, label), {teacher}, score, score, 1, end])
            self.near = near

        def settle(self, c: list, out: list[tuple]) -> None:
            (_, start, end, text, normalized, label), names, top, total, n, _ = c
            plain = (normalized or text or "").strip()
            out.append((start, end, text, plain, (label or "").strip(), sorted(names), len(names), top, total / n, max(0.0, min(1.0, top + bonus * (len(names) - 1)))))

        def end(self, out: list[tuple]) -> None:
            for c in self.near:
                self.settle(c, out)

    return Merging


#: Rows that are looked at together in a task.
_CHUNK = 1 << 16
_ORDER = ["start", "end", "score", "teacher", "text", "normalized", "label"]


def _scanned(rows: DataFrame, overlap: float, bonus: float, dealt: bool, repeats: bool = False, columns: list[str] | None = None) -> DataFrame:
    """MERGED, n_raw, n_usable of rows (note_id, those of _ORDER; with repeats also seq, and a row that isn't usable has no start):
    clusters, and rows that are null but for note_id and the two counts. Rows are sorted once, by Spark; a task holds a chunk of them, the clusters of one long
    stretch, and the different votes of one span."""
    own = [c for c in _ORDER if c in rows.columns]
    rows = rows.withColumn("score", F.col("score").cast("double")).withColumn("note_id", F.col("note_id").cast("long"))
    spread = rows if dealt else rows.repartition("note_id")
    low = F.lower(F.trim("text"))
    # with repeats, those of one vote stand together, the first one before the others; the votes of a span are put in order later
    order = [low, F.col("teacher"), F.col("seq")] if repeats else [F.desc("score"), F.col("teacher"), F.col("text"), F.col("label")]
    ready = spread.sortWithinPartitions("note_id", "start", "end", *order).select("note_id", *own, *([F.when(F.octet_length("text") > F.char_length("text"), low).alias("low")] if repeats else []))
    every = StructType.fromDDL(f"{MERGED}, n_raw long, n_usable long")
    names = every.names
    kinds = StructType([f for f in every if columns is None or f.name in columns])
    arrow, merging = to_arrow_schema(kinds), _merging(overlap, bonus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of a stretch that the next chunk may go on with
        state, reach, at = None, 0, None  # a long stretch that is open: its clusters, its end and its note

        def done(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, state, reach, at
            n, before = rows.num_rows, held.num_rows if held is not None else 0
            if "normalized" not in rows.column_names:
                rows = rows.append_column("normalized", pa.nulls(n, pa.string()))
            rows = (pa.concat_tables([held, rows]) if before else rows).combine_chunks()
            held = None
            out: list[tuple] = []
            if repeats:
                keep = _firsts(rows)
                yield _counts(rows, keep, before, arrow)
                rows = rows.filter(pa.array(keep)).combine_chunks()
            if rows.num_rows:
                given = rows  # as Spark sorted them: repeats stand together in the next chunk, too
                rows = _ordered(rows) if repeats else rows
                change = _changes(rows, ["note_id"])
                note = np.cumsum(change) - 1
                start, end = (rows[c].to_numpy().astype(np.int64) for c in ("start", "end"))
                key = rows["note_id"][0].as_py()
                if state is not None and key != at:
                    state.end(out_ := [])
                    out += [(at, *x, None, None) for x in out_]
                    state = None
                new = stretches(note, start, end, reach if state is not None else None)
                heads = np.flatnonzero(new)
                upto = rows.num_rows
                if not last:
                    # the last stretch may go on: a short one waits whole, of a long one the votes of its last span
                    upto = int(heads[-1]) if len(heads) else 0
                    if rows.num_rows - upto > SHORT or not len(heads):
                        upto = int(np.flatnonzero(_changes(rows, ["note_id", "start", "end"]))[-1])
                    held = given.slice(upto)
                heads = heads[heads < upto]
                bounds = np.append(heads, upto)
                sizes = np.diff(bounds)
                if state is not None and bounds[0]:
                    state.feed(_lists(rows, 0, int(bounds[0])), 0, int(bounds[0]), out_ := [])
                    out += [(at, *x, None, None) for x in out_]
                    reach = max(reach, int(end[: bounds[0]].max()))
                if state is not None and len(heads):
                    state.end(out_ := [])
                    out += [(at, *x, None, None) for x in out_]
                    state = None
                if len(heads):
                    odd = pc.is_null(rows["teacher"]).to_numpy() | ~np.isfinite(rows["score"].to_numpy().astype(np.float64))
                    odd = np.add.reduceat(odd[:upto].astype(np.int64), heads) > 0
                    short = (sizes <= SHORT) & ~odd
                    cut = held is not None and held.num_rows > 0 and not new[upto]
                    short[-1] &= not cut
                    for k in np.flatnonzero(~short).tolist():
                        lo, hi = int(bounds[k]), int(bounds[k + 1])
                        own, key = merging(), rows["note_id"][lo].as_py()
                        own.feed(_lists(rows, lo, hi), 0, hi - lo, out_ := [])
                        if cut and k + 1 == len(heads):
                            state, reach, at = own, int(end[lo:hi].max()), key
                        else:
                            own.end(out_)
                        out += [(key, *x, None, None) for x in out_]
                    if short.any():
                        which = np.flatnonzero(np.repeat(short, sizes)) + int(heads[0])
                        ends = np.cumsum(sizes[short])
                        yield _clusters(rows.take(pa.array(which)), ends - sizes[short], sizes[short], overlap, bonus, arrow)
            if last and state is not None:
                state.end(out_ := [])
                out += [(at, *x, None, None) for x in out_]
            if out:
                made = dict(zip(names, zip(*out, strict=True), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

        got: list[pa.RecordBatch] = []
        for batch in batches:
            got.append(batch)
            if sum(b.num_rows for b in got) >= _CHUNK:
                yield from done(pa.Table.from_batches(got), False)
                got = []
        if got or held is not None or state is not None:
            yield from done(pa.Table.from_batches(got) if got else held.slice(0, 0), True)

    return ready.mapInArrow(run, kinds)


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where one of the keys differs from the row before."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for k in keys:
        c = rows[k].combine_chunks()
        if isinstance(c, pa.ChunkedArray):
            c = pa.concat_arrays(c.chunks)
        c = c if pa.types.is_integer(c.type) and not c.null_count else c.dictionary_encode(null_encoding="encode").indices
        c = c.to_numpy(zero_copy_only=False)
        out[1:] |= c[1:] != c[:-1]
    return out


def _firsts(rows: pa.Table) -> np.ndarray:
    """The rows that are usable and no repeat of the one before: of the same span and teacher, their texts equal in lower case. Spark's
    own lower case stands in low for texts beyond ASCII."""
    good = pc.is_valid(rows["start"]).to_numpy().astype(bool)
    at = np.flatnonzero(good)
    if len(at):
        apart = _changes(rows.take(pa.array(at)), ["note_id", "start", "end", "teacher"])
        again = np.flatnonzero(~apart)
        both = np.unique(np.concatenate([again, again - 1]))
        low = {k: x["low"] if x["low"] is not None else x["text"].strip(" ").lower() for k, x in zip(both.tolist(), rows.take(pa.array(at[both])).select(["text", "low"]).to_pylist(), strict=True)}
        apart[again] = [low[k] != low[k - 1] for k in again.tolist()]
        good[at] = apart
    return good


def _counts(rows: pa.Table, keep: np.ndarray, before: int, schema: pa.Schema) -> pa.RecordBatch:
    """n_raw and n_usable of each note's rows behind the first before, which were counted."""
    new, kept = rows.slice(before), keep[before:]
    heads = np.flatnonzero(_changes(new, ["note_id"]))
    raw = np.diff(np.append(heads, new.num_rows))
    usable_ = np.add.reduceat(kept.astype(np.int64), heads) if len(heads) else raw
    given = {"note_id": new["note_id"].take(pa.array(heads)).combine_chunks(), "n_raw": pa.array(raw, pa.int64()), "n_usable": pa.array(usable_, pa.int64())}
    return _record(given, len(heads), schema)


def _record(given: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.Table.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema).combine_chunks().to_batches()[0] if n else pa.RecordBatch.from_pylist([], schema)


def _ordered(rows: pa.Table) -> pa.Table:
    """The votes of each span by score, the highest first, teacher, text and label."""
    change = _changes(rows, ["note_id", "start", "end"])
    heads = np.flatnonzero(change)
    sizes = np.diff(np.append(heads, len(change)))
    if not (sizes > 1).any():
        return rows
    order = np.arange(len(change))
    many = np.flatnonzero(np.repeat(sizes > 1, sizes))
    held = rows.take(pa.array(many)).select(["score", "teacher", "text", "label"]).to_pylist()
    word = lambda x: (x is not None, x or "")
    keys = [(x["score"] == x["score"], -x["score"], word(x["teacher"]), word(x["text"]), word(x["label"])) for x in held]
    lo = 0
    for n in sizes[sizes > 1].tolist():
        order[many[lo : lo + n]] = many[sorted(range(lo, lo + n), key=keys.__getitem__)]
        lo += n
    return rows.take(pa.array(order)).combine_chunks()


def _lists(rows: pa.Table, lo: int, hi: int) -> list[list]:
    part = rows.slice(lo, hi - lo)
    return [part[c].to_pylist() for c in _ORDER]


def _bare(words: pa.ChunkedArray) -> pa.Array:
    """Each word without white space at its ends, none for null; each distinct one is stripped once."""
    coded = pa.concat_arrays(words.cast(pa.string()).chunks or [pa.array([], pa.string())]).fill_null("").dictionary_encode()
    return pa.array([w.strip() for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _clusters(rows: pa.Table, heads: np.ndarray, sizes: np.ndarray, overlap: float, bonus: float, schema: pa.Schema) -> pa.RecordBatch:
    """The clusters of rows, which are whole stretches."""
    start, end = (rows[c].to_numpy().astype(np.int64) for c in ("start", "end"))
    score = rows["score"].to_numpy().astype(np.float64)
    own, best = joined(start, end, score, heads, sizes, overlap)
    n = len(best)
    top = np.full(n, -np.inf)
    np.maximum.at(top, own, score)
    coded = pa.concat_arrays(rows["teacher"].chunks).dictionary_encode()
    names = coded.dictionary.cast(pa.string()).to_pylist()
    ranks = np.empty(len(names), np.int64)
    ranks[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    pairs = np.unique(own * len(names) + ranks[coded.indices.to_numpy()])
    count = np.bincount(pairs // len(names), minlength=n)
    r = rows.select(["note_id", "start", "end", "text", "normalized", "label"]).take(pa.array(best)).combine_chunks()
    given = {k: pa.concat_arrays(r[k].chunks) for k in ("note_id", "start", "end", "text")} | {"teacher_count": pa.array(count, pa.int32())}
    if "teachers" in schema.names:
        given["teachers"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(sorted(names), pa.string()).take(pa.array(pairs % len(names))))
    if "normalized" in schema.names:
        said = pc.if_else(pc.equal(pc.fill_null(r["normalized"].cast(pa.string()), ""), ""), r["text"].cast(pa.string()), r["normalized"].cast(pa.string()))
        given["normalized"] = _bare(said)
    if "label" in schema.names:
        given["label"] = _bare(r["label"])
    given |= {"max_score": pa.array(top), "mean_score": pa.array(np.bincount(own, weights=score, minlength=n) / np.bincount(own, minlength=n)), "score": pa.array(np.clip(top + bonus * (count - 1), 0.0, 1.0))}
    return _record(given, n, schema)


def merge(rows: DataFrame, overlap: float = 0.80, bonus: float = 0.08, dealt: bool = False) -> DataFrame:
    """Spans of a note, in order, each joined to the first cluster whose present representative it overlaps enough. The
    representative is the member of the best score, then the shortest, then the first; it changes as members join, so this is a
    fold in order and not a matter of connected components. Its text, normalised text (where rows have a column normalized; else, and
    where that is empty, the text) and label are the cluster's. Stretches of few spans that touch no other are taken side by side,
    longer ones by a loop, which holds the clusters that reach a place of one note. dealt: rows come from marked or usable, so that the
    rows of a note are in one partition."""
    return _scanned(rows, overlap, bonus, dealt).drop("n_raw", "n_usable")


def scan(rows: DataFrame, min_score: float = 0.20, text_length: str | None = None, by_teacher: Mapping[str, float] | None = None, overlap: float = 0.80, bonus: float = 0.08, counts: bool = True, columns: list[str] | None = None) -> DataFrame:
    """What merge makes of the usable rows (see marked), from one shuffle and one sort; with counts also rows that are null but for
    note_id, n_raw and n_usable, whose sums are a note's numbers of rows and of usable ones. columns: those to be made, if not all."""
    fields = [c for c in ("note_id", *_ORDER, "seq") if c in rows.columns]
    good = _good(min_score, text_length, by_teacher)
    if counts:
        # of a row that isn't usable only its note is of interest
        given = rows.withColumn("__good", good)
        given = given.select("note_id", *[F.when(F.col("__good"), F.col(c)).alias(c) for c in fields if c != "note_id"])
    else:
        given = rows.filter(good).select(*fields)
    found = _scanned(given, overlap, bonus, False, True, columns if counts or columns is None else [*columns, "teacher_count"])
    return found if counts else found.filter("teacher_count is not null").drop("n_raw", "n_usable")


#: The columns of scan that scan_stats reads.
STATS = ["note_id", "text", "teacher_count", "max_score", "n_raw", "n_usable"]


def scan_stats(scanned: DataFrame, min_teachers: int = 2, high_confidence: float = 0.9) -> DataFrame:
    """note_stats of what scan found, with its counts."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return scanned.groupBy("note_id").agg(total("n_raw", "mentions_raw"), total("n_usable", "mentions_post"), F.count("teacher_count").alias("mentions_merged"), total(keeps(min_teachers, high_confidence).cast("int"), "mentions_kept"))


def keeps(min_teachers: int = 2, high_confidence: float = 0.9) -> Column:
    """Of merged spans: enough teachers or one sure one found it, and it is neither a section header nor a short span that isn't allowed."""
    found = (F.col("teacher_count") >= min_teachers) | (F.col("max_score") >= high_confidence)
    return found & X.allowed_span(F.col("text")) & ~X.is_section_header(F.col("text"))


def kept(merged: DataFrame, min_teachers: int = 2, high_confidence: float = 0.9) -> DataFrame:
    return merged.filter(keeps(min_teachers, high_confidence))


def note_stats(marks: DataFrame, merged: DataFrame, min_teachers: int = 2, high_confidence: float = 0.9) -> DataFrame:
    """note_id, mentions_raw, mentions_post, mentions_merged, mentions_kept, of marked rows (see marked; staged, as both sides read
    them) and of what their usable ones were merged to."""
    names = ("mentions_raw", "mentions_post", "mentions_merged", "mentions_kept")
    zero = F.lit(0)
    votes = marks.select("note_id", F.lit(1).alias(names[0]), F.col("usable").cast("int").alias(names[1]), zero.alias(names[2]), zero.alias(names[3]))
    spans = merged.select("note_id", zero.alias(names[0]), zero.alias(names[1]), F.lit(1).alias(names[2]), keeps(min_teachers, high_confidence).cast("int").alias(names[3]))
    return votes.union(spans).groupBy("note_id").agg(*[F.sum(n).alias(n) for n in names])


def note_rows(merged: DataFrame) -> DataFrame:
    """note_id, mentions: an array of a note's merged spans by start, end and score, the highest first."""
    fields = [c for c in merged.columns if c not in ("note_id", "start", "end")]
    one = F.struct("start", "end", (-F.col("score")).alias("__s"), F.to_json(F.struct(*fields)).alias("__j"), F.struct(*fields).alias("__f"))
    mentions = F.transform(F.array_sort(F.collect_list(one)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), *[m["__f"][f].alias(f) for f in fields]))
    return merged.groupBy("note_id").agg(mentions.alias("mentions"))


def embeddable(mentions: DataFrame, min_chars: int = 3, max_chars: int = 80, min_score: float = 0.0) -> DataFrame:
    """Mentions (text, normalized, score) that may be linked, with text_for_embed: the normalised text, else the text."""
    t = F.coalesce(F.nullif(F.trim(F.coalesce("normalized", F.lit(""))), F.lit("")), F.trim("text"))
    return mentions.withColumn("text_for_embed", t).filter(F.char_length("text_for_embed").between(min_chars, max_chars) & (F.coalesce("score", F.lit(0.0)) >= min_score) & (F.col("text_for_embed") != ""))


def linked(candidates: DataFrame, min_sim: float = 0.0, min_lex: float = 0.0, rerank: bool = True, lexical_weight: float = 0.30, margin: float = 0.04) -> DataFrame:
    """candidates: mention_id, rank, sim, text_for_embed, preferred_term and what belongs to them. A row a mention: its best candidate by similarity
    and, with rerank, lexical overlap (lex) inside the band, the earlier of equal ones; dropped below min_sim or, if above 0, min_lex."""
    c = candidates.withColumn("lex", lexical(F.col("text_for_embed"), F.col("preferred_term")))
    top = F.max("sim").over(W.partitionBy("mention_id"))
    band = F.col("sim") >= top - margin if rerank and margin >= 0 else F.lit(True)
    c = c.withColumn("__in", band if rerank else F.col("rank") == 0).filter("__in")
    score = F.round(F.col("sim") + (lexical_weight * F.col("lex") if rerank else 0.0), 9)
    c = c.withColumn("__n", F.row_number().over(W.partitionBy("mention_id").orderBy(F.desc(score), "rank"))).filter("__n = 1").drop("__n", "__in")
    return c.filter((F.col("sim") >= min_sim) & ((F.col("lex") >= min_lex) if min_lex > 0 else F.lit(True)))


def with_base(base: DataFrame, silver: DataFrame) -> DataFrame:
    """Training pairs (mention, cui, sim): the base ones, then the silver ones."""
    return base.unionByName(silver)


def pairs(rows: DataFrame, min_sim: float, min_lex: float, min_teachers: int, min_chars: int, max_chars: int) -> DataFrame:
    """Training pairs; a teacher_count of 0 means that it isn't known, and passes. See ordinal.first for the first so many of them."""
    n = F.char_length(F.trim("text"))
    good = (F.col("sim") >= min_sim) & (F.col("lex") >= min_lex) & ((F.col("teacher_count") == 0) | (F.col("teacher_count") >= min_teachers)) & (n >= min_chars) & (n <= max_chars)
    w = W.partitionBy(F.lower(F.trim("text")), "cui").orderBy("seq")
    return rows.filter(good).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 13) -> DataFrame:
    """n rows by the MD5 of seed and key: the same rows whenever, wherever."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def lexical(a, b):
    """Overlap of words; 0 if either has none."""
    return X.jaccard(X.space_tokens(a), X.space_tokens(b), 0.0)
