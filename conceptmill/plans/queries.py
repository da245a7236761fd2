"""The queries of the domain operators over the test tables, each beside the DuckDB SQL that it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..operators import concepts as C
from ..operators import dictionary, etl, evaluate, extract, fold, ordinal, rerank, review, silver, training, vector, vector_index, view
from ..options import ExtractOptions
from ..sources import json_arrays, npy
from ..sources import terminology as T
from ..staging import shared_dir, spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- notes -----------------------------------------------------------------------------------------------------

#: Openings of notes, dealt by doc_id; they exercise every context rule.
OPENINGS = [
    "Patient denies HTN", "Family history of DM and CHF", "No evidence of COPD", "Severe left knee pain", "Assessment: HTN, DM, COPD", "Denies chest pain or shortness of breath at rest",
    "Possible pulmonary embolism", "Mother had breast cancer", "History of asthma", "Plan: none", "BP 120/80", "Acute mildly bilateral effusion", "Fam hx: stroke", "FHX - gout",
    "There is no fever", "Without rash", "Rule out sepsis", "R/O DVT of the leg", "Concern for anemia", "Treated with aspirin 81", "Pt reports of nausea", "She complains of dizziness",
    "He has chronic cough", "Patient is a 65 year old with HTN and chronic CKD", "Negative for edema", "No acute distress", "Family hx unremarkable", "the 12 trace edema 3.5",
]
_N = len(OPENINGS)
_VALUES = ", ".join("('" + o + f"', {k})" for k, o in enumerate(OPENINGS))
_NOTES = f"(SELECT doc_id AS note_id, source AS note_type, opening || '. ' || coalesce(text, '') AS text FROM documents JOIN (VALUES {_VALUES}) AS o(opening, k) ON doc_id % {_N} = k)"


def notes(spark: SparkSession, d: str) -> DataFrame:
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % _N + 1).cast("int"))
    return t(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("note_type"), F.concat(opening, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))


_SENT = r"""
parts AS (SELECT note_id, unnest(regexp_extract_all(text, '[^.;!\n]+|[.;!\n]+')) AS part, generate_subscripts(regexp_extract_all(text, '[^.;!\n]+|[.;!\n]+'), 1) AS i FROM notes WHERE length(trim(text)) > 3),
placed AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM parts),
sents AS (SELECT note_id, CAST(pos + length(part) - length(regexp_replace(part, '^\s+', '')) AS INT) AS start, regexp_replace(regexp_replace(part, '^\s+', ''), '\s+$', '') AS sentence FROM placed WHERE NOT regexp_matches(part, '^[.;!\n]') AND length(regexp_replace(regexp_replace(part, '^\s+', ''), '\s+$', '')) > 3)"""


@query(f"WITH notes AS {_NOTES}, {_SENT} SELECT note_id, start, CAST(start + length(sentence) AS INT) AS \"end\", sentence FROM sents")
def sentence_spans(spark, d):
    return extract.sentences(notes(spark, d)).select("note_id", "start", "end", "sentence")


def _rules(value) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(sentence, '(?i){p}') THEN {value(p, a, s)}" for p, a, s in K.CONTEXT_RULES) + " END"


_lit = lambda x: f"'{x}'" if x else "NULL"
_PREFIX = _rules(lambda p, a, s: f"regexp_extract(sentence, '(?i){p}')")


@query(f"WITH notes AS {_NOTES}, {_SENT}, c AS (SELECT *, coalesce({_PREFIX}, '') AS p FROM sents) SELECT note_id, start, CASE WHEN length(trim(p)) <= 80 THEN p ELSE '' END AS prefix, {_rules(lambda p, a, s: _lit(a))} AS assertion, {_rules(lambda p, a, s: _lit(s))} AS subject FROM c")
def context_labels(spark, d):
    return extract.sentences(notes(spark, d)).select("note_id", "start", "prefix", "assertion", "subject")


@query()
def note_mentions(spark, d):
    return extract.note_mentions(spread(notes(spark, d)))


_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)" + K.SEVERITY + "', ' ', 'g'), '(?i)" + K.LATERALITY + "', ' ', 'g'), '(?i)" + K.TEMPORALITY + r"', ' ', 'g'), '\s+', ' ', 'g'))"
_NORM = rf"trim(regexp_replace(trim(regexp_replace(regexp_replace({_STRIP}, '(?i)^(?:any|some|the|a|an)\s+', ''), '^(?:\d{{1,4}}\s+)+', '')), '\s+\d+(?:\.\d+)?\s*$', ''))"


@query(f"WITH notes AS {_NOTES}, {_SENT}, x AS (SELECT note_id, start, sentence AS s FROM sents) SELECT note_id, start, nullif(regexp_replace(lower(regexp_extract(s, '(?i){K.SEVERITY}', 1)), 'ly$', ''), '') AS severity, nullif(replace(lower(regexp_extract(s, '(?i){K.LATERALITY}')), '\\', '/'), '') AS laterality, nullif(lower(regexp_extract(s, '(?i){K.TEMPORALITY}', 1)), '') AS temporality, {_NORM} AS normalized FROM x")
def modifiers(spark, d):
    s = F.col("sentence")
    return extract.sentences(notes(spark, d)).select("note_id", "start", X.severity(s).alias("severity"), X.laterality(s).alias("laterality"), X.temporality(s).alias("temporality"), X.without_modifiers(s).alias("normalized"))


_DICT = ", ".join(f"('{k}', '{v}')" for k, v in K.ABBREVIATIONS.items())


@query(f"WITH notes AS {_NOTES}, p AS (SELECT note_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')) AS part, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), 1) AS i FROM notes) SELECT note_id, string_agg(CASE WHEN v IS NOT NULL AND (length(part) > 2 OR part = upper(part)) THEN v ELSE part END, '' ORDER BY i) AS expanded FROM p LEFT JOIN (VALUES {_DICT}) AS d(k, v) ON k = upper(part) GROUP BY note_id")
def abbreviation_expansion(spark, d):
    return notes(spark, d).select("note_id", X.expand(F.col("text")).alias("expanded"))


_TOKENS = r"tok AS (SELECT note_id, part, i, CAST(coalesce(sum(length(part)) OVER (PARTITION BY note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM (SELECT note_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+')) AS part, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+'), 1) AS i FROM notes))"


@query(f"WITH notes AS {_NOTES}, {_TOKENS} SELECT note_id, start, CAST(start + length(part) AS INT) AS \"end\", part AS original, v AS expanded FROM tok JOIN (VALUES {_DICT}) AS d(k, v) ON k = upper(part) WHERE length(part) > 2 OR part = upper(part)")
def expansion_offsets(spark, d):
    return notes(spark, d).select("note_id", F.explode(X.expansions(F.col("text"))).alias("x")).select("note_id", "x.start", "x.end", "x.original", "x.expanded")


def _dictionary(spark):
    return dictionary.keys_of(spark.createDataFrame(list(K.ABBREVIATIONS.items()), "key string, value string"))


@query(ORACLE["abbreviation_expansion"])
def dictionary_expansion(spark, d):
    """As abbreviation_expansion, with the dictionary as a table."""
    return dictionary.expand(notes(spark, d), _dictionary(spark))


@query(ORACLE["expansion_offsets"])
def dictionary_offsets(spark, d):
    return dictionary.expansions(notes(spark, d), _dictionary(spark)).select("note_id", "start", "end", "original", "expanded")


@query(f"WITH notes AS {_NOTES}, {_TOKENS} SELECT note_id, start, CAST(start + length(part) AS INT) AS \"end\", part AS text, coalesce(v, part) AS normalized FROM tok LEFT JOIN (VALUES {_DICT}) AS d(k, v) ON k = upper(part) WHERE regexp_full_match(part, '[A-Za-z0-9]{{2,12}}') AND regexp_matches(part, '[A-Z0-9]') AND upper(part) IN (" + ", ".join(f"'{x}'" for x in K.SHORT_SPANS) + ")")
def abbreviation_spans(spark, d):
    return notes(spark, d).select("note_id", F.explode(X.abbreviation_spans(F.col("text"))).alias("x")).select("note_id", "x.start", "x.end", "x.text", "x.normalized")


_LOOKED = ["' htn '", "'Dm'", "'xyz'", "'COPD'"]


@query(f"SELECT p_partkey, v IS NOT NULL AS known, v AS expansion FROM (SELECT p_partkey, [{', '.join(_LOOKED)}][p_partkey % 4 + 1] AS term FROM part) LEFT JOIN (VALUES {_DICT}) AS d(k, v) ON k = upper(trim(term))")
def term_lookups(spark, d):
    term = F.element_at(F.array(*[F.lit(x.strip("'")) for x in _LOOKED]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", X.is_abbreviation(term).alias("known"), X.expansion_of(term).alias("expansion"))


_PAIR = "SELECT a.p_partkey, a.p_name AS a, b.p_name || ' ' || b.p_type AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _pair(spark, d):
    p = t(spark, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("b"))
    return p.select("p_partkey", F.col("p_name").alias("a")).join(b, "p_partkey")


_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_WS = r"list_distinct(list_filter(regexp_split_to_array(lower(replace({0}, '/', ' ')), '\s+'), lambda x: x <> ''))"


@query(f"WITH p AS ({_PAIR}), x AS (SELECT p_partkey, {_TOK.format('a')} AS ta, {_TOK.format('b')} AS tb, {_WS.format('a')} AS wa, {_WS.format('b')} AS wb FROM p) SELECT p_partkey, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS jaccard_a, round(len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))), 6) AS jaccard_b FROM x")
def token_jaccard(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pair(spark, d).select("p_partkey", F.round(X.jaccard(X.token_set(a), X.token_set(b)), 6).alias("jaccard_a"), F.round(silver.lexical(a, b), 6).alias("jaccard_b"))


_TERMS = ["Pain CTCAE", "Reported by patient question how often were you sad", "When did it start", "Short", "Chronic obstructive pulmonary disease with acute exacerbation", "RNDX code", "Patient position"]
_TERM = "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_TERMS)) + " END"
_SPAN = "substring(p_name, 1, CAST(p_partkey % 13 AS INT))"
_PEN = " + ".join(f"CASE WHEN regexp_matches(term, '(?i){p}') THEN {w} ELSE 0 END" for p, w in K.TERM_PENALTIES)


@query(f"WITH x AS (SELECT p_partkey, {_TERM} AS term, trim({_SPAN}) AS span FROM part), y AS (SELECT *, len({_TOK.format('span')}) AS ns, len({_TOK.format('term')}) AS nt FROM x) SELECT p_partkey, round({_PEN}, 6) AS term_penalty, CASE WHEN length(span) = 0 THEN 0 WHEN ns <= 1 AND nt >= 5 THEN -0.05 WHEN ns <= 2 AND nt >= 7 THEN -0.04 WHEN length(span) <= 6 AND length(term) >= 30 THEN -0.03 WHEN length(span) <= 10 AND length(term) >= 45 THEN -0.02 ELSE 0 END::DOUBLE AS span_penalty FROM y")
def penalties(spark, d):
    term = F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    x = t(spark, d, "part").select("p_partkey", term.alias("term"), F.trim(F.substr("p_name", F.lit(1), (F.col("p_partkey") % 13).cast("int"))).alias("span"))
    return x.select("p_partkey", F.round(X.term_penalty(F.col("term")), 6).alias("term_penalty"), X.span_penalty(F.col("span"), F.col("term")).alias("span_penalty"))


@query("SELECT p_partkey, printf('C%07d', p_partkey) AS cui, printf('T%03d', CAST(p_size AS BIGINT)) AS tui, CAST(p_partkey AS INT) AS parsed, CASE WHEN p_retailprice % 1 < 0.3 THEN 'low' ELSE CASE WHEN p_retailprice % 1 < 0.55 THEN 'low' WHEN p_retailprice % 1 >= 0.70 THEN 'high' ELSE 'mid' END END AS bucket FROM part")
def code_formats(spark, d):
    k = X.cui_text(F.col("p_partkey"))
    return t(spark, d, "part").select("p_partkey", k.alias("cui"), X.tui_key(F.concat(F.lit(" t"), F.col("p_size").cast("string"))).alias("tui"), X.cui_of(k).alias("parsed"), X.score_bucket(F.col("p_retailprice") % 1).alias("bucket"))


_HEAD = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(h)), '\s*/\s*', '/', 'g'), ':+$', ''), '\s+', ' ', 'g')"
_SPLIT_LINES = f"(SELECT note_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS h FROM (SELECT note_id, regexp_split_to_array(text, '[\\n:.]') AS l FROM {_NOTES}))"


@query(f"SELECT note_id, CAST(k AS INT) AS k, {_HEAD} AS header, {_HEAD} IN (" + ", ".join(f"'{h}'" for h in K.SECTION_HEADERS) + ") AS is_header, length(regexp_replace(h, '[^A-Za-z0-9]', '', 'g')) >= 4 OR upper(regexp_replace(h, '[^A-Za-z0-9]', '', 'g')) IN (" + ", ".join(f"'{h}'" for h in K.SHORT_SPANS) + f") AS allowed FROM {_SPLIT_LINES}")
def headers_and_short_spans(spark, d):
    """What notes have between line ends, colons and full stops, as headers and as spans."""
    each = notes(spark, d).select("note_id", F.posexplode(F.split("text", r"[\n:.]")).alias("k", "h"))
    h = F.col("h")
    return each.select("note_id", "k", X.normal_header(h).alias("header"), X.is_section_header(h).alias("is_header"), X.allowed_span(h).alias("allowed"))


@query(r"SELECT doc_id, CASE WHEN regexp_extract(text, '^(?:[^.;!\n]*[.;!\n]+){3}') = '' THEN text ELSE regexp_extract(text, '^(?:[^.;!\n]*[.;!\n]+){3}') END AS head, substring(text, 21, 80) AS left_ctx, substring(text, 101, 20) AS span, substring(text, 121, 80) AS right_ctx FROM documents")
def head_and_window(spark, d):
    x = t(spark, d, "documents").withColumn("w", X.window(F.col("text"), F.lit(100), F.lit(120)))
    return x.select("doc_id", X.first_sentences(F.col("text"), 3).alias("head"), F.col("w.left").alias("left_ctx"), F.col("w.span").alias("span"), F.col("w.right").alias("right_ctx"))


# --- vectors ---------------------------------------------------------------------------------------------------

_TOPK = "SELECT q.vec_id AS query_id, e.vec_id AS concept_row, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) - 1 AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0"


def _topk(spark, d, k=8):
    e = t(spark, d, "embeddings")
    return vector.exact_topk(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("concept_row"), F.col("embedding").alias("v")), k)


@query(f"SELECT query_id, CAST(rank AS INT) AS rank, concept_row, round(score, 6) AS score FROM ({_TOPK}) WHERE rank < 8")
def vector_topk(spark, d):
    return _topk(spark, d).select("query_id", "rank", "concept_row", F.round("score", 6).alias("score"))


_LISTS = "lists AS (SELECT vec_id, embedding, list_id FROM (SELECT e.vec_id, e.embedding, c.vec_id AS list_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY 2 * list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) - list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS n FROM embeddings e, embeddings c WHERE c.vec_id < 16) WHERE n = 1)"
_PROBES = "probes AS (SELECT vec_id, embedding, list_id FROM (SELECT q.vec_id, q.embedding, c.vec_id AS list_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS n FROM embeddings q, embeddings c WHERE c.vec_id < 16 AND q.vec_id % 20 = 0) WHERE n <= 4)"


def _stored(spark, d):
    """An index of all vectors, with the first sixteen as centroids; the last half of them appended."""
    e, path = t(spark, d, "embeddings").select(F.col("vec_id").alias("concept_row"), F.col("embedding").alias("v")), _new(spark, "index")
    centroids = e.filter("concept_row < 16").select(F.col("concept_row").alias("list_id"), F.col("v").alias("c"))
    vector_index.build(e.filter("concept_row % 2 = 0"), path, nprobe=4, centroids=centroids)
    vector_index.append(e, path)
    return vector_index.open_index(spark, path, 64, e.count())


@query(f"WITH {_LISTS} SELECT list_id, count(*) AS n, 64 AS dim FROM lists GROUP BY list_id")
def stored_index_lists(spark, d):
    return vector_index.sizes(_stored(spark, d)).select(F.col("list_id").cast("long").alias("list_id"), "n", "dim")


@query(f"WITH {_LISTS}, {_PROBES} SELECT query_id, CAST(rank AS INT) AS rank, concept_row, round(score, 6) AS score FROM (SELECT p.vec_id AS query_id, l.vec_id AS concept_row, list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY p.vec_id ORDER BY list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])) DESC, l.vec_id) - 1 AS rank FROM probes p JOIN lists l USING (list_id)) WHERE rank < 8")
def stored_index_topk(spark, d):
    index = _stored(spark, d)
    q = t(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return vector_index.search(index, q, 8).select("query_id", "rank", "concept_row", F.round("score", 6).alias("score"))


def _new(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dim, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def stored_vectors(spark, d):
    """Vectors written as .npy parts and read back."""
    e, path = t(spark, d, "embeddings"), _new(spark, "vectors")
    npy.append(e.select(F.col("vec_id").alias("concept_row"), F.col("embedding").alias("v")), path)
    v = npy.read(spark, path)
    return v.select(F.col("concept_row").alias("vec_id"), F.size("v").alias("dim"), F.round(F.sqrt(vector.dot(F.col("v"), F.col("v"))), 5).alias("norm"))


@query("SELECT doc_id, source, text FROM documents")
def json_array_items(spark, d):
    """Rows written as JSON arrays, a file a partition, and read back in splits."""
    docs, path = t(spark, d, "documents"), _new(spark, "arrays")
    json_arrays.write(docs.select("doc_id", "source", "text"), path)
    return json_arrays.array(spark, path, "struct<doc_id:long,source:string,text:string>").select("item.doc_id", "item.source", "item.text")


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(lead AS DOUBLE[])), 6) AS cosine FROM (SELECT a.vec_id, a.embedding, b.embedding AS lead FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def vector_norm_cosine(spark, d):
    e = t(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    v, w = F.col("embedding"), F.col("w")
    return e.join(n, "vec_id").select("vec_id", F.round(F.sqrt(vector.dot(v, v)), 6).alias("norm"), F.round(vector.dot(v, w), 6).alias("cosine"))


@query()
def vector_ivf_recall(spark, d):
    """One row: recall of the inverted file, with as many probes as its own measurement asks for, against the exact search."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("concept_row"), F.col("embedding").alias("v"))
    q = e.filter("concept_row % 20 = 0").select(F.col("concept_row").alias("query_id"), "v")
    lists, centroids = vector.ivf_lists(e, 16)
    near = vector.ivf_topk(q, lists, centroids, 8, vector.probes_for(lists, centroids, 8, 0.95)).select("query_id", "concept_row", F.lit(1).alias("hit"))
    return _topk(spark, d).join(near, ["query_id", "concept_row"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@query("SELECT 'ivf' AS index_type, count(*) AS n_vectors, 64 AS dim, 16 AS nlist, 8 AS nprobe, 200000 AS train_sample, 7 AS seed FROM embeddings")
def vector_index_config(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("concept_row"), F.col("embedding").alias("v"))
    lists, centroids = vector.ivf_lists(vector.checked(e, 64), 16)
    return vector.index_config(lists, centroids, 8).select("index_type", "n_vectors", F.col("dim").cast("int").alias("dim"), "nlist", "nprobe", "train_sample", "seed")


@query(f"SELECT query_id, CAST(rank AS INT) AS rank, concept_row, round(score, 6) AS score FROM ({_TOPK.replace('q.vec_id % 20 = 0', 'q.vec_id < 3')}) WHERE rank < 5")
def vector_self_test(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("concept_row"), F.col("embedding").alias("v"))
    return vector.self_test(e).select("query_id", "rank", "concept_row", F.round("score", 6).alias("score"))


def concepts(spark, d):
    tuis = F.when(F.col("label") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.element_at(F.array(*map(F.lit, [47, 184, 33, 61, 170, 121, 23])), (F.col("vec_id") % 7 + 1).cast("int"))))
    term = F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("vec_id") % 7 + 1).cast("int"))
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("concept_row"), F.col("vec_id").cast("int").alias("cui"), term.alias("prefterm"), tuis.alias("tuis"))


_G = "CASE tui1 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in {47: "DISO", 184: "DISO", 33: "DISO", 61: "PROC", 121: "CHEM", 23: "ANAT"}.items()) + " ELSE 'CONC' END"
_CONCEPTS = f"(SELECT vec_id AS concept_row, CAST(vec_id AS INT) AS cui, {_TERM.replace('p_partkey', 'vec_id')} AS prefterm, tui1, CASE WHEN tui1 IS NULL THEN 'T000' ELSE printf('T%03d', tui1) END AS tui, CASE WHEN tui1 IS NULL THEN 'UNKN' ELSE {_G} END AS semantic_group FROM (SELECT *, CASE WHEN label % 5 = 0 THEN NULL ELSE CAST([47, 184, 33, 61, 170, 121, 23][vec_id % 7 + 1] AS BIGINT) END AS tui1 FROM embeddings))"


@query(f"SELECT concept_row, tui, semantic_group FROM {_CONCEPTS}")
def semantic_info(spark, d):
    return rerank.semantic_info(concepts(spark, d)).select("concept_row", "tui", "semantic_group")


_RAW = "CASE query_id % 3 WHEN 0 THEN 'pain' WHEN 1 THEN 'patient position' ELSE 'chronic obstructive disease' END"
_bias = lambda c, m: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " ELSE 0 END"
_CAND = f"""topk AS ({_TOPK}), cand AS (SELECT query_id AS mention_id, rank, t.concept_row, score * 0.4 + 0.5 AS score, {_RAW} AS raw, prefterm AS term, tui, semantic_group FROM topk t JOIN {_CONCEPTS} c USING (concept_row) WHERE rank < 8),
lexed AS (SELECT *, len(list_intersect({_TOK.format('raw')}, {_TOK.format('term')})) / len(list_distinct(list_concat({_TOK.format('raw')}, {_TOK.format('term')}))) AS lex, len({_TOK.format('raw')}) AS ns, len({_TOK.format('term')}) AS nt, max(score) OVER (PARTITION BY mention_id) AS top FROM cand),
scored AS (SELECT *, score + 0.3 * lex + {_bias('semantic_group', K.GROUP_BIAS)} + {_bias('tui', K.TUI_BIAS)} + CASE WHEN lex < 0.999 THEN {_PEN} + CASE WHEN ns <= 1 AND nt >= 5 THEN -0.05 WHEN ns <= 2 AND nt >= 7 THEN -0.04 WHEN length(raw) <= 6 AND length(term) >= 30 THEN -0.03 WHEN length(raw) <= 10 AND length(term) >= 45 THEN -0.02 ELSE 0 END ELSE 0 END AS rerank FROM lexed)"""


def _candidates(spark, d):
    c = _topk(spark, d).join(rerank.semantic_info(concepts(spark, d)), "concept_row")
    raw = F.when(F.col("query_id") % 3 == 0, "pain").when(F.col("query_id") % 3 == 1, "patient position").otherwise("chronic obstructive disease")
    return c.select(F.col("query_id").alias("mention_id"), "rank", "concept_row", "cui", (F.col("score") * 0.4 + 0.5).alias("score"), raw.alias("raw"), raw.alias("expanded"), "prefterm", "tui", "semantic_group")


@query(f"WITH {_CAND}, ok AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY round(rerank, 9) DESC, rank) AS n FROM scored WHERE score >= 0.5 AND score >= top - 0.1 AND round(rerank, 9) > round(top, 9)) SELECT m.mention_id, CAST(coalesce(ok.rank, 0) AS INT) AS rank, round(coalesce(ok.score, m.top), 6) AS score, round(coalesce(ok.rerank, m.top), 6) AS rerank_score FROM (SELECT DISTINCT mention_id, top FROM scored WHERE top >= 0.5) m LEFT JOIN ok ON ok.mention_id = m.mention_id AND n = 1")
def rerank_choice(spark, d):
    c = rerank.choose(_candidates(spark, d), ExtractOptions(threshold=0.5, rerank_margin=0.1))
    return c.select("mention_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"), F.round("rerank_score", 6).alias("rerank_score"))


_EDGE = "edges AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)"


def _edges(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


@query(f"WITH {_CAND}, {_EDGE}, chosen AS (SELECT mention_id // 100 AS sentence_id, mention_id, concept_row FROM cand WHERE rank = 1), deg AS (SELECT src FROM edges GROUP BY src HAVING count(*) <= 125) SELECT c.mention_id, CAST(c.rank AS INT) AS rank, CAST(coalesce(h.n, 0) AS BIGINT) AS relation_hits FROM cand c LEFT JOIN (SELECT c.mention_id, c.rank, count(*) AS n FROM cand c JOIN chosen o ON o.mention_id = c.mention_id JOIN edges e ON e.src = c.concept_row JOIN deg USING (src) JOIN (SELECT DISTINCT sentence_id, concept_row AS dst FROM chosen) x ON x.sentence_id = c.mention_id // 100 AND x.dst = e.dst WHERE e.dst <> o.concept_row GROUP BY 1, 2) h ON h.mention_id = c.mention_id AND h.rank = c.rank")
def relation_hits(spark, d):
    c = _candidates(spark, d).withColumn("sentence_id", F.floor(F.col("mention_id") / 100))
    hits = rerank.relation_hits(c.select("mention_id", "sentence_id", "rank", "concept_row"), c.filter("rank = 1").select("sentence_id", "mention_id", "concept_row"), _edges(spark, d), 125)
    return hits.select("mention_id", F.col("rank").cast("int").alias("rank"), F.col("relation_hits").cast("long").alias("relation_hits"))


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def dedupe_keep_best(spark, d):
    return extract.best_of_each(t(spark, d, "events"), ["user_id", "event_type"], "value", "event_id").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


# --- terminology -----------------------------------------------------------------------------------------------

_CONSO = "(SELECT p_partkey, p_size, printf('C%07d', p_partkey % 300) || '|' || CASE WHEN p_size % 7 = 0 THEN 'FRE' ELSE 'ENG' END || '|||||||||' || p_brand || '|' || CASE WHEN p_size % 2 = 0 THEN 'PT' ELSE 'SY' END || '||' || p_name || '||' || CASE WHEN p_size % 5 = 0 THEN 'Y' ELSE 'N' END || '|' AS line FROM part)"


def _conso(spark, d):
    line = F.concat(F.format_string("C%07d", F.col("p_partkey") % 300), F.lit("|"), F.when(F.col("p_size") % 7 == 0, "FRE").otherwise("ENG"), F.lit("||||||||||"), F.col("p_brand"), F.lit("|"), F.when(F.col("p_size") % 2 == 0, "PT").otherwise("SY"), F.lit("||"), F.col("p_name"), F.lit("||"), F.when(F.col("p_size") % 5 == 0, "Y").otherwise("N"), F.lit("|"))
    return t(spark, d, "part").select("p_partkey", line.alias("line"))


@query("SELECT CAST(p_partkey % 300 AS INT) AS cui, p_brand AS sab, CASE WHEN p_size % 2 = 0 THEN 'PT' ELSE 'SY' END AS tty, trim(p_name) AS str FROM part WHERE p_size % 7 <> 0 AND p_size % 5 <> 0 AND length(trim(p_name)) >= 3")
def rrf_names(spark, d):
    return T.mrconso(_conso(spark, d)).select("cui", "sab", "tty", "str")


@query("SELECT CAST(p_partkey % 300 AS INT) AS cui, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 300 ORDER BY p_partkey) AS n FROM part) WHERE n <= 3")
def first_synonyms(spark, d):
    rows = t(spark, d, "part").select((F.col("p_partkey") % 300).cast("int").alias("cui"), "p_partkey", "p_name")
    return etl.first_per_key(rows, "cui", "p_partkey", 3)


# quotes at both ends go, those inside stay
@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS v0, replace(p_name, ' ', ', ') || '''''s' AS v1, p_brand AS v2, CAST(3 AS INT) AS n FROM part")
def insert_lines(spark, d):
    quoted = F.concat(F.lit("''"), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit("''s"))
    line = F.concat(F.lit("INSERT INTO CUI_TERMS VALUES("), F.col("p_partkey").cast("string"), F.lit(",'"), quoted, F.lit("',  '"), F.col("p_brand"), F.lit("',)"))
    v = T.insert_values(F.col("line"), "CUI_TERMS")
    out = t(spark, d, "part").select("p_partkey", line.alias("line")).select("p_partkey", v.alias("v"))
    return out.select("p_partkey", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"), F.col("v")[2].alias("v2"), F.size("v").alias("n"))


@query("WITH r AS (SELECT l_partkey % 300 AS a, l_suppkey % 300 AS b, CASE l_linenumber % 3 WHEN 0 THEN 'PAR' WHEN 1 THEN 'RO' ELSE 'CHD' END AS rel FROM lineitem WHERE l_returnflag <> 'A'), e AS (SELECT a, b FROM r WHERE rel <> 'RO' AND a < 150 AND b < 150), u AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e) SELECT src, count(*) AS degree, CAST(sum(count(*)) OVER (ORDER BY src) AS BIGINT) AS indptr FROM u GROUP BY src")
def relation_degrees(spark, d):
    li = t(spark, d, "lineitem")
    rel = F.when(F.col("l_linenumber") % 3 == 0, "PAR").when(F.col("l_linenumber") % 3 == 1, "RO").otherwise("CHD")
    sup = F.when(F.col("l_returnflag") == "A", "Y").otherwise("N")
    line = F.concat(F.format_string("C%07d", F.col("l_partkey") % 300), F.lit("|||"), rel, F.lit("|"), F.format_string("C%07d", F.col("l_suppkey") % 300), F.lit("||||||||||"), sup, F.lit("|"))
    known = spark.range(150).select(F.col("id").cast("int").alias("cui"), F.col("id").alias("concept_row"))
    return etl.prefix_sums(etl.out_degrees(etl.edges(T.mrrel(li.select(line.alias("line"))), known)), "src", "degree", "indptr")


_REL = "rel AS (SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey * 8 + l_linenumber AS place FROM lineitem), rows AS (SELECT p_partkey AS concept_row FROM part)"


def _rel(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"))
    return e, t(spark, d, "part").select(F.col("p_partkey").alias("concept_row"))


@query(f"WITH {_REL}, n AS (SELECT concept_row, count(src) AS n, coalesce(string_agg(dst, ',' ORDER BY place, dst), '') AS neighbours FROM rows LEFT JOIN rel ON src = concept_row GROUP BY 1) SELECT concept_row, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS \"end\", neighbours FROM n WINDOW w AS (ORDER BY concept_row)")
def relation_adjacency(spark, d):
    e, rows = _rel(spark, d)
    return etl.adjacency(e, rows, "place").withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query(f"WITH {_REL}, p AS (SELECT src, dst, rank() OVER (ORDER BY src) - 1 AS place, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i FROM rel) SELECT src AS concept_row, CAST(i // 7 AS BIGINT) AS chunk, min(place + i) AS start, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM p GROUP BY src, i // 7")
def relation_chunks(spark, d):
    return etl.adjacency_chunks(_rel(spark, d)[0], 7).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query(f"WITH {_REL} SELECT (SELECT count(*) FROM rows) AS n_concepts, CAST(sum(n) AS BIGINT) AS n_edges, count(*) AS with_edges, max(n) AS max_degree FROM (SELECT src, count(*) AS n FROM rel GROUP BY 1)")
def relation_meta(spark, d):
    return etl.relation_meta(*_rel(spark, d))


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey % 2 = 0) ON o_custkey = k")
def universe_members(spark, d):
    known = t(spark, d, "lineitem").filter("l_partkey % 2 = 0").select(F.col("l_partkey").alias("cui"))
    return etl.in_universe(t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cui")), known).select("o_orderkey")


@query("SELECT c_custkey AS cui, coalesce(string_agg(o_orderkey % 200, ',' ORDER BY o_orderkey), '') AS tuis FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 = 0 GROUP BY 1")
def concept_tuis(spark, d):
    tuis = t(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("cui"), (F.col("o_orderkey") % 200).cast("int").alias("tui"), F.col("o_orderkey").alias("place"))
    out = etl.with_tuis(t(spark, d, "customer").select(F.col("c_custkey").alias("cui")), tuis)
    return out.select("cui", F.array_join(F.col("tuis").cast("array<string>"), ",").alias("tuis"))


@query("SELECT count(*) AS cuis, CAST(sum(n) AS BIGINT) AS synonyms, avg(n) AS average, count(*) FILTER (n >= 10) AS filled FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def synonym_totals(spark, d):
    terms = t(spark, d, "orders").select(F.col("o_custkey").alias("cui"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("place"))
    return etl.synonym_totals(etl.synonym_lists(terms), 10)


@query("SELECT o_orderkey, c_custkey + 7 AS concept_row FROM orders JOIN customer ON o_custkey = c_custkey")
def synonym_rows(spark, d):
    known = t(spark, d, "customer").select(F.col("c_custkey").alias("cui"), (F.col("c_custkey") + 7).alias("concept_row"))
    return etl.synonym_rows(t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cui")), known).select("o_orderkey", "concept_row")


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer ORDER BY md5('13:' || c_custkey), c_custkey LIMIT 50) c ON o_custkey = c_custkey")
def sampled_synonyms(spark, d):
    cs, syn = t(spark, d, "customer").select(F.col("c_custkey").alias("cui")), t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cui"))
    return training.concept_sample(cs, syn, 50)[1].select("o_orderkey", F.col("cui").alias("o_custkey"))


@query("SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS o_orderstatuss FROM orders GROUP BY o_custkey")
def ordered_lists(spark, d):
    return etl.ordered_list(t(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def last_values(spark, d):
    return etl.last_value(t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


# --- silver ----------------------------------------------------------------------------------------------------


def _votes(spark, d):
    w = notes(spark, d).select("note_id", F.posexplode(F.split("text", " ")).alias("k", "text"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "note_id", "k").cast("binary")), 1, 4), 16, 10).cast("int")
    # words without votes end in the generator: a filter on h would compute it twice
    w = w.withColumn("h", h).withColumn("teacher", F.explode(F.when(F.col("h") % 3 > 0, F.array(F.lit("one"), F.lit("two")))))
    start = F.col("k") * 8 + F.when(F.col("teacher") == "two", F.col("h") % 3).otherwise(0)
    return w.select("note_id", start.cast("int").alias("start"), (start + 8 + F.col("h") % 2).cast("int").alias("end"), "text", F.lit("PROBLEM").alias("label"), ((F.col("h") % 100) / 100).alias("score"), "teacher", (F.col("k") * 2).alias("seq"))


_VOTES = "votes AS (SELECT note_id, k * 8 + CASE WHEN teacher = 'two' THEN h % 3 ELSE 0 END AS start, k * 8 + CASE WHEN teacher = 'two' THEN h % 3 ELSE 0 END + 8 + h % 2 AS \"end\", teacher FROM (SELECT note_id, k - 1 AS k, CAST('0x' || substr(md5(note_id || ':' || (k - 1)), 1, 4) AS INT) AS h FROM (SELECT note_id, generate_subscripts(string_split(text, ' '), 1) AS k FROM notes)), (VALUES ('one'), ('two')) AS t(teacher) WHERE h % 3 > 0)"


@query()
def teacher_merge(spark, d):
    merged = silver.scan(_votes(spark, d), 0.2, bonus=0.05, counts=False, columns=["note_id", "start", "end", "text", "teachers", "teacher_count", "max_score", "mean_score", "score"])
    return silver.kept(merged).select("note_id", "start", "end", "text", F.concat_ws(",", "teachers").alias("teachers"), F.round("score", 6).alias("score"), F.round("mean_score", 6).alias("mean_score"))


@query()
def teacher_stats(spark, d):
    return silver.scan_stats(silver.scan(_votes(spark, d), 0.2, by_teacher={"two": 0.3}, bonus=0.05, columns=silver.STATS))


_LINK = "SELECT *, sim + 0.3 * lex AS s, max(sim) OVER (PARTITION BY l_orderkey) AS top FROM (SELECT l_orderkey, l_linenumber, l_partkey, p_name, 1 - l_discount * 2 - l_linenumber / 1000.0 AS sim, o_orderpriority AS text, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS lex FROM (SELECT *, " + _WS.format("p_name || ' ' || p_type") + " AS b, " + _WS.format("'small ' || split_part(p_name, ' ', 1) || ' steel'") + " AS a FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey))"


@query(f"SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, round(sim, 6) AS sim, round(lex, 6) AS lex FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(s, 9) DESC, l_linenumber, l_partkey) AS n FROM ({_LINK}) WHERE sim >= top - 0.0455) WHERE n = 1 AND sim >= 0.9 AND lex >= 0.1")
def silver_links(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select(F.col("l_orderkey").alias("mention_id"), F.struct("l_linenumber", "l_partkey").alias("rank"), (1 - F.col("l_discount") * 2 - F.col("l_linenumber") / 1000.0).alias("sim"), F.concat(F.lit("small "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" steel")).alias("text_for_embed"), F.concat_ws(" ", "p_name", "p_type").alias("preferred_term"))
    return silver.linked(x, 0.9, 0.1, margin=0.0455).select(F.col("mention_id").alias("l_orderkey"), F.col("rank.l_linenumber").cast("int").alias("l_linenumber"), F.round("sim", 6).alias("sim"), F.round("lex", 6).alias("lex"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN trim(p_name) ELSE p_type END AS text_for_embed FROM part WHERE length(CASE WHEN p_size % 3 = 0 THEN trim(p_name) ELSE p_type END) BETWEEN 3 AND 18 AND p_size >= 10")
def silver_mentions(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_type")).alias("normalized"), F.col("p_size").alias("score"))
    return silver.embeddable(x, 3, 18, 10).select("p_partkey", "text_for_embed")


@query("SELECT p_partkey, p_name, cui FROM (SELECT *, p_partkey % 50 AS cui, row_number() OVER (PARTITION BY lower(trim(p_name)), p_partkey % 50 ORDER BY p_partkey) AS n FROM part WHERE p_size % 10 / 10.0 >= 0.3 AND (p_size % 3 = 0 OR p_size % 3 >= 2) AND length(trim(p_name)) BETWEEN 3 AND 60) WHERE n = 1")
def silver_pairs(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), (F.col("p_partkey") % 50).alias("cui"), ((F.col("p_size") % 10) / 10).alias("sim"), F.lit(1.0).alias("lex"), (F.col("p_size") % 3).alias("teacher_count"), F.col("p_partkey").alias("seq"))
    return silver.pairs(rows, 0.3, 0.5, 2, 3, 60).select("p_partkey", F.col("text").alias("p_name"), "cui")


@query("SELECT p_partkey, p_name, cui FROM (SELECT *, p_partkey % 50 AS cui, row_number() OVER (PARTITION BY lower(trim(p_name)), p_partkey % 50 ORDER BY p_partkey) AS n FROM part WHERE p_size % 10 / 10.0 >= 0.3 AND (p_size % 3 = 0 OR p_size % 3 >= 2) AND length(trim(p_name)) BETWEEN 3 AND 60) WHERE n = 1 ORDER BY p_partkey LIMIT 500")
def limited_pairs(spark, d):
    """The first 500 silver pairs in the order of their rows."""
    rows = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), (F.col("p_partkey") % 50).alias("cui"), ((F.col("p_size") % 10) / 10).alias("sim"), F.lit(1.0).alias("lex"), (F.col("p_size") % 3).alias("teacher_count"), F.col("p_partkey").alias("seq"))
    return ordinal.first(silver.pairs(rows, 0.3, 0.5, 2, 3, 60), 500, [F.col("seq")]).select("p_partkey", F.col("text").alias("p_name"), "cui")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS concept_row FROM lineitem")
def numbered_rows(spark, d):
    """Rows numbered from 0 in an order, as positions of concepts are."""
    return ordinal.numbered(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), [F.col("l_orderkey"), F.col("l_linenumber")], "concept_row")


@query("SELECT quantile_disc(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS q2, quantile_disc(l_extendedprice, 1.0) AS q4 FROM lineitem")
def exact_quantiles(spark, d):
    """Order statistics without a sort of all rows."""
    rows = t(spark, d, "lineitem")
    n = rows.count()
    found = ordinal.order_statistics(rows, "l_extendedprice", {-(-n // 4) - 1, n - 1})
    return spark.createDataFrame([(found[-(-n // 4) - 1], ordinal.median(rows, "l_extendedprice"), found[n - 1])], "q1 double, q2 double, q4 double")


@query("SELECT p_partkey FROM part ORDER BY md5('13:' || p_partkey), p_partkey LIMIT 100")
def hash_sample(spark, d):
    return silver.hash_sample(t(spark, d, "part").select("p_partkey"), "p_partkey", 100)


# --- review and view -------------------------------------------------------------------------------------------


_REVIEW = """rev AS (SELECT 'n' || o_custkey AS note_file, o_orderkey AS a, o_orderpriority AS nt, CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE 'C' || o_orderkey % 3 END AS g FROM orders),
run AS (SELECT 'n' || o_custkey AS note_file, o_orderkey AS a, o_orderstatus AS nt, 'C' || o_custkey % 3 AS p, o_orderkey % 2 AS k FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 4 > 0
  UNION ALL SELECT 'n' || o_custkey, o_orderkey, o_orderstatus, 'C' || (o_custkey + 1) % 3, o_orderkey % 2 FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 4 = 0),
j AS (SELECT g, coalesce(p, '') AS p, coalesce(run.nt, rev.nt) AS nt, upper(g) = 'NONE' AS none, coalesce(k = 0 AND g = 'C2', false) AS topk, CASE WHEN upper(g) = 'NONE' THEN p IS NULL ELSE coalesce(p = g, false) END AS good FROM rev LEFT JOIN run USING (note_file, a))"""


def _review(spark, d):
    o = t(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    keys = [F.concat(F.lit("n"), c.cast("string")).alias("note_file"), k.alias("start"), (k + 5).alias("end")]
    gold = F.when(k % 5 == 0, " none ").when(k % 5 == 1, "").otherwise(F.concat(F.lit("C"), (k % 3).cast("string")))
    run = o.filter(k % 7 > 0).withColumn("again", F.explode(F.when(k % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    cands = F.when(k % 2 == 0, F.array(F.lit("C2"), F.lit("C9"))).otherwise(F.array().cast("array<string>"))
    run = run.select(*keys, F.col("o_orderstatus").alias("note_type"), F.concat(F.lit("C"), ((c + F.col("again")) % 3).cast("string")).alias("cui"), cands.alias("candidates"), F.col("again").alias("seq"))
    return o.select(*keys, F.col("o_orderpriority").alias("note_type"), gold.alias("gold_cui")), run


@query(f"WITH {_REVIEW} SELECT *, round(correct / labeled, 6) AS accuracy, round(correct_positive / labeled_positive, 6) AS positive_accuracy FROM (SELECT count(*) AS n_rows, count(*) FILTER (g <> '') AS labeled, count(*) FILTER (g <> '' AND NOT none) AS labeled_positive, count(*) FILTER (none) AS labeled_none, count(*) FILTER (g <> '' AND good) AS correct, count(*) FILTER (g <> '' AND NOT none AND good) AS correct_positive, count(*) FILTER (none AND p <> '') AS false_positives, count(*) FILTER (g <> '' AND NOT none AND p = '') AS false_negatives, count(*) FILTER (g <> '' AND NOT none AND p <> '' AND NOT good) AS wrong_link, count(*) FILTER (g <> '' AND NOT none AND p <> '' AND topk) AS gold_in_topk FROM j)")
def review_scores(spark, d):
    return review.scores(*_review(spark, d))


@query(f"WITH {_REVIEW} SELECT nt AS note_type, count(*) FILTER (good) AS correct, count(*) AS labeled, round(count(*) FILTER (good) / count(*), 6) AS accuracy FROM j WHERE g <> '' GROUP BY 1")
def review_scores_by_type(spark, d):
    return review.scores_by_type(*_review(spark, d))


@query("WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS nt, o_orderkey % 11 AS tricky, md5('13:' || o_orderkey) AS t, CASE WHEN o_orderkey % 11 >= 5 THEN 0 WHEN o_custkey % 100 / 100.0 < 0.55 THEN 1 ELSE 2 END AS c FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY nt, c ORDER BY t) AS pos, row_number() OVER (PARTITION BY nt, c > 0 ORDER BY t) AS pos2, least(count(*) FILTER (c = 0) OVER (PARTITION BY nt), 13) AS nt0 FROM r), f AS (SELECT *, CASE WHEN c = 0 THEN pos <= nt0 ELSE pos2 <= 20 - nt0 END AS first FROM p) SELECT k AS o_orderkey FROM f ORDER BY first DESC, CASE WHEN NOT first THEN c END, CASE WHEN NOT first THEN -tricky END, t LIMIT 103")
def review_quota_sample(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("note_type"), (F.col("o_orderkey") % 11).alias("tricky"), (F.col("o_custkey") % 100 / 100.0).alias("score"))
    return review.review_sample(rows, 103, "o_orderkey").select("o_orderkey")


@query("SELECT user_id, event_type, arg_max(round(value, 6), event_id) AS value, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def review_latest(spark, d):
    return review.latest(t(spark, d, "events").select("user_id", "event_type", F.round("value", 6).alias("value"), "event_id"), ["user_id", "event_type"], "event_id")


@query("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS overlap, count(*) FILTER (b IS NULL) AS base_only, count(*) FILTER (a IS NULL) AS new_only, count(*) FILTER (a <> b) AS changed FROM (SELECT p_partkey, p_size AS a FROM part WHERE p_partkey % 3 > 0) x FULL JOIN (SELECT p_partkey, p_size % 20 AS b FROM part WHERE p_partkey % 4 > 0) y USING (p_partkey)")
def run_diff(spark, d):
    p = t(spark, d, "part")
    return review.run_diff(p.filter("p_partkey % 3 > 0").select("p_partkey", F.col("p_size").alias("cui")), p.filter("p_partkey % 4 > 0").select("p_partkey", (F.col("p_size") % 20).alias("cui")), ["p_partkey"])


@query(f"WITH f AS ({_TOPK}), m AS (SELECT f.query_id, min(CASE WHEN a.label = b.label AND f.rank < 6 AND f.rank > 0 THEN f.rank - 1 END) AS r FROM f JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = concept_row WHERE rank > 0 AND rank < 8 GROUP BY 1) SELECT round(avg(CASE WHEN r = 0 THEN 1 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN r IS NOT NULL THEN 1 ELSE 0 END), 6) AS hit_k, round(avg(coalesce(1.0 / (r + 1), 0)), 6) AS mrr FROM m")
def retrieval_metrics(spark, d):
    e = t(spark, d, "embeddings")
    f = _topk(spark, d).filter("rank > 0").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), "query_id").join(e.select(F.col("vec_id").alias("concept_row"), F.col("label").alias("lb")), "concept_row")
    return review.retrieval(f.select("query_id", (F.col("rank") - 1).alias("rank"), (F.col("la") == F.col("lb")).alias("hit")), 5)


_KEPT = 'SELECT note_id, s[1] AS start, s[2] AS "end" FROM (SELECT note_id, unnest(list_transform(range(1, len(r) // 2 + 1), lambda i: [r[2 * i], r[2 * i + 1]])) AS s FROM (SELECT note_id, list_reduce(list_prepend([CAST(0 AS BIGINT)], list(CAST([start, "end"] AS BIGINT[]) ORDER BY start, "end" DESC)), lambda kept, s: CASE WHEN s[1] >= kept[1] THEN list_concat([s[2]], kept[2:], s) ELSE kept END) AS r FROM votes GROUP BY note_id))'


@query(f'WITH notes AS {_NOTES}, {_VOTES} SELECT note_id, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM ({_KEPT})')
def highlight_spans(spark, d):
    return fold.apart(_votes(spark, d), ["note_id"])


#: Rows of an extraction, made of order lines.
_EXT = """(SELECT 'note' || l_suppkey || '.txt' AS note_file, l_orderkey * 8 + l_linenumber AS seq, CAST(l_partkey % 200 AS INT) AS start, CAST(l_partkey % 200 + l_linenumber AS INT) AS "end", p_name AS text, p_name || ' ' || p_type AS preferred_term,
  printf('C%07d', l_partkey) AS cui, ['DISO', 'CHEM', 'PROC', 'CONC'][l_linenumber % 4 + 1] AS semantic_group, CASE l_returnflag WHEN 'A' THEN 'ABSENT' WHEN 'N' THEN 'PRESENT' ELSE 'POSSIBLE' END AS assertion,
  CASE l_linestatus WHEN 'O' THEN 'PATIENT' ELSE 'FAMILY' END AS subject, 0.5 + l_discount AS score FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def extractions(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    return x.select(
        F.concat(F.lit("note"), F.col("l_suppkey").cast("string"), F.lit(".txt")).alias("note_file"), (F.col("l_orderkey") * 8 + n).alias("seq"), (k % 200).cast("int").alias("start"), (k % 200 + n).cast("int").alias("end"), F.col("p_name").alias("text"),
        F.concat_ws(" ", "p_name", "p_type").alias("preferred_term"), X.cui_text(k).alias("cui"), F.element_at(F.array(*map(F.lit, ["DISO", "CHEM", "PROC", "CONC"])), (n % 4 + 1).cast("int")).alias("semantic_group"),
        F.when(F.col("l_returnflag") == "A", "ABSENT").when(F.col("l_returnflag") == "N", "PRESENT").otherwise("POSSIBLE").alias("assertion"), F.when(F.col("l_linestatus") == "O", "PATIENT").otherwise("FAMILY").alias("subject"), (0.5 + F.col("l_discount")).alias("score"),
        *[F.lit(None).cast("string").alias(c) for c in ("expanded_text", "normalized_text", "tui", "semantic_type", "severity", "laterality", "temporality")],
    )


@query(f"SELECT semantic_group, count(*) AS rows, count(*) FILTER (assertion = 'PRESENT') AS present, count(*) FILTER (assertion = 'ABSENT') AS absent, count(*) FILTER (assertion = 'POSSIBLE') AS possible FROM {_EXT} GROUP BY 1")
def export_summary(spark, d):
    return view.group_summary(extractions(spark, d))


@query(f"SELECT count(*) AS rows, count(DISTINCT note_file) AS unique_notes FROM {_EXT}")
def export_totals(spark, d):
    return view.totals(extractions(spark, d))


@query(f"SELECT note_file, rows FROM (SELECT note_file, count(*) AS rows, min(seq) AS f FROM {_EXT} GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 50)")
def top_notes(spark, d):
    return view.top_notes(extractions(spark, d), "seq")


_GROUP_FILL = "CASE semantic_group " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.GROUP_COLORS.items()) + f" ELSE '{K.OTHER_GROUP}' END"
_ASSERT_FILL = "CASE assertion " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ASSERTION_COLORS.items()) + f" ELSE '{K.OTHER_ASSERTION}' END"


@query(f"SELECT seq, cui, assertion, {_GROUP_FILL} AS group_fill, {_ASSERT_FILL} AS assertion_fill FROM {_EXT}")
def report_fills(spark, d):
    rows = extractions(spark, d)
    return view.report_rows(rows.withColumn("span", F.col("text")).withColumn("tui", F.col("seq").cast("string")), context=False).select(F.col("tui").cast("long").alias("seq"), "cui", "assertion", "group_fill", "assertion_fill")


@query(f"SELECT seq FROM {_EXT} WHERE assertion IN ('PRESENT', 'POSSIBLE') AND semantic_group <> 'CONC' AND (contains(lower(text), 'steel') OR contains(lower(preferred_term), 'steel') OR contains(lower(cui), 'steel'))")
def shown_rows(spark, d):
    return view.shown(extractions(spark, d), " Steel ", ["PRESENT", "POSSIBLE"], ["CONC"]).select("seq")


@query(f"SELECT 'assertion' AS kind, assertion AS value, count(*) AS n FROM {_EXT} GROUP BY 2 UNION ALL SELECT 'group', semantic_group, count(*) FROM {_EXT} GROUP BY 2")
def view_counts(spark, d):
    return view.counts(extractions(spark, d))


@query(f"SELECT string_agg(DISTINCT semantic_group, ',' ORDER BY semantic_group) AS groups, string_agg(DISTINCT assertion, ',' ORDER BY assertion) AS assertions FROM {_EXT}")
def view_available(spark, d):
    return view.available(extractions(spark, d)).select(F.array_join("groups", ",").alias("groups"), F.array_join("assertions", ",").alias("assertions"))


@query(f"SELECT seq, '\"' || replace(note_file, '\"', '\"\"') || '\",\"' || replace(text, '\"', '\"\"') || '\"' AS csv, start || ':' || \"end\" || ':' || cui || ':' || assertion || ':' || subject AS key FROM {_EXT}")
def view_rows(spark, d):
    k = view.key(*[F.col(c) for c in ("start", "end", "cui", "assertion", "subject")])
    return extractions(spark, d).select("seq", view.csv_line(F.col("note_file"), F.col("text")).alias("csv"), k.alias("key"))


@query(f"SELECT count(*) AS rows, count(DISTINCT note_file) AS notes_with_rows, round(avg(score), 4) AS mean_score, round(avg(j), 4) AS mean_jaccard, round(median(j), 4) AS median_jaccard, (SELECT count(*) FROM documents) AS notes FROM (SELECT *, len(list_intersect({_TOK.format('text')}, {_TOK.format('preferred_term')})) / len(list_distinct(list_concat({_TOK.format('text')}, {_TOK.format('preferred_term')}))) AS j FROM {_EXT})")
def run_stats(spark, d):
    stats = evaluate.run_stats(t(spark, d, "documents"), extractions(spark, d))
    return stats.select("rows", "notes_with_rows", "notes", *[F.round(c, 4).alias(c) for c in ("mean_score", "mean_jaccard", "median_jaccard")])


@query(f"SELECT 'note' || doc_id || '.txt' AS note_file, octet_length(encode(coalesce(text, ''))) AS bytes_read, length(coalesce(text, '')) AS chars, coalesce(n, 0) AS extractions FROM documents LEFT JOIN (SELECT note_file, count(*) AS n FROM {_EXT} GROUP BY 1) ON note_file = 'note' || doc_id || '.txt'")
def per_file_summary(spark, d):
    return evaluate.file_summary(_files(spark, d), extractions(spark, d)).select("note_file", F.col("bytes_read").cast("long").alias("bytes_read"), F.col("chars").cast("long").alias("chars"), "extractions")


def _files(spark, d):
    text = F.coalesce("text", F.lit(""))
    return t(spark, d, "documents").select(F.concat(F.lit("note"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("note_file"), F.octet_length(text).alias("bytes_read"), text.alias("text"))


@query(f"SELECT seq, substring(d.text, greatest(0, start - 80) + 1, start - greatest(0, start - 80)) AS left_context, substring(d.text, start + 1, \"end\" - start) AS span, substring(d.text, \"end\" + 1, 80) AS right_context FROM {_EXT} e JOIN documents d ON note_file = 'note' || doc_id || '.txt'")
def eval_contexts(spark, d):
    return evaluate.eval_rows(_files(spark, d), extractions(spark, d)).select("seq", "left_context", "span", "right_context")


@query("SELECT round(avg(n_chars / 1000.0), 6) AS mean_cosine, round(median(n_chars / 1000.0), 6) AS median_cosine, round(avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id)")
def validation_metrics(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return evaluate.validation(x.select((F.col("n_chars") / 1000.0).alias("cosine"), F.col("quality").alias("gold"), F.col("toxic").alias("predicted")))


@query("SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def label_distribution(spark, d):
    return evaluate.label_distribution(t(spark, d, "labels"), "quality")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def pending_notes(spark, d):
    from ..streaming.incremental import pending

    return pending(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT label, CAST(i AS INT) AS i, round(sum(CASE WHEN vec_id % 3 > 0 AND label % 7 > 0 THEN x ELSE 0 END) / greatest(sum(CASE WHEN vec_id % 3 > 0 AND label % 7 > 0 THEN 1 ELSE 0 END), 1), 6) + 0.0 AS mean FROM (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def pooled_vectors(spark, d):
    """Means of the vectors of each label under a mask; some labels are masked as a whole."""
    e = t(spark, d, "embeddings").select("label", F.col("embedding").alias("v"), ((F.col("vec_id") % 3 > 0) & (F.col("label") % 7 > 0)).cast("int").alias("mask"))
    return vector.pooled(e, "label").select("label", F.posexplode("v").alias("i", "x")).select("label", "i", (F.round("x", 6) + 0.0).alias("mean"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def streamed_totals(spark, d):
    """Events that come in micro-batches, into two outputs; the sums of the second one over all batches."""
    from ..streaming.incremental import Output, run_batches, written

    where, events = _new(spark, "stream"), t(spark, d, "events")
    events.repartition(4).write.parquet(f"{where}/in")
    outputs = [Output(f"{where}/rows", lambda b: b.select("event_id", "event_type")), Output(f"{where}/sums", lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))]
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    run_batches(stream, f"{where}/checkpoint", outputs).awaitTermination()
    return written(spark, outputs[1]).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


_NCE = "SELECT a.vec_id AS i, b.vec_id - 1 AS j, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 0.07 AS s FROM embeddings a JOIN embeddings b ON (b.vec_id - 1) // 32 = a.vec_id // 32 AND b.vec_id > 0 WHERE a.vec_id < (SELECT max(vec_id) FROM embeddings)"


def _nce(spark, d):
    e = t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("pred")).join(e.select((F.col("vec_id") - 1).alias("idx"), F.col("embedding").cast("array<double>").alias("target")), "idx")


@query(f"SELECT i AS idx, round(ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END), 6) AS loss FROM ({_NCE}) GROUP BY 1")
def info_nce(spark, d):
    return vector.info_nce(_nce(spark, d)).select("idx", F.round("loss", 6).alias("loss"))


@query(f"SELECT i AS idx, round(ln(sum(exp(s)) + max(h)) - max(CASE WHEN i = j THEN s END), 6) AS loss FROM ({_NCE}) JOIN (SELECT a.vec_id AS i, exp(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 0.07) AS h FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2) USING (i) GROUP BY 1")
def hard_negative_loss(spark, d):
    far = t(spark, d, "embeddings").select(F.col("vec_id").alias("half"), F.array(F.col("embedding").cast("array<double>")).alias("negatives"))
    rows = _nce(spark, d).withColumn("half", F.floor(F.col("idx") / 2)).join(far, "half").drop("half")
    return vector.hard_negative_loss(rows).select("idx", F.round("loss", 6).alias("loss"))


# --- training rows ---------------------------------------------------------------------------------------------

_TPL = ", ".join(f"('{a}', '{b}')" for a, b in [*K.ASSERTION_TEMPLATES, *K.SUBJECT_TEMPLATES])
_COND = ", ".join(f"('{c}')" for c in K.CONDITIONS)
_SYN = f"(SELECT replace(template, '{{condition}}', entity) AS text, label, entity, 'synthetic' AS source FROM (VALUES {_TPL}) AS t(label, template), (VALUES {_COND}) AS c(entity))"


_FILLED = f"(SELECT p_partkey, replace(template, '{{condition}}', p_name) AS text, label, p_name AS entity, 'synthetic' AS source FROM (VALUES {_TPL}) AS t(label, template), part)"


def _filled(spark, d):
    names = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("entity"))
    return training.filled_with(names, [*K.ASSERTION_TEMPLATES, *K.SUBJECT_TEMPLATES])


@query(f"SELECT p_partkey, text, label, entity, source, CASE WHEN contains(text, entity) THEN replace(text, entity, '[entity] ' || entity || ' [entity]') ELSE text END AS marked FROM {_FILLED}")
def synthetic_examples(spark, d):
    """Every template with the name of every part."""
    return _filled(spark, d).withColumn("marked", training.marked(F.col("text"), F.col("entity"))).select("p_partkey", "text", "label", "entity", "source", "marked")


@query(f"SELECT label, source, count(*) AS n FROM {_FILLED} GROUP BY 1, 2")
def synthetic_label_counts(spark, d):
    return _filled(spark, d).groupBy("label", "source").agg(F.count("*").alias("n"))


#: Notes with phrases to be mined, several times.
_MINE = "(SELECT doc_id AS note_id, 'Fever and pain. No Fever; renal failure, ' || coalesce(text, '') || ' Aspirin for pain' AS text FROM documents)"
_MINED = " UNION ALL ".join(f"SELECT note_id, {k} AS pattern, text, unnest(string_split(regexp_replace(text, '(?i){p.replace('(', '(?:', 1)}', chr(1) || '\\\\0' || chr(1), 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(text, '(?i){p.replace('(', '(?:', 1)}', chr(1) || '\\\\0' || chr(1), 'g'), chr(1)), 1) AS i FROM notes" for k, p in enumerate(K.MINED_PATTERNS)).replace("\\\\", "\\")


@query(f"WITH notes AS {_MINE}, parts AS ({_MINED}), placed AS (SELECT *, CAST(coalesce(sum(length(part)) OVER (PARTITION BY note_id, pattern ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM parts) SELECT note_id, CAST(pattern AS INT) AS pattern, start, CAST(start + length(part) AS INT) AS \"end\", part AS phrase, substring(text, greatest(0, start - 50) + 1, start + length(part) + 50 - greatest(0, start - 50)) AS \"window\" FROM placed WHERE i % 2 = 0")
def mined_phrases(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.concat(F.lit("Fever and pain. No Fever; renal failure, "), F.coalesce("text", F.lit("")), F.lit(" Aspirin for pain")).alias("text"))
    return training.mined(rows)


_FAM, _PAT = "|".join(f"(?:{x})" for x in K.FAMILY_LINES), "|".join(f"(?:{x})" for x in K.PATIENT_LINES)
_LINES = ["Mother had breast cancer", "PMH: gout", "Family history: patient has asthma", "FHx: stroke", "Assessment / Plan: rest", "nothing"]
_LINED = "(SELECT doc_id, [" + ", ".join(f"'{x}'" for x in _LINES) + "][doc_id % 6 + 1] || chr(10) || coalesce(text, '') AS text FROM documents)"


@query(f"SELECT doc_id AS note_id, trim(line) AS line, CASE WHEN regexp_matches(line, '(?i){_FAM}') THEN 'FAMILY' ELSE 'PATIENT' END AS label FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {_LINED}) WHERE length(trim(line)) BETWEEN 10 AND 200 AND regexp_matches(line, '(?i){_FAM}') <> regexp_matches(line, '(?i){_PAT}')")
def subject_lines(spark, d):
    first = F.element_at(F.array(*map(F.lit, _LINES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return training.subject_lines(t(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.concat(first, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")))


@query(f"SELECT text, label, source, CAST(NULL AS DOUBLE) AS confidence FROM {_SYN} UNION ALL SELECT p_name, p_brand, 'clinical_note', p_size / 50.0 FROM part WHERE p_size / 50.0 > 0.7")
def assertion_examples(spark, d):
    c = t(spark, d, "part").select(F.col("p_name").alias("text"), F.col("p_brand").alias("label"), F.col("p_type").alias("entity"), (F.col("p_size") / 50.0).alias("confidence"))
    return training.with_clinical(training.all_synthetic(spark), training.confident(c)).select("text", "label", "source", "confidence")


@query("SELECT o_orderkey, item_id FROM orders JOIN benchmark ON item_id = o_orderkey % (SELECT count(*) FROM benchmark)")
def dealt_examples(spark, d):
    steps = t(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("idx"))
    return training.dealt(steps, t(spark, d, "benchmark").select("item_id"), "idx", "item_id").select("o_orderkey", "item_id")


@query("SELECT vec_id AS concept_row, CASE WHEN vec_id % 3 = 0 THEN (vec_id + 1) % (SELECT count(*) FROM embeddings) ELSE vec_id // 2 END AS neighbour FROM embeddings")
def hard_negative_fill(spark, d):
    e = t(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("concept_row"), F.array(F.when(F.col("vec_id") % 3 == 0, F.lit(-1)).otherwise(F.floor(F.col("vec_id") / 2))).cast("array<long>").alias("neighbours"))
    return training.neighbours(rows, e.count()).select("concept_row", F.col("neighbours")[0].alias("neighbour"))


@query("SELECT p_partkey, ('0x' || substring(md5('13:' || p_partkey), 1, 8))::BIGINT < 3865470566 AS is_train FROM part")
def train_split(spark, d):
    return training.split(t(spark, d, "part").select("p_partkey"), "p_partkey")


# --- silver rows and exports -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN least(e1, e2) - greatest(s1, s2) <= 0 OR least(e1 - s1, e2 - s2) <= 0 THEN 0 ELSE round((least(e1, e2) - greatest(s1, s2)) / least(e1 - s1, e2 - s2), 6) END AS overlap FROM (SELECT *, l_suppkey % 40 AS s1, l_suppkey % 40 + l_quantity AS e1, l_partkey % 40 AS s2, l_partkey % 40 + l_linenumber AS e2 FROM lineitem)")
def span_overlap(spark, d):
    a, b = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    x = X.overlap_ratio(a, a + F.col("l_quantity"), b, b + F.col("l_linenumber"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("overlap"))


@query("SELECT event_id, 'x' || event_id AS mention, CAST(user_id AS INT) AS cui, round(value, 6) AS sim FROM events WHERE value >= 20 AND length(event_type) BETWEEN 3 AND 20 UNION ALL SELECT o_orderkey, 'o' || o_orderkey, CAST(o_custkey AS INT), 1.0 FROM orders")
def silver_union(spark, d):
    e = t(spark, d, "events").filter((F.col("value") >= 20) & F.char_length("event_type").between(3, 20)).select("event_id", F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("mention"), F.col("user_id").cast("int").alias("cui"), F.round("value", 6).alias("sim"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("mention"), F.col("o_custkey").cast("int").alias("cui"), F.lit(1.0).alias("sim"))
    return silver.with_base(e, o)


@query(f"WITH {_CAND}, s AS (SELECT mention_id, list(rerank ORDER BY rerank DESC) AS r, max(CASE WHEN rank = 0 THEN lex END) AS lex, max(CASE WHEN rank > 0 THEN lex END) AS other, max(CASE WHEN rank = 0 THEN score END) AS score, max(CASE WHEN rank = 0 THEN semantic_group END) AS g, max(CASE WHEN rank = 0 THEN tui END) AS tui, max(CASE WHEN rank = 0 THEN term END) AS term, bool_or(regexp_matches(term, '(?i)\\bctcae\\b|\\brndx\\b|\\breported\\s+by\\s+patient\\b|\\bhow\\s+often\\b|\\bquestion\\b|\\bwere\\s+you\\b|^when\\b')) AS weird FROM scored GROUP BY 1) SELECT mention_id, CASE WHEN regexp_matches(term, '(?i)\\bctcae\\b|\\brndx\\b|\\breported\\s+by\\s+patient\\b|\\bhow\\s+often\\b|\\bquestion\\b|\\bwere\\s+you\\b|^when\\b') THEN 10 ELSE 0 END + CASE WHEN weird THEN 5 ELSE 0 END + CASE WHEN r[1] - r[2] < 0.010 THEN 5 WHEN r[1] - r[2] < 0.020 THEN 3 WHEN r[1] - r[2] < 0.040 THEN 1 ELSE 0 END + CASE WHEN lex < 0.2 AND other >= 0.5 THEN 2 ELSE 0 END + CASE WHEN score < 0.55 THEN 1 ELSE 0 END + CASE WHEN g IN ('CONC', 'UNKN') THEN 2 ELSE 0 END + CASE WHEN tui = 'T170' THEN 2 ELSE 0 END AS tricky FROM s")
def tricky_scores(spark, d):
    return _extraction(spark, d).select("mention_id", review.tricky(F.col("e"), fix_weird_terms=True).alias("tricky"))


def _extraction(spark, d):
    """mention_id, e: the first candidate as a row of an extraction, with all candidates."""
    c = rerank.scored(_candidates(spark, d))
    one = F.struct("rank", F.col("cui").cast("string").alias("cui"), F.col("prefterm").alias("preferred_term"), "lex", F.col("rerank").alias("rerank_score"))
    own = F.struct(F.col("cui").cast("string").alias("cui"), F.col("prefterm").alias("preferred_term"), "semantic_group", "tui", "score")
    g = c.groupBy("mention_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"), F.max(F.when(F.col("rank") == 0, own)).alias("p"))
    return g.select("mention_id", F.struct("p.*", "candidates").alias("e"))


@query(f"WITH {_CAND} SELECT mention_id, term AS preferred_term, round(lex, 6) AS lex FROM scored WHERE rank = 2")
def predicted_candidate(spark, d):
    c = review.own_candidate(F.col("e.candidates"), F.col("e.candidates")[2]["cui"])
    return _extraction(spark, d).select("mention_id", c.alias("c")).select("mention_id", "c.preferred_term", F.round("c.lex", 6).alias("lex"))


# --- notes to concepts -----------------------------------------------------------------------------------------


def term_concepts(spark):
    """Concepts of the dictionary's expansions and the conditions, with the stand-in vectors."""
    names = sorted({*K.ABBREVIATIONS.values(), *K.CONDITIONS, "chest pain", "knee pain", "pulmonary embolism", "breast cancer", "effusion", "fever", "rash", "edema", "nausea", "dizziness", "cough"})
    rows = [(k, 100 + k, n, [[47, 184, 33, 61, 170][k % 5]]) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "concept_row long, cui int, prefterm string, tuis array<int>").withColumn("v", C.ngram_vector(F.col("prefterm")))


@query()
def extract_concepts(spark, d):
    return C.extract_concepts(spread(notes(spark, d)), term_concepts(spark), ExtractOptions(threshold=0.6))
