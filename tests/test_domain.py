import glob
import json
import random

import duckdb
import numpy as np
import pytest
from conceptmill.functions import text as X
from conceptmill.functions.mentions import mentions
from conceptmill.operators import concepts, etl, extract, review, silver, training, vector, view
from conceptmill.options import ExtractOptions, bias_map, tui_key
from conceptmill.plans import queries as Q
from conceptmill.sources import files, terminology
from conceptmill.streaming.incremental import pending, run_available
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if v is None or v != v:
        return "~"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, sf_dir).toPandas(), con.execute(Q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(tuple(map(cell, r)) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


GOLDEN = [
    ("Patient denies HTN.", [("HTN", 15, 18, "hypertension", None, None, None, "ABSENT", "PATIENT")]),
    ("No evidence of COPD.", [("COPD", 15, 19, "obstructive pulmonary disease", None, None, "chronic", "ABSENT", "PATIENT")]),
    ("Severe left knee pain", [("Severe left knee pain", 0, 21, "knee pain", "severe", "left", None, "PRESENT", "PATIENT")]),
    ("Denies chest pain or shortness of breath at rest.", [("chest pain", 7, 17, "chest pain", None, None, None, "ABSENT", "PATIENT"), ("shortness of breath at rest", 21, 48, "shortness of breath at rest", None, None, None, "ABSENT", "PATIENT")]),
    ("Possible pulmonary embolism.", [("pulmonary embolism", 9, 27, "pulmonary embolism", None, None, None, "POSSIBLE", "PATIENT")]),
    ("Mother had breast cancer.", [("Mother had breast cancer", 0, 24, "Mother had breast cancer", None, None, None, "PRESENT", "PATIENT")]),
    # two characters are left after the prefix: no mention in them, so the sentence is one
    ("History of MI.", [("History of MI", 0, 13, "History of MI", None, None, None, "PRESENT", "PATIENT")]),
    ("Plan: none", []),
    ("BP 120/80", [("BP 120", 0, 6, "blood pressure", None, None, None, "PRESENT", "PATIENT")]),
    ("Acute mildly bilateral effusion", [("Acute mildly bilateral effusion", 0, 31, "effusion", "mild", "bilateral", "acute", "PRESENT", "PATIENT")]),
    ("ok", []),
    ("Assessment: HTN, DM, COPD.", [("HTN", 12, 15, "hypertension", None, None, None, "PRESENT", "PATIENT"), ("DM", 17, 19, "diabetes mellitus", None, None, None, "PRESENT", "PATIENT"), ("COPD", 21, 25, "obstructive pulmonary disease", None, None, "chronic", "PRESENT", "PATIENT")]),
    (None, []),
    ("", []),
]


def test_golden_notes(spark):
    notes = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(GOLDEN)], "note_id long, text string")
    got = {}
    for r in extract.note_mentions(notes).orderBy("start").collect():
        got.setdefault(r.note_id, []).append((r.text, r.start, r.end, r.normalized_text, r.severity, r.laterality, r.temporality, r.assertion, r.subject))
    for k, (text, want) in enumerate(GOLDEN):
        assert got.get(k, []) == want, text


def test_mentions_keep_their_offsets(spark):
    rng = random.Random(3)
    parts = ["a b", "Plan:", ",", "/", ";", "|", "(", ")", "-", "\t", "of the", "and", "or", "pain", "type", "Start date", "   ", "é", "\x01", "MI", "Skin: x"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))).strip()) for k in range(800)]
    df = spark.createDataFrame([r for r in rows if len(r[1]) > 3], "k long, s string")
    for r in df.withColumn("m", mentions(F.col("s"), F.lit(""))).collect():
        assert r.m, r.s
        for text, a, b in r.m:
            assert r.s[a:b] == text and 0 <= a < b <= len(r.s)


def test_pieces_with_many_parts(spark):
    """More parts than a chunk of offsets, and characters beyond the basic plane."""
    text = "".join(f"né{k}\U0001f600 sentence{'.;!'[k % 3]} " for k in range(700))
    got = spark.createDataFrame([(1, text)], "note_id long, text string")
    rows = extract.sentences(got).collect()
    assert len(rows) == 700 and all(text[r.start : r.end] == r.sentence for r in rows)
    found = got.select(F.explode(X.expansions(F.lit("HTN " * 200 + "dm DM é HTNx COPD"))).alias("x")).select("x.*").collect()
    assert [r.original for r in found] == ["HTN"] * 200 + ["DM", "COPD"] and found[-1].start == 800 + 13


def test_dictionary_with_other_keys(spark):
    d = {"b/l": "bilateral", "s p": "status post", "C-section": "cesarean section", "MI": "myocardial infarction", "zz": "no"}
    row = spark.range(1).select(X.expand(F.lit("B/L pain, S P c-section; MI mi zz ZZ"), d).alias("e"), X.expansion_of(F.lit(" zz "), d).alias("t"), X.is_abbreviation(F.lit("q"), d).alias("q")).first()
    assert tuple(row) == ("bilateral pain, status post cesarean section; myocardial infarction mi zz ZZ", "no", False)


def test_mentions_are_substrings_of_notes(spark, sf_dir):
    m = extract.note_mentions(Q.notes(spark, sf_dir)).join(Q.notes(spark, sf_dir).select("note_id", F.col("text").alias("note")), "note_id")
    assert m.filter(F.substr("note", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")).count() == 0


def test_ivf_recall(spark, sf_dir):
    assert Q.vector_ivf_recall(spark, sf_dir).first()[0] >= 0.9


def test_topk_in_blocks_is_the_same(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    base, q = e.select(F.col("vec_id").alias("concept_row"), F.col("embedding").alias("v")), e.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    rows = lambda d: sorted(map(tuple, d.select("query_id", "rank", "concept_row").collect()))
    assert rows(vector.exact_topk(q, base.repartition(5), 4)) == rows(vector.exact_topk(q, base, 4, query_block=7, base_block=11))


def test_greedy_merge_follows_the_representative(spark):
    rows = [(1, 0, 10, "alpha", "P", 0.5, "x"), (1, 1, 10, "bravo", "P", 0.9, "y"), (1, 2, 11, "charlie", "P", 0.4, "z"), (1, 30, 35, "delta", "P", 0.95, "x"), (2, 0, 4, "echo", "P", 0.3, "x")]
    got = silver.merge(spark.createDataFrame(rows, "note_id long, start int, end int, text string, label string, score double, teacher string")).orderBy("note_id", "start").collect()
    assert [(r.text, r.teacher_count, round(r.score, 6)) for r in got] == [("bravo", 3, 1.0), ("delta", 1, 0.95), ("echo", 1, 0.3)]
    assert silver.kept(spark.createDataFrame(got)).count() == 2


def test_spans_without_overlap(spark):
    assert np.array_equal(vector.best(np.array([[1.0, 2, 2, 2]]), np.array([[9, 8, 7, 6]]), 2)[1], [[6, 7]])
    df = spark.sql("select array(named_struct('start', -1, 'end', -1), named_struct('start', 3, 'end', 3), named_struct('start', 5, 'end', 9), named_struct('start', 0, 'end', 4), named_struct('start', 0, 'end', 7), named_struct('start', 7, 'end', 8)) as s")
    assert [tuple(x) for x in df.select(review.non_overlapping(F.col("s"))).first()[0]] == [(0, 7), (7, 8)]


def test_files(spark, tmp_path):
    d = tmp_path / "notes"
    d.mkdir()
    (d / "b.TXT").write_bytes("né x".encode())
    (d / "a.txt").write_text("hello")
    (d / "c.md").write_text("no")
    rows = files.notes(spark, str(d), max_bytes=2).collect()
    assert sorted((r.note_type, r.bytes_read, r.text) for r in rows) == [("a", 2, "he"), ("b", 2, "n")]
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    lines = [x for f in sorted(glob.glob(f"{tmp_path}/j/*.json")) for x in open(f).read().splitlines()]
    assert [json.loads(x) for x in lines] == [{"a": 1, "b": None}]
    assert files.jsonl(spark, str(tmp_path / "j"), "a int, b string").first().a == 1
    files.write_csv(spark.createDataFrame([("a\"b", "c")], "x string, y string").coalesce(1), str(tmp_path / "c"))
    assert open(glob.glob(f"{tmp_path}/c/*.csv")[0]).read() == '"x","y"\n"a""b","c"\n'
    (tmp_path / "arr.json").write_text('["p", "q", "r"]')
    assert [r.item for r in files.positional(spark, str(tmp_path / "arr.json"), spark.createDataFrame([(0,), (2,)], "pos int")).orderBy("pos").collect()] == ["p", "r"]
    (tmp_path / "MRSTY.RRF").write_text('C0000005|T116|"x|\nbad\nC0000007|T121|\n')
    assert sorted(map(tuple, terminology.mrsty(terminology.lines(spark, str(tmp_path / "MRSTY.RRF"))).collect())) == [(5, 116), (7, 121)]


def test_stream_reads_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    go = lambda: run_available(spark, str(src), "note_file string, text string", str(tmp_path / "ck"), str(tmp_path / "out"), lambda df: df.withColumn("n", F.char_length("text")))
    (src / "1.json").write_text('{"note_file": "a", "text": "xy"}\n\n')
    go()
    (src / "2.json").write_text('{"note_file": "b", "text": "z"}\n')
    go()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.note_file, r.n) for r in out.collect()) == [("a", 2), ("b", 1)]
    assert pending(spark.createDataFrame([("a",), ("c",)], "note_file string"), out).first().note_file == "c"


def test_insert_lines(spark):
    df = spark.createDataFrame([("INSERT INTO PREFTERM VALUES(5,'Crohn''s, acute')",), ("CREATE TABLE x",), ("INSERT INTO PREFTERM VALUES(6,'a','')",), ("INSERT INTO PREFTERM VALUES(7, '''a, b''s')",), ("INSERT INTO PREFTERM VALUES(8,)",), ("INSERT INTO PREFTERM VALUES(9,'open, quote)",)], "line string")
    assert [r[0] for r in df.select(terminology.insert_values(F.col("line"), "PREFTERM")).collect()] == [["5", "Crohn''s, acute"], None, ["6", "a", ""], ["7", "a, b''s"], ["8"], ["9", "open, quote"]]


def test_tokens(spark):
    row = spark.sql("select '' as e, 'A/b  a' as t").select(X.jaccard(X.token_set(F.col("e")), X.token_set(F.col("e"))), silver.lexical(F.col("e"), F.col("t")), X.space_tokens(F.col("t"))).first()
    assert tuple(row) == (1.0, 0.0, ["a", "b"])


def test_concepts_of_notes(spark):
    extract_concepts = concepts.extract_concepts
    notes = spark.createDataFrame([(1, "Patient denies HTN. Severe left knee pain. Hypertension, no."), (2, None), (3, "zzzz qqqq")], "note_id long, text string")
    rows = extract_concepts(notes, Q.term_concepts(spark), ExtractOptions(threshold=0.9, include_candidates=True)).collect()
    got = {(r.note_id, r.text, r.preferred_term, r.assertion, r.severity, r.laterality) for r in rows}
    assert got == {(1, "HTN", "hypertension", "ABSENT", None, None), (1, "Severe left knee pain", "knee pain", "PRESENT", "severe", "left"), (1, "Hypertension", "hypertension", "PRESENT", None, None)}
    assert all(r.candidates[0]["score"] >= r.candidates[-1]["score"] for r in rows)
    assert bias_map("diso=0.1, T184=-1") == {"DISO": 0.1, "T184": -1.0}
    assert [tui_key(x) for x in ("184", " t7", "x")] == ["T184", "T007", "X"]
    for bad in ({"threshold": 2}, {"top_k": 0}, {"lexical_weight": 6}):
        with pytest.raises(ValueError):
            ExtractOptions(**bad)
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    assert extract_concepts(notes, Q.term_concepts(spark), ExtractOptions(threshold=0.9, relation_rerank=True), edges).count() == 3


def brute_relations(mentions_, cands, edges, o):
    """The second pass by loops: mentions_ (id, sentence), cands of each as (row, sim, rerank, lex) by rank, first choices made before."""
    first = {}
    for m, _ in mentions_:
        best = (0, cands[m][0][1], cands[m][0][1])
        for k, (_, sim, rr, _) in enumerate(cands[m]):
            if sim >= o.threshold and sim >= cands[m][0][1] - o.rerank_margin and rr > best[2] + 1e-12:
                best = (k, sim, rr)
        first[m] = best
    out = {}
    for m, s in mentions_:
        rows = {cands[x][first[x][0]][0] for x, y in mentions_ if y == s} - {cands[m][first[m][0]][0]}
        best = first[m]
        for k, (row, sim, rr, _) in enumerate(cands[m]):
            own = [d for a, d in edges if a == row]
            hits = sum(d in rows for d in own) if len(own) <= o.relation_max_degree else 0
            if sim < o.threshold or sim < cands[m][0][1] - o.rerank_margin or (cands[m][first[m][0]][3] >= 0.999 and k != first[m][0]):
                continue
            if rr + o.relation_weight * hits > best[2] + 1e-12:
                best = (k, sim, rr + o.relation_weight * hits)
        out[m] = (best[0], round(best[2], 6))
    return out


def test_relations_against_brute_force(spark):
    from conceptmill.operators import rerank

    rng = random.Random(8)
    o = ExtractOptions(threshold=0.5, relation_rerank=True, relation_weight=0.02, relation_max_degree=6)
    mentions_ = [(m, m // 4) for m in range(40)]
    words = ["knee pain", "pain", "fever", "chest pain"]
    cands, rows = {}, []
    for m, s in mentions_:
        sims = sorted((round(rng.uniform(0.55, 0.62), 4) for _ in range(5)), reverse=True)
        for k, sim in enumerate(sims):
            rows.append((m, s, k, rng.randrange(12), sim, "knee pain", "knee pain", rng.choice(words), "T184", "DISO"))
    c = rerank.scored(spark.createDataFrame(rows, "mention_id long, sentence_id long, rank int, concept_row long, score double, raw string, expanded string, prefterm string, tui string, semantic_group string"), o)
    for r in c.orderBy("mention_id", "rank").collect():
        cands.setdefault(r.mention_id, []).append((r.concept_row, r.score, r.rerank, r.lex))
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(50)]
    picked = rerank.choose(c, o)
    chosen = c.join(picked.select("mention_id", "rank"), ["mention_id", "rank"]).select("sentence_id", "mention_id", "concept_row")
    hit = rerank.relation_hits(c, chosen, spark.createDataFrame(edges, "src long, dst long"), o.relation_max_degree)
    got = {r.mention_id: (r["rank"], round(r.rerank_score, 6)) for r in rerank.choose_again(picked, hit, o).collect()}
    want = brute_relations(mentions_, cands, edges, o)
    assert got == want and any(want[m][0] != 0 for m in want)


def test_options_of_an_extraction(spark):
    notes = spark.createDataFrame([(1, "Patient denies HTN. Severe left knee pain, fever"), (2, "asthma"), (3, "zzzz qqqq")], "note_id long, text string")
    terms = Q.term_concepts(spark)
    rows = concepts.extract_concepts(notes, terms, ExtractOptions(threshold=0.9, include_candidates=True, use_model_labels=True), labeler=lambda s: (F.lit("POSSIBLE"), F.lit("OTHER")))
    found = rows.collect()
    assert {(r.text, r.assertion, r.subject) for r in found} == {("HTN", "ABSENT", "PATIENT"), ("Severe left knee pain", "POSSIBLE", "OTHER"), ("fever", "POSSIBLE", "OTHER"), ("asthma", "POSSIBLE", "OTHER")}
    for n in (1, 2):
        s = [r.score for r in found if r.note_id == n]
        assert s == sorted(s, reverse=True)
    assert all(set(r.candidates[0].asDict()) == set("rank cui preferred_term tui semantic_group score lex meets_threshold relation_hits bias penalty rerank_score".split()) for r in found)
    batch = {r.note_id: r for r in concepts.batch_results(notes, rows).collect()}
    assert [batch[n]["count"] for n in (1, 2, 3)] == [3, 1, 0] and batch[1].extractions[0].score >= batch[1].extractions[2].score
    assert json.loads(concepts.as_json(rows).filter("note_id = 2").first().json)["severity"] is None
    single = concepts.extract_single(spark.createDataFrame([(5, "knee pain")], "note_id long, text string"), terms).collect()
    assert [(r.text, r.preferred_term) for r in single] == [("knee pain", "knee pain")]
    o = ExtractOptions(group_bias={"DISO": 0.5}, tui_bias={"47": 1.0})
    assert o.biases()[0]["DISO"] == 0.5 and o.biases()[1]["T047"] == 1.0 and ExtractOptions(clinical_rerank=False, tui_bias={"47": 1.0}).biases() == ({}, {"47": 1.0})
    with pytest.raises(ValueError):
        concepts.extract_concepts(notes, terms, ExtractOptions(relation_rerank=True))


def test_highlighting(spark):
    df = spark.createDataFrame([("abcdefghij", [(0, 2), (4, 6), (5, 9), (8, 20), (3, 3)], ["X", "Y"])], "t string, s array<struct<start:int,end:int>>, p array<string>")
    kept = df.withColumn("k", review.non_overlapping(view.valid(F.col("s"), F.char_length("t")))).withColumn("g", view.segments(F.col("t"), F.col("k")))
    row = kept.select("g", F.transform("g", lambda x: view.displayed(x, F.col("p"))).alias("shown")).first()
    assert [(x.text, x.at) for x in row.g] == [("ab", 0), ("cd", None), ("ef", 1), ("ghij", None)] and row.shown == ["X", "cd", "Y", "ghij"]
    assert "".join(x.text for x in kept.select(view.segments(F.lit("abc"), F.array().cast("array<struct<start:int,end:int>>")).alias("g")).first().g) == "abc"


def test_other_files(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 2}\n')
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 3}\n')
    (tmp_path / "c.txt").write_text("x")
    assert [r.a for r in files.jsonl_all(spark, str(tmp_path), "a int").orderBy("seq").collect()] == [1, 3, 2]
    (tmp_path / "m.json").write_text('{"cuis": [7, 9], "prefterms": ["x", "y"], "embedding_dim": 2}')
    assert [tuple(r) for r in files.metadata(spark, str(tmp_path / "m.json")).orderBy("concept_row").collect()] == [(0, 7, "x", 2), (1, 9, "y", 2)]
    (tmp_path / "d.json").write_text('{"HTN": "hypertension", "q": "short"}')
    assert files.dictionary(spark, str(tmp_path / "d.json")) == {"HTN": "hypertension"}
    (tmp_path / "arr.json").write_text('["p", "q"]')
    with pytest.raises(Exception, match="no item 5"):
        files.positional(spark, str(tmp_path / "arr.json"), spark.createDataFrame([(5,)], "pos int")).collect()
    np.save(tmp_path / "v.npy", np.arange(12, dtype=np.float32).reshape(6, 2))
    v = files.npy(spark, str(tmp_path / "v.npy"))
    assert [(r.concept_row, list(r.v)) for r in v.orderBy("concept_row").collect()] == [(k, [2.0 * k, 2.0 * k + 1]) for k in range(6)]
    vector.checked(v, 2, 6)
    for args in ((3,), (2, 7)):
        with pytest.raises(ValueError):
            vector.checked(v, *args)
    with pytest.raises(ValueError):
        vector.checked(v.filter("concept_row <> 1"), 2)
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "concept_row long, text string")
    out = f"{tmp_path}/vectors"
    files.append_vectors(texts.filter("concept_row < 3"), concepts.ngram_vector, out)
    files.append_vectors(texts, concepts.ngram_vector, out)
    assert sorted(r.concept_row for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    files.write_json_array(texts.coalesce(1), f"{tmp_path}/array")
    assert [x["text"] for f in glob.glob(f"{tmp_path}/array/*.txt") if (t := open(f).read()) for x in json.loads(t)] == [f"t{k}" for k in range(5)]
    with pytest.raises(Exception, match="no concept has cui 4"):
        etl.synonym_rows(texts.select(F.col("concept_row").cast("int").alias("cui"), "text"), texts.filter("concept_row < 4").withColumn("cui", F.col("concept_row").cast("int"))).collect()
    with pytest.raises(ValueError):
        review.with_candidates(spark.createDataFrame([([],)], "candidates array<int>"))
    with pytest.raises(RuntimeError):
        _elsewhere()
    rows = spark.createDataFrame([(1, 0, 4, "x", 0.5), (1, 0, 4, "y", 0.9), (1, 0, 2, "z", 0.1)], "note_id long, start int, end int, text string, score double")
    assert [m.text for m in silver.note_rows(rows).first().mentions] == ["z", "y", "x"]
    assert training.mined(spark.createDataFrame([(1, "pain and pain")], "note_id long, text string"), around=2).orderBy("start").collect()[1].window == "d pain"


def _elsewhere():
    """A session on a cluster without a shared folder."""
    from types import SimpleNamespace

    from conceptmill import staging

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    staging.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
