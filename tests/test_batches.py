import os
import random

import duckdb
import numpy as np
import pytest
from conceptmill.operators import concepts, etl, vector
from conceptmill.plans import queries as Q
from conceptmill.streaming import incremental as S
from pyspark.sql import functions as F


def test_each_batch_goes_to_each_output_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"note_file": "a", "text": "one two"}\n{"note_file": "b", "text": "x"}\n')
    fails, calls = [True], []

    def fragile(rows):
        if fails[0]:
            raise RuntimeError("lost between two outputs")
        return rows.select("note_file", F.char_length("text").alias("n"))

    sent = []
    outputs = [
        S.Output(f"file://{tmp_path}/words", lambda b: (calls.append(1), b.select("note_file", F.explode(F.split("text", " ")).alias("w")))[1]),
        S.Output(f"file://{tmp_path}/sizes", fragile),
        S.Output(f"file://{tmp_path}/sent", lambda b: b, write=lambda b, k: sent.append((k, b.count()))),
    ]

    def go():
        stream = S.read_notes(spark, str(src), "json", "note_file string, text string")
        S.run_batches(stream, str(tmp_path / "ck"), outputs).awaitTermination()

    with pytest.raises(Exception, match="lost between"):
        go()
    assert S.written(spark, outputs[1]) is None and S.written(spark, outputs[0]).count() == 3
    # what a run that was cut short may leave
    spark.createDataFrame([("z", 9)], "note_file string, n int").write.parquet(f"{tmp_path}/sizes/batch_id=0")
    assert S.written(spark, outputs[1]).count() == 0
    fails[0] = False
    go()
    assert len(calls) == 1 and sent == [(0, 2)]
    assert sorted((r.note_file, r.n) for r in S.written(spark, outputs[1]).collect()) == [("a", 7), ("b", 1)]
    (src / "b.json").write_text('{"note_file": "c", "text": "y y"}\n')
    go()
    go()
    assert sorted((r.note_file, r.batch_id) for r in S.written(spark, outputs[0]).collect()) == [("a", 0), ("a", 0), ("b", 0), ("c", 1), ("c", 1)]
    assert sent == [(0, 2), (1, 1)]


def test_a_note_that_comes_again_counts_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out = S.Output(f"file://{tmp_path}/out", lambda b: b.select("note_file", "text"))
    for kind, key in (("text", None), ("binary", "note_file")):
        (src / f"{kind}.txt").write_bytes(b"caf\xc3\xa9 \xff." if kind == "binary" else b"plain\ntwo lines")
    for kind in ("text", "binary"):
        S.run_batches(S.read_notes(spark, str(src), kind), str(tmp_path / f"ck-{kind}"), [S.Output(f"file://{tmp_path}/{kind}", lambda b: b)]).awaitTermination()
    assert {r.note_file: r.text for r in S.written(spark, S.Output(f"file://{tmp_path}/text", None)).filter("note_file = 'text.txt'").collect()} == {"text.txt": "plain\ntwo lines"}
    row = S.written(spark, S.Output(f"file://{tmp_path}/binary", None)).filter("note_file = 'binary.txt'").first()
    assert row.bytes_read == 8 and row.text.startswith("café ") and row.text.endswith(".")
    again = tmp_path / "again"
    again.mkdir()
    for k, rows in enumerate((["a", "b"], ["b", "c"])):
        (again / f"{k}.json").write_text("".join(f'{{"note_file": "{r}", "text": "{k}"}}\n' for r in rows))
        S.run_batches(S.read_notes(spark, str(again), "json", "note_file string, text string", 1), str(tmp_path / "ck-again"), [out], key="note_file").awaitTermination()
    assert sorted((r.note_file, r.text) for r in S.written(spark, out).collect()) == [("a", "0"), ("b", "0"), ("c", "1")]


def test_pooled_means(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 5, int(rng.integers(0, 3)), rng.normal(size=4).tolist()) for k in range(200)]
    rows += [(7, 0, [1.0] * 4), (8, None, [1.0] * 4), (9, 1, None), (None, 1, [2.0] * 4)]
    got = {r.key: (r.v, r.n) for r in vector.pooled(spark.createDataFrame(rows, "key int, mask int, v array<double>").repartition(6), "key").collect()}
    for k in range(5):
        w = np.array([m for i, m, _ in rows if i == k], float)
        assert np.allclose(got[k][0], (w[:, None] * np.array([v for i, _, v in rows if i == k])).sum(0) / w.sum()) and got[k][1] == w.sum()
    assert got[7] == ([0.0] * 4, 0.0) == got[8] and got[9] == (None, 0.0) and got[None] == ([2.0] * 4, 1.0)
    plain = vector.pooled(spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0])], "key string, v array<double>"), "key", None).first()
    assert plain.v == [2.0, 4.0] and plain.n == 2.0
    assert vector.pooled(spark.createDataFrame([], "key int, mask int, v array<double>"), "key").count() == 0


def test_chunks_joined_are_the_adjacency(spark):
    rng = random.Random(1)
    edges = [(rng.choice([0, 0, 0, 1, 2, 5]), rng.randrange(50)) for _ in range(500)]
    e = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    chunks = etl.adjacency_chunks(e, 16).collect()
    assert max(len(r.neighbours) for r in chunks) == 16
    joined, starts = {}, {}
    for r in sorted(chunks, key=lambda r: (r.concept_row, r.chunk)):
        assert r.start == starts.setdefault(r.concept_row, r.start) + len(joined.setdefault(r.concept_row, []))
        joined[r.concept_row] += r.neighbours
    whole = {r.concept_row: r for r in etl.adjacency(e, spark.range(6).withColumnRenamed("id", "concept_row")).collect()}
    assert {k: (starts.get(k, v.start), joined.get(k, [])) for k, v in whole.items()} == {k: (v.start, v.neighbours) for k, v in whole.items()}
    assert sorted((r.src, r.dst) for r in etl.chunk_edges(spark.createDataFrame(chunks)).collect()) == sorted(edges)


def test_batch_with_its_figures(spark):
    terms = Q.term_concepts(spark)
    notes = spark.createDataFrame([(1, "Patient has hypertension."), (2, "")], "note_id long, text string")
    rows, meta = concepts.extract_batch(notes, terms)
    assert meta["notes"] == 2 == rows.count() and meta["count"] == sum(r["count"] for r in rows.collect()) and meta["ms"] > 0


@pytest.mark.parametrize("name", ["pooled_vectors", "relation_chunks", "streamed_totals"])
def test_sql_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    got = Q.QUERIES[name](spark, sf_dir)
    order = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"select {order} from ({Q.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stand_in_vectors_are_those_of_single_texts(spark):
    import zlib

    texts = ["", None, "a", "Left knee pain", "日本 é\U0001f600", "x" * 5000, "Left knee pain", "  "]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    for r in frame.withColumn("v", concepts.ngram_vector(F.col("t"), 16)).collect():
        t, v = f"  {(r.t or '').lower()} ", np.zeros(16)
        for k in range(len(t) - 2):
            v[zlib.crc32(t[k : k + 3].encode()) % 16] += 1
        assert r.v == (v / max(np.linalg.norm(v), 1e-12)).tolist()
