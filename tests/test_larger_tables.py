"""Queries on tables that are larger than those at hand in some respect."""

import random
import tracemalloc

import duckdb
import pandas as pd
from conceptmill.functions import text as X
from conceptmill.operators import concepts, dictionary, etl, silver, vector
from conceptmill.plans import queries as Q
from conceptmill.sources import terminology as T
from pyspark.sql import functions as F


def _tables(folder, names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet/*.parquet'")
    return con


def test_silver_links_with_part_keys_over_a_million(spark, sf_dir, tmp_path):
    far = 1_500_000
    for name, key in (("part", "p_partkey"), ("lineitem", "l_partkey"), ("orders", None)):
        rows = Q.t(spark, sf_dir, name)
        (rows.withColumn(key, F.col(key) + far) if key else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    wanted = _tables(tmp_path, ["part", "lineitem", "orders"]).sql(Q.ORACLE["silver_links"]).fetchall()
    found = [tuple(r) for r in Q.silver_links(spark, str(tmp_path)).collect()]
    assert wanted and sorted(found) == sorted(wanted)


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_edges_read_relations_once(spark):
    rel = T.mrrel(spark.createDataFrame([("C0000001|||PAR|C0000002||||||||||N|",), ("C0000001|||PAR|C0000002||||||||||Y|",), ("x|y",), (None,)], "line string"))
    known = spark.createDataFrame([(1, 10), (2, 20)], "cui int, concept_row long")
    both = etl.edges(rel, known)
    assert sorted(map(tuple, both.collect())) == [(10, 20), (20, 10)] and "Union" not in _plan(both)
    assert list(map(tuple, etl.edges(rel, known, undirected=False).collect())) == [(10, 20)]
    assert _plan(rel).count("split(") == 1


def test_jaccard_without_branches(spark):
    a, b = X.token_set(F.col("a")), X.token_set(F.col("b"))
    rows = spark.createDataFrame([("a b", "b c"), ("", ""), ("", "a"), (None, "a"), (None, None)], "a string, b string")
    out = rows.select(X.jaccard(a, b).alias("x"), silver.lexical(F.col("a"), F.col("b")).alias("y"))
    assert list(map(tuple, out.collect())) == [(1 / 3, 1 / 3), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (1.0, 0.0)]
    assert "CASE WHEN" not in _plan(out)


def test_only_windows_of_known_keys_leave_a_task(spark):
    notes = spark.createDataFrame([(1, "No htn, chest  pain or Chest Pain."), (2, None)], "note_id int, text string")
    wanted = {"HTN": ["HTN"], "CHEST": ["CHEST PAIN"]}
    found = dictionary._windows(notes, [1, 3], "note_id", "text", wanted).collect()
    assert sorted(map(tuple, found)) == [(1, "CHEST PAIN", 23, 33, "Chest Pain"), (1, "HTN", 3, 6, "htn")]


def test_scores_held_at_once_are_bounded():
    assert all(vector._step(n) * n <= vector._SCORES for n in (1, 300, 4096, 16_384)) and vector._step(0) == vector._step(1) == 2048


def test_long_texts_are_embedded_in_bounded_memory():
    rng = random.Random(3)
    texts = pd.Series(["".join(rng.choices("abcdefgh ", k=50_000)) for _ in range(200)] + [None, ""])
    tracemalloc.start()
    found = concepts.ngram_vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    assert found == [concepts.ngram_vectors(pd.Series([t]))[0] for t in texts]


def test_many_queries_of_a_small_base_are_not_moved(spark):
    rng = random.Random(4)
    vectors = lambda n: [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(8)]) for i in range(n)]
    q = spark.createDataFrame(vectors(vector.QUERY_BLOCK + 100), "query_id long, v array<double>")
    base = spark.createDataFrame(vectors(50), "concept_row long, v array<double>")
    found = vector.exact_topk(q, base, 4)
    assert "CoGroup" not in _plan(found) and "Window" not in _plan(found)
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    wanted = rows(vector.exact_topk(q, base, 4, query_block=1000))
    assert rows(found) == wanted
    near = {r[0] for r in wanted if r[1] == 0 and r[3] >= 5}
    assert near and rows(vector.exact_topk(q, base, 4, least=5.0)) == [r for r in wanted if r[0] in near]


def test_notes_of_one_row_group_are_dealt_over_tasks(spark, sf_dir):
    found = Q.note_mentions(spark, sf_dir)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
