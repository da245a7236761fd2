import os
import random

import duckdb
import numpy as np
import pytest
from conceptmill import constants as K
from conceptmill.functions import text as X
from conceptmill.operators import dictionary, vector, vector_index
from conceptmill.plans import queries as Q
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    m = np.random.default_rng(5).normal(size=(400, 8)).astype(np.float32)
    return spark.createDataFrame([(k, v) for k, v in enumerate(m.tolist())], "concept_row long, v array<float>"), m


def hits(found):
    return sorted((r.query_id, r.rank, r.concept_row) for r in found.collect())


def test_index_is_stored_and_searched_by_lists(spark, tmp_path, vectors):
    base, m = vectors
    path = f"file://{tmp_path}/index"
    vector_index.build(base.filter("concept_row < 300"), path, nlist=12, nprobe=3)
    vector_index.append(base, path)
    vector_index.append(base, path)  # again: nothing is new
    index = vector_index.open_index(spark, path, dim=8, rows=400)
    assert (index.nlist, index.rows, index.nprobe) == (12, 400, 3)
    c = np.stack([r.c for r in index.centroids.orderBy("list_id").collect()])
    near = {k: int(((v - c) ** 2).sum(1).argmin()) for k, v in enumerate(m)}
    assert {r.concept_row: r.list_id for r in index.lists.collect() if r.concept_row >= 300} == {k: v for k, v in near.items() if k >= 300}
    q = base.filter("concept_row % 40 = 0").select(F.col("concept_row").alias("query_id"), "v")
    assert hits(vector_index.search(index, q, 5, nprobe=12)) == hits(vector.exact_topk(q, base, 5))
    some = vector_index.search(index, q, 5)
    held = {r.concept_row: r.list_id for r in index.lists.collect()}
    probes = {r: set(np.argsort(-(c @ m[r]))[:3].tolist()) for r in range(0, 400, 40)}
    want = [(r, rank, k) for r in probes for rank, k in enumerate(sorted((k for k in range(400) if held[k] in probes[r]), key=lambda k: (-float(m[k].astype(float) @ m[r].astype(float)), k))[:5])]
    assert hits(some) == sorted(want)


def test_only_probed_lists_are_read(spark, tmp_path, vectors):
    base, _ = vectors
    path = f"file://{tmp_path}/index"
    vector_index.build(base, path, nlist=10, nprobe=1)
    index = vector_index.open_index(spark, path)
    rows = vector_index.probed(index, spark.createDataFrame([(3, 1), (3, 2)], "list_id int, query_id long"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "PartitionFilters" in plan
    assert {r.list_id for r in rows.collect()} == {3} and rows.count() == index.lists.filter("list_id = 3").count()


def test_index_that_does_not_fit(spark, tmp_path, vectors):
    base, _ = vectors
    path = f"file://{tmp_path}/index"
    vector_index.build(base, path, nlist=4)
    for args, says in (({"dim": 7}, "encoder's vectors have 7"), ({"rows": 401}, "401 rows of metadata")):
        with pytest.raises(ValueError, match=says):
            vector_index.open_index(spark, path, **args)
    with pytest.raises(ValueError, match="don't have 8"):
        vector_index.append(spark.createDataFrame([(900, [1.0])], "concept_row long, v array<float>"), path)
    base.limit(1).withColumn("concept_row", F.lit(999).cast("long")).withColumn("list_id", F.lit(1)).write.mode("append").partitionBy("list_id").parquet(f"{path}/lists")
    with pytest.raises(ValueError, match="cut short"):
        vector_index.open_index(spark, path)
    with pytest.raises(ValueError, match="a vector a row"):
        vector_index.build(base.unionByName(base), f"file://{tmp_path}/twice", nlist=4)


def test_table_of_keys_is_the_column_function(spark):
    d = {"B/L": "bilateral", "S P": "status post", "c-section": "caesarean", "MI": "infarct", "HTN": "hypertension", "HTN stage 2": "bad pressure", "zz": "never", "q": "short", "x_1": "joined", "stage 2 x": "later", "(no)": "never"}
    texts = ["B/L pain, S P c-section; MI mi zz ZZ", "HTN stage 2 x. htn  stage 2", "HTN stage 2 x_1 é HTNé éHTN", "", None, "C-SECTIONS c-section", "日本HTN HTN日", "S P S P S P", "q Q x_1X X_1", "HTN\nstage 2"]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id long, text string")
    keys = dictionary.keys_of(spark.createDataFrame(list(d.items()), "key string, value string"))
    plain = {k: v for k, v in d.items() if k != "(no)"}
    want = {r.note_id: r.e for r in notes.select("note_id", X.expand(F.coalesce("text", F.lit("")), plain).alias("e")).collect()}
    assert {r.note_id: r.expanded for r in dictionary.expand(notes, keys).collect()} == want
    places = notes.select("note_id", F.explode(X.expansions(F.coalesce("text", F.lit("")), plain)).alias("x")).select("note_id", "x.start", "x.end", "x.original", "x.expanded")
    assert sorted(map(tuple, dictionary.expansions(notes, keys).collect())) == sorted(map(tuple, places.collect()))
    none = dictionary.keys_of(spark.createDataFrame([], "key string, value string"))
    assert dictionary.expansions(notes, none).count() == 0 and {r.expanded for r in dictionary.expand(notes, none).collect()} == {t or "" for t in texts}


def test_fifty_thousand_keys(spark):
    table = spark.range(50_000).select(F.concat(F.lit("key "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " two words").otherwise("")).alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    rng = random.Random(2)
    picked = [[rng.randrange(50_000) for _ in range(40)] for _ in range(30)]
    notes = spark.createDataFrame([(k, ", ".join(f"Key {p} two words" for p in ps)) for k, ps in enumerate(picked)], "note_id long, text string")
    got = {r.note_id: r.expanded for r in dictionary.expand(notes, dictionary.keys_of(table)).collect()}
    assert got == {k: ", ".join(f"v{p}" + ("" if p % 2 == 0 else " two words") for p in ps) for k, ps in enumerate(picked)}


@pytest.mark.parametrize("name", ["dictionary_expansion", "dictionary_offsets", "stored_index_lists", "stored_index_topk", "stored_vectors", "json_array_items"])
def test_sql_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    got = Q.QUERIES[name](spark, sf_dir)
    order = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"select {order} from ({Q.ORACLE[name]})").fetchall()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert K.ABBREVIATIONS
