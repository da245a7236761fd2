import json
import random

import numpy as np
import pytest
from conceptmill.operators import concepts
from conceptmill.sources import files, json_arrays, npy
from pyspark.sql import functions as F


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def some_items():
    rng = random.Random(7)
    odd = ['a,b', '"', '\\', '\\"', ',",', '[', ']}', '{"x": [1,2]}', "é,日本", "", " ", "\n,\t", "\\\\,", "x" * 200, 'y,' * 90, " "]
    items = [rng.choice(odd) + rng.choice(odd) for _ in range(150)]
    return items


@pytest.mark.parametrize("space", [None, 1, (",", ":"), (" , ", " : ")])
def test_array_in_splits_of_64_bytes(spark, tmp_path, tiny_splits, space):
    items = some_items()
    kw = {"indent": space} if not isinstance(space, tuple) else {"separators": space}
    (tmp_path / "a.json").write_text(json.dumps(items, ensure_ascii=False, **kw))
    assert spark.read.option("lineSep", ",").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 20
    got = json_arrays.array(spark, str(tmp_path / "a.json"), "string").collect()
    assert sorted((r.pos, r.item) for r in got) == list(enumerate(items))


def test_objects_arrays_and_numbers(spark, tmp_path, tiny_splits):
    rows = [{"k": k, "s": f"{k},[\"", "n": [[k], [], {"d": [k, k]}]} for k in range(40)]
    (tmp_path / "o.json").write_text(json.dumps(rows))
    got = json_arrays.array(spark, str(tmp_path / "o.json"), "struct<k:int,s:string>").collect()
    assert sorted((r.pos, r.item.k, r.item.s) for r in got) == [(k, k, f"{k},[\"") for k in range(40)]
    raw = sorted((r.pos, json.loads(r.value)) for r in json_arrays.items(spark, str(tmp_path / "o.json")).collect())
    assert raw == list(enumerate(rows))
    (tmp_path / "n.json").write_text("[1, 2,3,\n null ,4]")
    assert sorted((r.pos, r.item) for r in json_arrays.array(spark, str(tmp_path / "n.json"), "int").collect()) == [(0, 1), (1, 2), (2, 3), (3, None), (4, 4)]
    for text in ("[]", " [ ] ", "[\n]"):
        (tmp_path / "e.json").write_text(text)
        assert json_arrays.items(spark, str(tmp_path / "e.json")).count() == 0


def test_arrays_under_keys(spark, tmp_path, tiny_splits):
    terms = some_items()
    meta = {"x": {"prefterms": [1, 2]}, "prefterms": terms, "note": "\"prefterms\": [", "cuis": list(range(len(terms))), "embedding_dim": 7, "tail": [[3], [4, 5]], "none": []}
    (tmp_path / "m.json").write_text(json.dumps(meta))
    path = str(tmp_path / "m.json")
    assert sorted((r.pos, r.item) for r in json_arrays.array(spark, path, "string", "prefterms").collect()) == list(enumerate(terms))
    assert sorted((r.pos, r.item) for r in json_arrays.array(spark, path, "array<int>", "tail").collect()) == [(0, [3]), (1, [4, 5])]
    assert json_arrays.items(spark, path, "none").count() == 0 and json_arrays.items(spark, path, "absent").count() == 0
    got = files.metadata(spark, path).orderBy("concept_row").collect()
    assert [(r.concept_row, r.cui, r.prefterm, r.embedding_dim) for r in got] == [(k, k, t, 7) for k, t in enumerate(terms)]
    (tmp_path / "bad.json").write_text(json.dumps({"cuis": [1, 2], "prefterms": ["a"], "embedding_dim": 1}))
    with pytest.raises(Exception, match="differ at 1"):
        files.metadata(spark, str(tmp_path / "bad.json")).collect()


def test_positions_are_an_equi_join(spark, tmp_path, tiny_splits):
    items = some_items()
    (tmp_path / "a.json").write_text(json.dumps(items))
    wanted = spark.createDataFrame([(3,), (149,), (0,)], "pos int")
    got = json_arrays.positional(spark, str(tmp_path / "a.json"), wanted)
    assert sorted((r.pos, r.item) for r in got.collect()) == [(k, items[k]) for k in (0, 3, 149)]
    assert "Nested" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="no item 150"):
        json_arrays.positional(spark, str(tmp_path / "a.json"), spark.createDataFrame([(150,)], "pos int")).collect()


def test_arrays_are_written_line_by_line(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('",\\é'), "id")).alias("t"))
    json_arrays.write(rows.repartition(3), f"{tmp_path}/out")
    made = [json.loads(p.read_text()) for p in tmp_path.glob("out/part-*")]
    assert sorted((x["id"], x["t"]) for m in made for x in m) == [(r.id, r.t) for r in rows.collect()] and len(made) == 3
    json_arrays.write(rows.filter("id < 0").coalesce(1), f"{tmp_path}/none")
    assert [json.loads(p.read_text()) for p in tmp_path.glob("none/part-*")] == [[]]
    one = str(next(tmp_path.glob("out/part-*")))
    assert json_arrays.array(spark, one, "struct<id:long,t:string>").count() == len(json.loads(open(one).read()))


@pytest.mark.parametrize("kind", ["float32", "float16", "float64", "<i4"])
def test_vectors_of_a_file(spark, tmp_path, kind):
    m = (np.arange(700 * 5).reshape(700, 5) % 50).astype(kind)
    np.save(tmp_path / "v.npy", m)
    got = npy.read(spark, f"file://{tmp_path}/v.npy", rows=64)
    assert got.rdd.getNumPartitions() == 11
    assert [(r.concept_row, r.v) for r in got.orderBy("concept_row").collect()] == [(k, x) for k, x in enumerate(m.astype(np.float32).tolist())]


def test_what_is_no_matrix(spark, tmp_path):
    (tmp_path / "bad.npy").write_bytes(b"not numbers")
    np.save(tmp_path / "one.npy", np.arange(4.0))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "cut.npy", np.ones((3, 2)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-8])
    for name, says in (("bad", "is not an .npy file"), ("one", "must hold a matrix"), ("columns", "by rows"), ("cut", "ends before")):
        with pytest.raises(Exception, match=says):
            npy.read(spark, str(tmp_path / f"{name}.npy")).collect()
    np.save(tmp_path / "none.npy", np.ones((0, 2)))
    assert npy.read(spark, str(tmp_path / "none.npy")).count() == 0


def test_folder_of_parts_is_written_and_resumed(spark, tmp_path):
    texts = spark.createDataFrame([(7 * k, f"t{k}") for k in range(50)], "concept_row long, text string").repartition(3)
    out = f"file://{tmp_path}/vectors"
    npy.append_missing(texts.filter("concept_row < 100"), concepts.ngram_vector, out, F.col("text"))
    before = {r.concept_row: r.v for r in npy.read(spark, out).collect()}
    assert sorted(before) == [7 * k for k in range(15)]
    (tmp_path / "vectors" / "_part-left.npy").write_bytes(b"by a task that was lost")
    npy.append_missing(texts, concepts.ngram_vector, out, F.col("text"))
    got = {r.concept_row: r.v for r in npy.read(spark, out).collect()}
    assert sorted(got) == [7 * k for k in range(50)] and {k: got[k] for k in before} == before
    assert [p.name for p in (tmp_path / "vectors").glob("_*")] == ["_part-left.npy"]
    npy.append_missing(texts, concepts.ngram_vector, out, F.col("text"))
    assert npy.read(spark, out).count() == 50
    half = f"file://{tmp_path}/half"
    npy.append(npy.read(spark, out), half, "float16")
    assert {np.load(p).dtype for p in (tmp_path / "half").glob("*.npy")} == {np.dtype("float16")}
    with pytest.raises(Exception, match="different lengths"):
        npy.append(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "concept_row long, v array<float>").coalesce(1), f"file://{tmp_path}/odd")
    np.save(tmp_path / "half" / "part-z.npy", np.ones((1, 3)))
    with pytest.raises(Exception, match="different lengths"):
        npy.read(spark, half).count()
