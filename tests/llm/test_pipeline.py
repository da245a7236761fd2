import random
import zlib

import corpus_pipeline as p
import numpy as np
from conceptmill.llm import op1_repair
from test_op5 import brute as leaks
from test_op8 import brute as rules
from tokenizers import Tokenizer


def fixture():
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(k, text(30)) for k in range(5)]
    rows = [(k, text(rng.randrange(60, 300)), "en", f"s{k % 4}", 0) for k in range(80)]
    copies = {200 + k: rows[k] for k in range(10)}
    rows += [(i, r[1], *r[2:]) for i, r in copies.items()]
    near = {300 + k: rows[40 + k] for k in range(10)}
    for i, r in near.items():
        w = r[1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), *r[2:]))
    junk = [(400, "a b", "en", "s0", 0), (401, None, "en", "s1", 0), (402, "x # " * 100, None, None, 0), (403, "same line of words\n" * 40, "en", "s2", 0)]
    bad = [(500 + k, text(40) + " " + items[k][1] + " " + text(40), "en", "s3", 0) for k in range(5)]
    odd = [(None, text(70), "en", None, None), (600, text(80), None, "s1", None), (600, "other " + text(80), None, "s1", None)]
    return rows + junk + bad + odd, items, set(copies) | set(near)


def test_stages_against_brute_force(spark, tmp_path):
    rows, items, again = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    out = lambda df: sorted(key((r.doc_id, r.text)) for r in df.collect())

    good = p.quality(spark, docs, str(tmp_path))
    want = [r for r in rows if rules(r[1])[-1]]
    assert out(good) == sorted(map(key, want)) and good.columns == docs.columns
    single = p.near_dedup(spark, good, str(tmp_path))
    want = [r for r in want if r[0] not in again]
    assert out(single) == sorted(map(key, want)) and single.columns == docs.columns
    clean = p.decontamination(spark, single, str(tmp_path))
    held = leaks([((r[0], r[1]), r[1]) for r in want], items)
    want = [r for r in want if not held[r[0], r[1]]]
    assert out(clean) == sorted(map(key, want)) and clean.columns == docs.columns and not any(500 <= (r[0] or 0) < 505 for r in want)
    mixed = p.mixture(spark, clean, str(tmp_path))
    taken = out(mixed)
    assert mixed.columns == docs.columns and set(taken) <= set(map(key, want)) and max(map(taken.count, taken)) <= 2
    made = p.tokens(spark, mixed, str(tmp_path)).orderBy("start").collect()
    t = Tokenizer.from_file(op1_repair.default_tokenizer())
    ids = {k: [*t.encode(k[1], add_special_tokens=False).ids, 0] for k in set(taken)}
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in made) == sorted((k[0], len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) for k in taken)


def test_run_on_tables(spark, sf_dir):
    made = p.run(spark, sf_dir).collect()
    assert made and all(r.n_tokens > 0 for r in made)
    assert [name for name, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "mixture", "tokens"] and p.ORACLE_SQL is None
