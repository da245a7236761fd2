import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conceptmill.llm import links
from conceptmill.llm import op13_minhash as op
from conceptmill.llm.components import components


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {k for x in s for k in holders[x] if k < i}:
            both = len(s & sets[j])
            if label[i] != label[j] and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted(key((i, len(s), least.get(x), i == least.get(x))) for (i, _), s, x in zip(rows, sets, label, strict=True))


def key(r):
    return tuple(-1 if x is None else x for x in r)


def some_rows():
    rng = random.Random(11)
    vocab = [f"W{k}É" for k in range(500)]
    rows = []
    for k in range(80):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 30, 200, 500]))]
        rows.append((k, " ".join(words)))
        for c in range(rng.choice([0, 1, 4])):
            other = list(words)
            for _ in range(rng.choice([0, 1, len(words) // 80, len(words) // 40])):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            rows.append((1000 + 10 * k + c, "\n".join(other).upper().replace("É", "É")))
    return rows + [(9000, None), (9001, ""), (9002, " \t"), (None, rows[0][1]), (None, "only null"), (3, rows[3][1]), (3, rows[3][1]), (9003, "z " * 90_000), (9004, "日本 語")]


def test_against_brute_force(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, node int, h string")
    assert sorted(map(key, op.minhash_components(docs).collect())) == brute(rows)
    assert sorted(map(key, op.minhash_components(docs, percent=95).collect())) == brute(rows, 95)
    assert op.minhash_components(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        op.minhash_components(docs, percent=80)


def test_large_groups_go_by_pivots_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 6)
    rng = random.Random(2)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for k in range(60):  # a third are near copies, others share a passage or drift away step by step
        words = list(base)
        if k % 3:
            words[: 40 * (k % 5)] = [f"own{k}.{j}" for j in range(40 * (k % 5))]
        words[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(words)))
    drift = [f"d{k}" for k in range(200)]
    for k in range(40):
        drift[5 * k : 5 * k + 5] = [f"n{k}.{j}" for j in range(5)]
        rows.append((100 + k, " ".join(drift)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(key, op.minhash_components(docs).collect())) == brute(rows)


def test_query_and_sql(spark, sf_dir):
    got = op.op13_minhash(spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = sorted(map(key, got.collect()))
    assert rows == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(map(key, con.execute(op.ORACLE).fetchall())) == rows


def test_signatures_estimate_similarity_and_matches_lose_little():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 40_000, np.uint64)
    agree = []
    for k in range(60):
        both, own = pool[200 * k : 200 * k + 170], pool[20_000 + 100 * k :]
        a, b = (np.sort(np.concatenate([both, own[x : x + 15]])) for x in (0, 15))
        s = op.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 0.85) < 0.02
    lost = sum(math.comb(op.COORDINATES, k) * 0.85**k * 0.15 ** (op.COORDINATES - k) for k in range(op.MATCHES))
    assert lost < 1 / 110_000


def test_group_links_are_the_pairs_components(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 5)
    rng = random.Random(9)
    rows = [(g, 100 * g + k, bytes([rng.randrange(60)])) for g in range(6) for k in range((1, 2, 5, 30, 40, 3)[g])]
    near = lambda a, i, b, j: np.abs(np.array([x[0] for x in a.to_pylist()])[i] - np.array([x[0] for x in b.to_pylist()])[j]) <= 1
    frame = spark.createDataFrame(rows, "group long, node long, data binary")
    got = {r.node: r.component for r in components(links.group_links(frame, near, links.near_pairs(near))).collect()}
    label = {n: n for _, n, _ in rows}
    for g, n, d in rows:
        for g2, n2, d2 in rows:
            if g == g2 and abs(d[0] - d2[0]) <= 1 and label[n] != label[n2]:
                a, b = sorted((label[n], label[n2]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert {n: got.get(n, n) for n in label} == label
    assert links.group_links(frame.limit(0), near, links.near_pairs(near)).count() == 0


def test_runs_are_not_cut():
    batches = [pa.RecordBatch.from_pydict({"k": pa.array([i // 7] * 1 + [i // 7 + 0], pa.int64()), "v": pa.array([i, i])}) for i in range(40)]
    tables = list(links._runs(iter(batches), 1, 64))
    seen = [set(t.column("k").to_pylist()) for t in tables]
    assert len(tables) > 2 and sum(map(len, seen)) == len(set().union(*seen)) and sum(t.num_rows for t in tables) == 80
