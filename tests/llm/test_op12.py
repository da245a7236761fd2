import hashlib
import math
import random
import re
import zlib

import duckdb
import pyarrow as pa
from conceptmill.llm import op12_resample as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(rows, targets, most=1, least=20, percent=10, seed=2024, buckets=op.BUCKETS):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, targets)):
        for x in texts:
            for f in features(x, most)[1]:
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        w, fs = features(x, most)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(key, out))


def key(r):
    return tuple(-(10**9) if x is None else x for x in list(r)[:5])


def some_rows():
    rng = random.Random(3)
    vocab = [f"W{k}É" for k in range(400)] + ["a", "B", "x-y", "9"]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 19, 20, 60, 300])))) for k in range(300)]
    return rows + [(7, rows[7][1]), (7, rows[7][1]), (None, "w " * 30), (None, "w " * 30), (900, None), (901, ""), (902, "--"), (903, "z " * 90_000), (904, "日本 語　x")]


def test_against_brute_force(spark):
    rows, targets = some_rows(), ["w1É W2é a", None, "b b 9", "語"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score int, bucket int")
    goal = spark.createDataFrame([(t,) for t in targets], "text string")
    for most in (1, 3):
        got = op.resample(docs, goal, most).collect()
        assert sorted(map(key, got)) == brute(rows, targets, most)
    half = op.resample(docs, goal, percent=50, least_words=3, seed=5).collect()
    assert sorted(map(key, half)) == brute(rows, targets, 1, 3, 50, 5)
    assert op.resample(docs.limit(0), goal).count() == 0
    assert sorted(map(key, op.resample(docs, goal.limit(0)).collect())) == brute(rows, [])


def test_many_ties_and_none_drawn(spark):
    rows = [(5, "a " * 25)] * 40 + [(4, "a " * 25)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(key, op.resample(docs, docs).collect())) == brute(rows, [t for _, t in rows])
    assert all(r.rank is None for r in op.resample(docs, docs, percent=1).collect())


def test_query_and_sql(spark, sf_dir):
    got = op.op12_resample(spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    docs, goal = (spark.read.parquet(f"{sf_dir}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    rows = sorted(map(key, got.collect()))
    assert rows == brute([(r.doc_id, r.text) for r in docs], [r.text for r in goal])
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"create view {n} as select * from '{sf_dir}/{n}.parquet'")
    assert sorted(map(key, con.execute(op.ORACLE).fetchall())) == rows


def test_features_of_slices():
    texts = pa.array(["a b", "C d e", "", "f"])[1:]
    hashes, owner, n = op.hashed_features(texts, 2)
    want = [zlib.crc32(x.encode()) for x in ("c", "d", "e", "f", "c d", "d e")]
    assert hashes.tolist() == want and owner.tolist() == [0, 0, 0, 2, 0, 0] and n.tolist() == [3, 0, 1]
