import random
import re
import statistics

import pytest
from conceptmill import constants as K
from conceptmill.operators import evaluate, fold, ordinal, review, silver
from conceptmill.plans import queries as Q
from pyspark.sql import functions as F

VOTE = "note_id long, start int, end int, text string, label string, score double, teacher string, seq long, normalized string"


def brute_usable(rows, least, by_teacher):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["seq"]):
        key = (r["note_id"], r["start"], r["end"], r["text"].strip().lower(), r["teacher"])
        if r["score"] >= by_teacher.get(r["teacher"], least) and 0 <= r["start"] < r["end"] and r["text"].strip() and key not in seen:
            seen.add(key)
            out.append(r)
    return out


def brute_merge(rows, overlap=0.8, bonus=0.08):
    """Every span against every cluster of its note, whole clusters sorted at each step."""
    clusters = {}
    for m in sorted(rows, key=lambda m: (m["start"], m["end"], -m["score"], m["teacher"], m["text"])):
        for c in clusters.setdefault(m["note_id"], []):
            r = c[0]
            inter = min(m["end"], r["end"]) - max(m["start"], r["start"])
            if inter > 0 and inter / min(m["end"] - m["start"], r["end"] - r["start"]) >= overlap:
                c.append(m)
                c.sort(key=lambda x: (-x["score"], x["end"] - x["start"], x["start"]))
                break
        else:
            clusters[m["note_id"]].append([m])
    out = []
    for note, cs in clusters.items():
        for c in cs:
            names, top = sorted({m["teacher"] for m in c}), max(m["score"] for m in c)
            r = c[0]
            out.append((note, r["start"], r["end"], r["text"], (r["normalized"] or r["text"]).strip(), names, round(top, 6), round(sum(m["score"] for m in c) / len(c), 6), round(min(1.0, top + bonus * (len(names) - 1)), 6)))
    return sorted(out)


def shown(merged):
    return sorted((r.note_id, r.start, r.end, r.text, r.normalized, r.teachers, round(r.max_score, 6), round(r.mean_score, 6), round(r.score, 6)) for r in merged.collect())


def some_votes():
    rng = random.Random(8)
    rows = []
    for k in range(1500):
        a = rng.randrange(400)
        n = rng.choice([1, 3, 8, 9, 10, 40])
        rows.append((rng.randrange(4), a, a + n, rng.choice(["a b", "A b ", "long", " "]) + str(n % 3 or ""), "L", (rng.randrange(1000) * 2048 + k) / 2**21, rng.choice("xyz"), k, rng.choice([None, " norm ", ""])))
    return rows + [(1, -1, 4, "x", "L", 0.9, "x", 2000, None), (1, 5, 5, "x", "L", 0.9, "x", 2001, None), (9, 0, 3, "one", None, 0.95, "z", 2002, None), (9, 0, 3, "ONE", None, 0.96, "z", 2003, None)]


def test_votes_merge_as_whole_clusters_do(spark):
    names = [x.split()[0] for x in VOTE.split(", ")]
    rows = some_votes()
    votes = spark.createDataFrame(rows, VOTE).repartition(5)
    by = {"x": 0.5, "z": 0.1}
    want = brute_merge(brute_usable([dict(zip(names, r, strict=True)) for r in rows], 0.2, by))
    post = silver.usable(votes, 0.2, by_teacher=by)
    assert shown(silver.merge(post, dealt=True)) == want
    assert shown(silver.merge(post.repartition(3))) == want
    assert silver.merge(post.limit(0)).count() == 0
    marks = silver.marked(votes, 0.2, by_teacher=by)
    stats = {r.note_id: r for r in silver.note_stats(marks, silver.merge(marks.filter("usable"))).collect()}
    assert {n: (r.mentions_raw, r.mentions_merged) for n, r in stats.items()} == {n: (sum(x[0] == n for x in rows), sum(x[0] == n for x in want)) for n in {x[0] for x in rows}}


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 16])
def test_scan_is_usable_and_merge(spark, monkeypatch, chunk):
    """One pass with repeats, ties, stretches of any length and chunks of any size, against whole clusters."""
    monkeypatch.setattr(silver, "_CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(chunk, 10_000)))
    try:
        names = [x.split()[0] for x in VOTE.split(", ")]
        rng, rows = random.Random(chunk), some_votes()
        for k in range(2000):
            a = 8 * rng.randrange(2000) + rng.randrange(3)
            rows.append((rng.choice([5, 6, 7]), a, a + rng.choice([8, 9, 9, 20]), rng.choice(["a b", "A b ", "plan", "\x1cx "]), rng.choice(["L", None]), (rng.randrange(1000) * 4096 + k) / 2**22, rng.choice("xyz"), 3000 + k, rng.choice([None, " norm ", ""])))
            rows.append((8, 3, 9, f"t{k % 40}", "L", 0.5 + (k % 7) / 32, rng.choice("xyz"), 9000 - k, None))
        votes, by = spark.createDataFrame(rows, VOTE).repartition(5), {"x": 0.5, "z": 0.1}
        post = brute_usable([dict(zip(names, r, strict=True)) for r in rows], 0.2, by)
        found = silver.scan(votes, 0.2, by_teacher=by).cache()
        want = brute_merge(post)
        assert shown(found.filter("teacher_count is not null")) == want and shown(silver.scan(votes, 0.2, by_teacher=by, counts=False)) == want
        count = lambda xs: {n: sum(1 for x in xs if x == n) for n in {r[0] for r in rows}}
        raw, usable, merged = count([r[0] for r in rows]), count([r["note_id"] for r in post]), count([m[0] for m in want])
        kept = {r.note_id: r["count"] for r in silver.kept(found).groupBy("note_id").count().collect()}
        assert sorted(tuple(r) for r in silver.scan_stats(found).collect()) == sorted((n, raw[n], usable[n], merged[n], kept.get(n, 0)) for n in raw)
        assert silver.scan_stats(silver.scan(votes.limit(0))).count() == 0
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stats_and_merge_of_the_tables(spark, sf_dir):
    votes = [r.asDict() | {"normalized": None} for r in Q._votes(spark, sf_dir).collect()]
    post = brute_usable(votes, 0.2, {"two": 0.3})
    merged = brute_merge(post, bonus=0.05)

    def keep(text, teachers, top):
        head = re.sub(r"\s+", " ", re.sub(r":+$", "", re.sub(r"\s*/\s*", "/", text.strip().lower())))
        bare = re.sub("[^A-Za-z0-9]", "", text)
        return head not in K.SECTION_HEADERS and (len(bare) >= 4 or bare.upper() in K.SHORT_SPANS) and (len(teachers) >= 2 or top >= 0.9)

    count = lambda xs: {n: sum(1 for x in xs if x == n) for n in set(xs)}
    raw, post, all_, kept = (count(x) for x in ([v["note_id"] for v in votes], [v["note_id"] for v in post], [m[0] for m in merged], [m[0] for m in merged if keep(m[3], m[5], m[6])]))
    got = Q.teacher_stats(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == sorted((n, raw[n], post.get(n, 0), all_.get(n, 0), kept.get(n, 0)) for n in raw)
    post = brute_usable(votes, 0.2, {})
    want = sorted((m[0], m[1], m[2], m[3], ",".join(m[5]), m[8], m[7]) for m in brute_merge(post, bonus=0.05) if keep(m[3], m[5], m[6]))
    assert sorted(tuple(r) for r in Q.teacher_merge(spark, sf_dir).collect()) == want


def test_a_note_of_a_million_spans(spark):
    rows = spark.range(1_000_000).select(F.floor(F.col("id") / 999_990).alias("note_id"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 4).cast("int").alias("end"))
    got = fold.apart(rows, ["note_id"])
    assert got.filter("note_id = 0").agg(F.count("*"), F.sum("start")).first()[:] == (499_995, sum(range(0, 3 * 999_990, 6)))
    votes = rows.select("*", F.lit("word").alias("text"), F.lit("L").alias("label"), (F.col("start") % 7 / 10).alias("score"), (F.col("start") % 2).cast("string").alias("teacher"))
    merged = silver.merge(votes)
    assert "CollectList" not in merged._jdf.queryExecution().toString() and merged.count() == 1_000_000


def test_apart_as_arrays_do(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-2, 60), rng.randrange(-2, 70), 1) for _ in range(400)] + [("c", None, 4, 1)]
    frame = spark.createDataFrame(rows, "note string, start int, end int, extra int").repartition(4)
    got = sorted((str(r.note), r.start, r.end) for r in fold.apart(frame, ["note"]).collect())
    want = frame.groupBy("note").agg(review.non_overlapping(F.collect_list(F.struct("start", "end"))).alias("s")).collect()
    assert got == sorted((str(r.note), s.start, s.end) for r in want for s in r.s)
    assert fold.apart(frame.limit(0), ["note"]).count() == 0


def test_order_statistics(spark):
    rng = random.Random(4)
    for values in ([], [5.0], [1.0, 2.0], [3.0] * 900 + [1.0] * 900 + [2.0] * 1201, [rng.gauss(0, 1) * 10 ** rng.randrange(-30, 30) for _ in range(4001)], [1.7e308, -1.7e308, 0.0, 1.0] * 600, list(map(float, range(3000))) + [float("inf"), float("-inf")]):
        frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        assert ordinal.median(frame, "x") == (statistics.median(values) if values else None)
        ranks = {0, len(values) // 3, len(values) - 1, len(values)}
        ordered = sorted(values)
        assert ordinal.order_statistics(frame, "x", ranks, bins=16, few=5) == {r: ordered[r] if 0 <= r < len(values) else None for r in ranks}
    held = ordinal.order_statistics(spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double"), "x", [1, 2])
    assert held[1] == 2.0 and held[2] != held[2]
    assert evaluate.validation(spark.createDataFrame([], "cosine double, gold int, predicted int")).first()[:] == (None, None, None)


def test_places(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(50), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = ordinal.numbered(frame, [F.desc("a"), F.col("b")], partitions=5).collect()
    assert sorted((r.ordinal, r.a, r.b) for r in got) == [(k, a, b) for k, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))]
    assert sorted(r.b for r in ordinal.first(frame, 20, [F.col("b")]).collect()) == list(range(20))
    assert ordinal.first(frame, 0, [F.col("b")]).count() == 0 and ordinal.numbered(frame.limit(0), [F.col("b")]).count() == 0
    for k, name in enumerate("cab"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"v": "{name}{i:03d}"}}\n' for i in range(200)))
    read = spark.read.schema("v string").json(str(tmp_path))
    assert sorted((r.ordinal, r.v) for r in ordinal.in_file_order(read).collect()) == [(k, f"{'abc'[k // 200]}{k % 200:03d}") for k in range(600)]
    assert sorted(r.v for r in ordinal.first(read, 250).collect()) == sorted([f"a{i:03d}" for i in range(200)] + [f"b{i:03d}" for i in range(50)])


def test_unset_spans_of_a_review_match(spark):
    review_ = spark.createDataFrame([("n", None, None, "T", "C1"), ("n", -1, 5, "T", "C2"), ("n", 0, 3, "T", "C3")], "note_file string, start int, end int, note_type string, gold_cui string")
    run = spark.createDataFrame([("n", -1, None, "T", "C1", ["C1"], 1), ("n", None, 5, "T", "C2", ["C2"], 2), ("n", 0, 3, "T", "C9", ["C3"], 3)], "note_file string, start int, end int, note_type string, cui string, candidates array<string>, seq int")
    s = review.scores(review_, run).first()
    assert (s.n_rows, s.correct, s.wrong_link, s.gold_in_topk) == (3, 2, 1, 3)


@pytest.mark.parametrize("name", ["highlight_spans", "limited_pairs", "numbered_rows", "exact_quantiles", "run_stats", "validation_metrics"])
def test_sql_twins(spark, sf_dir, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    got = Q.QUERIES[name](spark, sf_dir)
    order = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"select {order} from ({Q.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
