import itertools
import random
import re

from conceptmill.llm import op5_decontaminate as op


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit = words(t), []
        for k, item in items:
            v = words(item)
            need = min(13, len(v))
            if need < 8:
                continue
            for shift in range(-len(v), len(w)):
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                same = [v[j] == w[j + shift] for j in range(lo, hi)]
                if any(sum(same[s : s + need]) >= need - need * 2 // 13 for s in range(len(same) - need + 1)):
                    hit.append(k)
                    break
        out[i] = sorted(hit)
    return out


def test_masks_survive_two_substitutions():
    for bad in itertools.combinations(range(op.WINDOW), op.MOST_DIFFERENT):
        assert any(all(o + s not in bad for o in m) for m in op.MASKS for s in range(op.WINDOW - m[-1]))


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"wé{k}" for k in range(50)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 9, 13, 14, 30])))) for k in range(12)] + [(50, None), (51, "")]
    docs = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(60)]
        part = items[k % 12][1].split()
        part = part[rng.randrange(3) :] if k % 4 == 0 else part
        for _ in range(k % 5):
            part[rng.randrange(len(part))] = "other"
        docs.append((k, " ".join(w[:20] + (part if k % 3 else []) + w[20:]).upper().replace(" WÉ1 ", " wÉ1,\n")))
    docs += [(100, None), (101, ""), (102, items[4][1]), (103, "x " * 2_000)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, words int")
    got = {r.id: r["items"] for r in op.contaminated(frame, bench).collect()}
    want = brute(docs, items)
    assert got == {i: x for i, x in want.items() if x}
    clean = op.decontaminate(frame.union(spark.createDataFrame([(None, items[4][1], 1), (None, None, 1)], frame.schema)), bench)
    assert clean.columns == frame.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in clean.collect()) == [-1, *sorted(i for i, x in want.items() if not x)]
    assert op.contaminated(frame, bench.limit(0)).count() == 0 == op.contaminated(frame.limit(0), bench).count()


def test_each_length_with_its_substitutions(spark):
    items, docs, want = [], [], {}
    for n in range(1, 14):
        item = [f"i{n}x{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        most = n * 2 // 13
        for bad in [c for k in range(most + 2) for c in itertools.combinations(range(n), k)]:
            i = len(docs)
            part = ["other" if j in bad else x for j, x in enumerate(item)]
            docs.append((i, " ".join(["before", "it", *part, "after"])))
            if len(bad) <= most:
                want[i] = [n]
    items += [(20, "今日は天気がとても良いので散歩に行きます"), (21, "我们昨天")]
    docs += [(10_000, "前置き。今日は天気がとても良いので散歩へ行きます。"), (10_001, "他说我们昨天去了"), (10_002, "天気")]
    want |= {10_000: [20], 10_001: [21]}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.id: r["items"] for r in op.contaminated(frame, bench, short_items=True).collect()} == want


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r.doc_id: r["items"] for r in op.op5_decontaminate(spark, sf_dir).collect()} == brute(docs, items)
