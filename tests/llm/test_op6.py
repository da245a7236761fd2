import re

from conceptmill.llm import op6_mix as op

WEIGHTS = (3, 1, 2)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, target, free = min(1.5 * sum(sizes.values()), 2 * sum(sizes.values())), dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
            left -= target[s]
        free -= over or free
    return target


def check(docs, rows):
    got = op.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.source or "", r.size) for r in got) == sorted((i or -1, s or "", size(t)) for i, t, s in rows)
    sizes, taken, largest = {}, {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
        largest[s] = max(largest.get(s, 0), size(t))
    target = brute_targets(sizes)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s], (s, taken[s], target[s])
    again = op.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.h, r.copies) for r in got) == sorted((r.doc_id or -1, r.h, r.copies) for r in again)


def test_targets_and_takes(spark):
    rows = [(k, "w " * (k % 50) + "\xa0é\x0bz", f"s{k % 7 if k % 3 else 0}") for k in range(900)]
    rows += [(None, "a b", None), (5000, None, "empty"), (5001, "", "empty"), (5002, "x " * 5000, "s1"), (7, "twice", "tiny"), (7, "twice", "tiny"), (5003, "y", None)]
    check(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, size int"), rows)


def test_one_source_and_none(spark):
    rows = [(k, "a b c", "only") for k in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(frame, rows)
    assert op.mix(frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), rows)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(op.op6_mix(spark, sf_dir).columns)
