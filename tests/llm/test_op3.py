import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from conceptmill.llm import op3_simhash as op
from conceptmill.llm import trie
from conceptmill.llm.components import components
from conceptmill.llm.trie import met, walk


def brute_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, width=3, budget=2):
    prints = [brute_fingerprint(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted((-1 if i is None else i, f"{p:016x}", least.get(x)) for (i, _), p, x in zip(rows, prints, label, strict=True))


def some_rows():
    rng = random.Random(5)
    vocab = [f"W{k}é" for k in range(300)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        rows.append((k, " ".join(words)))
        if k % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
            rows.append((1000 - k, "\t".join(words).upper()))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, "a b"), (3, rows[3][1]), (3, rows[3][1]), (2003, "\xa0 x"), (2004, "y " * 70_000)]


def test_query_against_brute_force(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in op.simhash_components(docs).collect())
    assert got == brute_components(rows)
    assert op.simhash_components(docs.limit(0)).count() == 0


def test_query_on_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op.op3_simhash(spark, sf_dir).collect())
    assert got == brute_components(rows)


def test_walk_finds_all_pairs(spark):
    rng = np.random.default_rng(0)
    for bits, budget, n in ((64, 2, 2000), (32, 3, 3000), (16, 2, 400)):
        k = rng.integers(0, 2**bits - 1, n, dtype=np.uint64)
        k = np.concatenate([k, k[:300] ^ (np.uint64(1) << rng.integers(0, bits, 300).astype(np.uint64))])
        # a prefix that holds more keys than others, and is cut further
        k = np.unique(np.concatenate([k, (k[0] >> np.uint64(bits - 6) << np.uint64(bits - 6)) | (rng.integers(0, 2 ** (bits - 6), 600, dtype=np.uint64))]))
        want = {(a, b) for a in range(len(k)) for b in (np.flatnonzero(np.bitwise_count(k[a + 1 :] ^ k[a]) <= budget) + a + 1).tolist()}
        keys = spark.createDataFrame([(0, x, i) for i, x in enumerate(k.view(np.int64).tolist())], "band int, key long, node long")
        for target in (60, 10_000):
            frame, got = met(keys, bits, budget, target).toPandas(), set()
            assert (frame["lo"] >= 1 << 40).any() == (target == 60)
            for (lo, hi), group in frame.groupby(["lo", "hi"]):
                a, b = (np.sort(group["node"][group["side"] == s].to_numpy()) for s in (0, 1))
                if lo == hi or len(a) and len(b):
                    for x, y in walk(k[a], None if lo == hi else k[b], bits, int(group["depth"].iloc[0]), budget):
                        got |= {(min(p), max(p)) for p in zip(a[x].tolist(), (a if lo == hi else b)[y].tolist(), strict=True)}
            assert got == want


def test_sets_against_brute_force():
    texts = ["", " \n", "One", "one  TWO", "\ta b c d e f", "é É a", "x " * 600, "a b c d e f"]
    made = op.shingle_sets(pa.array(texts), (5, 2))
    for width, (flat, lens) in zip((5, 2), made, strict=True):
        sets = np.split(flat, np.cumsum(lens)[:-1])
        words = [t.encode().lower().split() for t in texts]
        brute = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)) if w} for w in words]
        assert [len(s) for s in sets] == [len(b) for b in brute]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(np.intersect1d(sets[i], sets[j])) == len(brute[i] & brute[j])


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 300), (300, 300)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(101)} | {300: 300, 500: 300} | {k: 1000 for k in range(1000, 1100)}


def test_one_of_each_group_stays(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(10_000)}" for _ in range(300)] for _ in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base[:20]):
        near = list(w)
        near[rng.randrange(300)] = "other"
        near[rng.randrange(300)] = "word"
        rows += [(100 + k, " ".join(near)), (200 + k, " ".join(w))]
    rows += [(None, None), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, node string, h int").repartition(4)
    got = op.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == [-1, *range(40)]
    assert op.drop_near_duplicates(docs.limit(0)).count() == 0


def brute_near(rows, width=5, similarity=0.8):
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows, strict=True):
        least[x] = min(least.get(x, i), i)
    return {i: least[x] for x, (i, _) in zip(label, rows, strict=True)}


def contiguous_edits():
    """Texts, each with a copy that has a passage appended, replaced or cut in one piece, from similarity 0.70 to 0.90."""
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    rows = []
    for k in range(240):
        w, s = some(300), (0.70, 0.75, 0.79, 0.80, 0.81, 0.85, 0.90)[k % 7]
        if k % 3 == 0:
            copy = w + some(round(296 / s) - 296)
        elif k % 3 == 1:
            n = round(300 * (1 - s) / (1 + s)) - 4
            at = rng.randrange(300 - n)
            copy = w[:at] + some(n) + w[at + n :]
        else:
            copy = w[: 4 + round(296 * s)]
        rows += [(k, " ".join(w)), (1000 + k, " ".join(copy))]
    # few distinct shingles that fill the text, and much else that differs
    return rows + [(5000 + k, "the same five words again " * 400 + " ".join(some(100))) for k in range(2)]


def test_contiguous_edits_against_brute_force(spark):
    rows = contiguous_edits()
    want = brute_near(rows)
    got = {r.id: r.least_id for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 100 and all(got[i] in (i, want[i]) for i in want)  # none too many
    assert sum(got[i] == want[i] for i in linked) >= 0.98 * len(linked)


def test_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "_GROUP", 8)
    rng = random.Random(4)
    w = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):  # a chain: each differs a little more from the first
        rows.append((k, " ".join(w)))
        w[(k * 7) % 200] = f"x{k}"
        if k % 5 == 4:
            at = rng.randrange(180)
            w[at : at + 12] = [f"y{k}-{x}" for x in range(12)]
    want = brute_near(rows)
    got = {r.id: r.least_id for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_groups_of_a_whole_table(spark):
    """All pairs of the table by their shared shingles, against the groups: no link lost and none made."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets, holders, label = [], {}, list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    links = 0
    for k, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
        shared = {}
        for s in sets[k]:
            for j in holders.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders[s].append(k)
        for j, n in shared.items():
            if n >= 0.8 * (len(sets[k]) + len(sets[j]) - n):
                links += 1
                a, b = root(k), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups[root(k)] = min(groups.get(root(k), i), i)
    assert links > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.least_id for r in op.near_duplicates(docs).collect()} == {i: groups[root(k)] for k, (i, _) in enumerate(rows)}


def test_keys_meet_few_subtries_however_many_they_are(spark, monkeypatch):
    rng = random.Random(9)
    # an odd number of keys is cut as an even one is: into two subtries, not four
    odd = spark.createDataFrame([(0, rng.getrandbits(32), k) for k in range(8195)], "band int, key long, node long")
    given = []
    monkeypatch.setattr(trie, "met", lambda keys, *rest: given.append(met(keys, *rest)) or given[-1])
    trie.trie_forest(odd, 32, 3, tasks=2)
    assert given[-1].count() == 2 * 8195
    # many subtries: no more rows than stretches, and the links of all pairs
    monkeypatch.setattr(trie, "SUBTRIE_KEYS", 24)
    for bits, budget in ((32, 3), (64, 2), (11, 1)):
        rows = []
        for band in range(2):
            for _ in range(220):
                key = rng.getrandbits(bits)
                rows.append((band, key))
                for _ in range(rng.choice([0, 1, 2])):
                    for b in rng.sample(range(bits), rng.randint(0, budget + 1)):
                        key ^= 1 << b
                    rows.append((band, key))
        rows = [(band, key - (1 << 64) if key >> 63 else key, k) for k, (band, key) in enumerate(rows)]
        keys = spark.createDataFrame(rows, "band int, key long, node long")
        found = {(r.node, r.component) for r in components(trie.trie_forest(keys, bits, budget)).collect()}
        assert given[-1].count() <= (budget + 1) * len(rows) * (1.5 if bits == 11 else 1)
        label = list(range(len(rows)))
        for i, (bi, ki, _) in enumerate(rows):
            for j, (bj, kj, _) in enumerate(rows[:i]):
                if bi == bj and ((ki ^ kj) & (1 << 64) - 1).bit_count() <= budget and label[i] != label[j]:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
        sizes = Counter(label)
        assert found == {(k, x) for k, x in enumerate(label) if sizes[x] > 1}
