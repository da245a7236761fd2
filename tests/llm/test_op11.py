import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conceptmill.llm import op11_runs as op
from conceptmill.llm import repeats
from hypothesis import given, settings
from hypothesis import strategies as st


def brute_runs(words, least=6, times=4):
    """Every stretch with each period in turn; a stretch's smallest period is the first that finds it."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, l, q) for (s, l), q in found.items() if l >= max(least, times * q))


def found_runs(seqs, least=6, times=4):
    lens = np.array([len(x) for x in seqs], np.int64)
    start, length, period = op._held(np.array([w for x in seqs for w in x], np.int64), lens, least, times)
    first = np.cumsum(lens) - lens
    doc = np.searchsorted(first + lens, start, "right")
    return [sorted((int(s - first[d]), int(l), int(q)) for e, s, l, q in zip(doc, start, length, period, strict=True) if e == d) for d in range(len(seqs))]


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_all_runs_of_small_alphabets(seqs):
    assert found_runs(seqs, 2, 2) == [brute_runs(x, 2, 2) for x in seqs]


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_runs_within_runs(parts):
    words = [w for part, k in parts for w in part * k]
    assert found_runs([words, words[::-1]], 2, 2) == [brute_runs(words, 2, 2), brute_runs(words[::-1], 2, 2)]


def test_words_of_fibonacci_and_of_one_letter():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    seqs = [b, [5] * 3000, list(range(500)), [0, 1] * 700 + [0], [], [1]]
    assert found_runs(seqs, 2, 2) == [brute_runs(x, 2, 2) for x in seqs]


def test_blocks_are_the_longest_earlier_stretches():
    rng = random.Random(1)
    words = [rng.randrange(3) for _ in range(300)]
    s = repeats.SuffixRanks(np.array(words), np.array([300]))
    want, i = [], 0
    while i < 300:
        want.append(i)
        most = max((k for j in range(i) for k in [next((k for k in range(300 - i) if words[i + k] != words[j + k]), 300 - i)]), default=0)
        i += max(1, most)
    assert repeats.lz_blocks(s, np.array([300])).tolist() == want


def brute_row(i, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(i).encode())
    if plant and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    gone = {k for s, l, q in found for k in range(s + q, s + l)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (i, len(found), *best, milli, sha("".join(f"{s},{l},{q}\n" for s, l, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def key(r):
    return tuple((x is not None, x) for x in r)


def test_query_against_brute_force(spark, sf_dir):
    got = op.op11_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [r for r in rows if len(r.text or "") < 30_000]
    want = sorted(brute_row(r.doc_id, r.text) for r in rows)
    held = {r.doc_id for r in rows}
    assert sorted(tuple(r) for r in got.collect() if r.doc_id in held) == want
    assert sum(r[1] for r in want) > 5


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \n", "a", "x " * 6, "x " * 5, "a b " * 4, "a b " * 3, "\xa0 é" * 9, "q " * 3_000, "a b c " * 5 + "c c c c c c c", "Z z " * 9]
    rows = [(k, t, 1, "r") for k, t in enumerate(texts)] + [(None, "k " * 9, 1, "r"), (4, texts[4], 1, "r"), (4, texts[4], 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    got = {r.doc_id: r for r in op.periodic_runs(docs).collect()}
    assert op.periodic_runs(docs).count() == len(rows) and op.periodic_runs(docs.limit(0)).count() == 0
    assert [(r.start, r.length, r.period) for r in got[10].runs] == brute_runs(texts[10].split()) and got[10].n_words == 22
    assert [tuple(r) for r in got[9].runs] == [(0, 3_000, 1)] and got[9].collapsed == "q"
    assert [tuple(r) for r in got[None].runs] == [(0, 9, 1)] and got[7].runs == [] and got[0].collapsed == ""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((brute_row(i, t) for i, t, *_ in rows), key=key)
    assert sorted((tuple(r) for r in op.op11_runs(spark, str(tmp_path)).collect()), key=key) == want
    with pytest.raises(ValueError):
        op.periodic_runs(docs, times=1)
