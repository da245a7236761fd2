import math
import re
import zlib
from collections import Counter

import numpy as np
from conceptmill.llm import op10_lbl as op


def tokens(t):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " "]


def out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def brute(rows):
    c = Counter(x for i, t in rows if not out(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(i, t): (out(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for i, t in rows}


def test_base_and_model(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10_000, None), (10_001, ""), (None, "É the A\x0bb"), (10_002, "the " * 3000), (10_003, "never-seen-anywhere")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, token int")
    got = op.score(docs, block_tokens=5000, vocab=100).collect()
    want = sorted((-1 if i is None else i, *x) for (i, _), x in brute(rows).items())
    for r, w in zip(sorted(got, key=lambda r: -1 if r.doc_id is None else r.doc_id), want, strict=True):
        assert (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 10_000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert op.score(docs.limit(0)).count() == 0


def test_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    unigram = rng.random(40)
    model = op.Model(unigram / unigram.sum(), 3)
    grams = rng.integers(0, 40, (500, 3))
    model.train(grams, rng.integers(1, 60, 500), 0.1, 1)
    for one, two in ((0, 1), (7, 7)):
        logs = model.log_probs(np.full(40, one), np.full(40, two), np.arange(40))
        assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_contexts_begin_at_the_end_token():
    one, two, target = op.contexts([np.array([5, 6, 7]), np.array([1]), np.array([8, 9])])
    assert target.tolist() == [5, 6, 7, 1, 8, 9]
    assert one.tolist() == [op.END, 5, 6, op.END, op.END, 8] and two.tolist() == [op.END, op.END, 5, op.END, op.END, op.END]


def test_vocabulary_of_odd_corpora(spark):
    apart = [i for i in range(100) if out(i)]
    learnt = [i for i in range(100) if not out(i)]
    schema = "doc_id long, text string"
    # nothing to learn from: every token is unknown
    got = op.score(spark.createDataFrame([(apart[0], "a b"), (apart[1], None)], schema)).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 0, 0, 0.0, 0.0)] * 2
    # tokens that all occur once, and a vocabulary too small for any of them: bands alone
    for vocab in (None, 1):
        rows = [(i, f"w{i} x{i}") for i in learnt] + [(apart[0], "never seen")]
        got = op.score(spark.createDataFrame(rows, schema), vocab=vocab).collect()
        assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
        assert {r.n_known for r in got if r.held_out} == {1}


def test_scores_against_plain_loops():
    """The logarithm of the softmax over the classes times that within the class, a token at a time."""
    for n, first, seed in ((7, 3, 0), (60, 4, 1), (700, 5, 2)):
        rng = np.random.default_rng(seed)
        unigram = rng.random(n) + 0.01
        model = op.Model(unigram / unigram.sum(), first)
        model.train(rng.integers(0, n, (3000, 3)), rng.integers(1, 60, 3000), 0.1, seed)
        tokens = [rng.integers(0, n, k) for k in (1, 2, 3, 400)] + [np.array([5, 5, 5, 5, 5])]
        got = model.log_probs(*op.contexts(tokens))
        want = []
        for text in tokens:
            for i, t in enumerate(text):
                one, two = text[i - 1] if i else op.END, text[i - 2] if i > 1 else op.END
                p = model.r[one] @ model.c[0] + model.r[two] @ model.c[1]
                classes = [math.exp(g @ p + d) for g, d in zip(model.g, model.d, strict=True)]
                own = model.of[t]
                members = {e: math.exp(model.q[e] @ p + model.b[e]) for e in range(n) if model.of[e] == own}
                want.append(math.log(classes[own] / sum(classes)) + math.log(members[t] / sum(members.values())))
        assert np.allclose(got, want, atol=2e-4)


def test_sums_of_equal_rows():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 9, 200).astype(np.uint16)
    values = rng.normal(size=(200, 4)).astype(np.float32)
    at, got = op._sums(rows, values)
    assert at.tolist() == sorted(set(rows.tolist()))
    assert np.allclose(got, [values[rows == k].sum(axis=0) for k in at], atol=1e-4)
    assert np.allclose(op._sums(rows, values[:, 0])[1], [values[rows == k, 0].sum() for k in at], atol=1e-4)


def test_words_are_numbered_as_they_come():
    lexicon = op._lexicon()
    assert [lexicon[w] for w in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1] and list(lexicon) == [b"a", b"b", b"c"]


def test_blocks_cost_no_counts_for_each_text(monkeypatch):
    """Counting a text must not take a pass over the whole lexicon of its block: one count for a block."""
    texts = [f"A{i} b\x0b\x0c É x \x1c {i % 7}\n" if i % 5 else " \t" for i in range(2000)]
    calls = []
    bincount = np.bincount
    monkeypatch.setattr(op.np, "bincount", lambda *a, **k: calls.append(1) or bincount(*a, **k))
    got = list(op.blocks(iter([op.pa.RecordBatch.from_arrays([op.pa.array([None, *range(1, 2000)], op.pa.int64()), op.pa.array(texts)], names=["id", "t"])]), 3, 1000))
    docs = [r for b in got if b["kind"][0].as_py() == "doc" for r in b.to_pylist()]
    words = [r for b in got if b["kind"][0].as_py() == "word" for r in b.to_pylist()]
    n = len({r["block"] for r in docs})
    assert len(calls) == n > 1 and [r["id"] for r in docs] == [None, *range(1, 2000)]
    of = {(r["block"], r["code"]): r["token"] for r in words}
    assert len(of) == len(words) == len({(r["block"], r["token"]) for r in words})
    want, sizes = Counter(), Counter()
    for r, t in zip(docs, texts, strict=True):
        read = [of[r["block"], k] for k in np.frombuffer(r["codes"], np.int32).tolist()]
        assert read == tokens(t) and r["n_tokens"] == len(read) and r["held_out"] == out(r["id"])
        sizes[r["block"]] += len(read)
        want.update((r["block"], x) for x in read if not r["held_out"])
    assert {(r["block"], r["token"]): r["count"] for r in words if r["count"]} == dict(want)
    # a block is closed behind the text that fills it
    assert all(1000 <= k < 1010 for k in list(sizes.values())[:-1])


def test_noise_drawn_again_is_scored_once(monkeypatch):
    """A step scores the wanted class and each distinct noise class, not one for each draw."""
    scored = []
    miss = op._miss
    monkeypatch.setattr(op, "_miss", lambda s: scored.append(s.shape) or miss(s))
    rng = np.random.default_rng(0)
    model = op.Model(np.full(30, 1 / 30), 3)
    model.train(rng.integers(0, 30, (500, 3)), np.ones(500, np.int64), 0.1, 1)
    assert max(shape[1] for shape in scored if len(shape) == 2) <= len(model.starts) < op.NOISE


def test_training_against_plain_loops():
    """The first batch's step: gradients of each trigram, of every draw and of every noise entry, summed one at a time."""
    for n, first, rows in ((40, 3, 300), (900, 5, 800), (30, 30, 50)):
        rng = np.random.default_rng(n)
        unigram = rng.random(n) + 0.01
        unigram /= unigram.sum()
        grams, counts = rng.integers(0, n, (rows, 3)), rng.integers(1, 16, rows)
        model, old = op.Model(unigram, first), op.Model(unigram, first)
        model.train(grams, counts, 0.1, 7)
        rng = np.random.default_rng(7)
        order = rng.permutation(rows)
        order = order[np.argsort(grams[order, 2], kind="stable")]
        drawn = np.searchsorted(np.cumsum(old.share / old.share.sum()), rng.random(op.NOISE), "right").clip(max=len(old.starts) - 1)
        here = sorted({int(old.of[t]) for t in grams[:, 2]})
        noise = {k: old.starts[k] + (x * old.width[k]).astype(int) for k, x in zip(here, rng.random((len(here), op.MEMBERS)), strict=True)}
        sums = {name: np.zeros(getattr(old, name).shape) for name in old.NAMES}
        for i in order:
            one, two, t = grams[i]
            weight, kind = counts[i] / counts.sum(), old.of[t]
            p = old.r[one] @ old.c[0] + old.r[two] @ old.c[1]
            gp = np.zeros(p.shape)
            near = [("g", "d", kind, op.NOISE * old.share[kind], True)] + [("g", "d", k, op.NOISE * old.share[k], False) for k in drawn]
            near += [("q", "b", t, op.MEMBERS / old.width[kind], True)] + [("q", "b", k, op.MEMBERS / old.width[kind], False) for k in noise[kind]]
            for vectors, biases, k, noisy, wanted in near:
                v = getattr(old, vectors)[k]
                x = 1 / (1 + math.exp(-(p @ v + getattr(old, biases)[k] - math.log(noisy))))
                g = weight * ((1 - x) if wanted else -x)
                sums[vectors][k] += g * p
                sums[biases][k] += g
                gp += g * v
            sums["r"][one] += old.c[0] @ gp
            sums["r"][two] += old.c[1] @ gp
            sums["c"][0] += np.outer(old.r[one], gp)
            sums["c"][1] += np.outer(old.r[two], gp)
        for name in old.NAMES:
            step = 0.1 * sums[name] / np.sqrt(1e-8 + sums[name] ** 2)
            assert np.allclose(getattr(model, name), getattr(old, name) + step, atol=2e-3), name


def test_log_sums_of_great_scores():
    rng = np.random.default_rng(5)
    for scale in (0.1, 1, 20):
        p, v, bias = (scale * rng.normal(size=s).astype(np.float32) for s in ((700, 16), (90, 16), 90))
        s = p.astype(np.float64) @ v.T.astype(np.float64) + bias
        top = s.max(axis=1)
        assert np.allclose(op._log_sums(p, v, bias), top + np.log(np.exp(s - top[:, None]).sum(axis=1)), rtol=1e-5, atol=1e-4)
    assert len(op._log_sums(p[:0], v, bias)) == 0


def test_blocks_of_runs():
    rng = np.random.default_rng(6)
    for runs in (1, 7, 900):
        lens = rng.integers(1, 60, runs)
        heads = np.cumsum(lens) - lens
        run, at, inside = op._blocks(heads, int(lens.sum()))
        assert at[inside].tolist() == list(range(lens.sum()))
        assert (np.repeat(run[:, None], at.shape[1], axis=1)[inside] == np.repeat(np.arange(runs), lens)).all()
