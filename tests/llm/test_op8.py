import re
from collections import Counter

from conceptmill.llm import op8_quality as op


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    n, symbols = len(w), len(re.findall(r"[#*$%&|<>]", t))
    failed = n < 50 or 100 * len(covered) > 50 * n
    kept = not failed and 100 * symbols <= 10 * n and 100 * dup <= 40 * len(lines) and max((len(x.encode()) for x in w), default=0) <= 4000
    return n, sum(map(len, w)), symbols, dup, len(covered), failed, kept


TEXTS = [None, "", " \n\n ", "a b c a b c a b c", "x " * 60, "\n".join(f"line {k % 3} é" for k in range(60)), " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}#" for k in range(80)), "\x0b".join(f"w{k}" for k in range(60)), "z" * 50_000, " ".join(f"w{k}" for k in range(60)) + " " + "q" * 5000, " ".join(str(k) for k in range(70_000))]


def test_against_brute_force(spark, sf_dir):
    rows = [(k if k else None, t) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5])] + [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = sorted((r.doc_id or -1, *(getattr(r, m) for m in op.MEASURES), r.base_failed, r.kept) for r in op.measure(docs).collect())
    assert got == sorted((i or -1, *brute(t)) for i, t in rows)
    kept = op.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, t in rows if brute(t)[-1])
    assert op.measure(docs.limit(0)).count() == 0 and op.keep_good(docs.limit(0)).count() == 0


def test_order_is_by_rejection_per_cost():
    found = {"few_words": (1.0, 0.5), "symbols": (0.1, 0.2), "long_word": (0.1, 0.0)}
    assert list(op.ordered(op.RULES, found))[:2] == ["symbols", "few_words"]
    calls = []
    rules = {"a": lambda t: calls.append("a") or True, "b": lambda t: calls.append("b") or True}
    assert not op.passes(op.Text("x"), rules) and calls == ["a"]
