"""Long rows of fragments and edge characters in one sentence, and the trims against the plain patterns."""

import random
import re

from conceptmill import constants as K
from conceptmill.functions import mentions as M
from conceptmill.functions import text as X
from conceptmill.functions.pieces import stripped, without_head, without_tail
from conceptmill.operators import concepts
from conceptmill.options import ExtractOptions
from conceptmill.plans import queries as Q
from pyspark.sql import functions as F


def test_long_rows_of_fragments_end_no_executor(spark):
    n = 20_000
    texts = ["knee pain" + " of the" * n, "knee pain" + " -" * n + " of", "plan: " * n + "knee pain", "of the " * n + "knee pain", "knee pain" + " end date" * n, "12 " * n + "knee pain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    found = df.select("i", F.transform(M.mentions(F.col("t"), F.lit("")), lambda m: X.without_modifiers(m["text"])).alias("m")).collect()
    assert {r.i: [x for x in r.m if x != "plan"] for r in found} == {i: ["knee pain"] for i in range(6)}


def test_trims_equal_plain_patterns(spark):
    rng = random.Random(5)
    words = ["of", "Of", "with", "without", "the", "a", "an", "then", "ofx", "start", "end", "date", "type", "types", "typesx", "plan", "Labs", ":", "-", "(", ".", "\xa0", "  ", "\t", " ", " ", " ", "\n", " ", "pain", "x"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    wide = lambda p: p.replace(M.SPACE, r"[\s\x1c-\x1f\x85]")
    edge, gap = K.EDGE_CLASS, rf"(?:\s|{K.EDGE_CLASS})*"
    plain = {
        "head": lambda s: re.sub(f"^(?:{wide(M._HEADERS)}{edge}*)+", "", s, flags=re.I),
        "lead": lambda s: re.sub(f"^(?:{K.LEAD_FRAGMENT}{edge}*)+", "", s, flags=re.I),
        "tail": lambda s: re.sub(rf"{edge}*(?:{K.TAIL_FRAGMENT}{gap})+\Z", "", s, flags=re.I),
        "field": lambda s: re.sub(rf"{edge}*(?:{K.TAIL_FIELD}{gap})+\Z", "", s, flags=re.I),
        "edge": lambda s: re.sub(rf"{edge}+(?= ?\Z)", "", re.sub(f"^{edge}+", "", s)),
    }
    p = F.struct(F.lit(0).alias("at"), F.col("t").alias("part"))
    ours = [without_head(p, M._HEAD), without_head(p, M._LEAD), without_tail(p, M._TAIL), without_tail(p, M._FIELD), stripped(p, edge)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[o["part"].alias(n) for n, o in zip(plain, ours, strict=True)]).collect()
    assert len(rows) == 3000
    for r in rows:
        for name, f in plain.items():
            assert r[name] == f(r.t), (name, r.t)


def test_concepts_of_notes_with_long_rows(spark):
    n = 20_000
    texts = ["knee pain" + " of the" * n, "plan: " * n + "knee pain", "knee pain" + " end date" * n]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id long, text string").repartition(3)
    found = concepts.extract_concepts(notes, Q.term_concepts(spark), ExtractOptions(threshold=0.9)).collect()
    assert sorted((r.note_id, r.preferred_term) for r in found if r.preferred_term == "knee pain") == [(k, "knee pain") for k in range(3)]
