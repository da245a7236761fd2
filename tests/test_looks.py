"""The cheap looks that spare most texts a pattern, against the patterns themselves; what an extraction makes once."""

import random
import re

from conceptmill import constants as K
from conceptmill.functions import mentions as M
from conceptmill.functions import text as X
from conceptmill.functions.pieces import SPACE, around, let, stripped, without_head, without_tail
from conceptmill.operators import concepts, extract
from conceptmill.options import ExtractOptions
from conceptmill.plans import queries as Q
from pyspark.sql import functions as F

WORDS = [
    "of", "the", "With", "an", "and", "OR", "oral", "band", "pain", "mild", "Severely", "left", "b/l", "b\\l", "B/L", "subacute", "acutely", "HTN", "htn", "DM", "xDM", "éDM", "plan", "a / p", "A/P:", "Labs", "cc:", "labs:", "skin",
    "start", "end date", "types", "other:", "lab results 3", "12", "3.5", ",", ";", ".", "!", "/", "|", "~", "-", "(", ":", "?", "\t", "\n", "\r", "  ", "   ", "\xa0", "\x85", "\u2028", "\x1c", "\x01", "\u0301", "é", "\U0001f600", "x", "MI",
]


def _texts(n: int, seed: int, most: int = 12) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, most))) for _ in range(n)]


def _trimmed_by_all(p):
    for step in (lambda x: stripped(x, K.EDGE_CLASS), lambda x: without_head(x, M._HEAD), lambda x: without_head(x, M._LEAD), lambda x: without_tail(x, M._TAIL), lambda x: without_tail(x, M._FIELD)):
        p = let(p, step)
    return p


def test_looks_equal_the_patterns(spark):
    t = F.col("t")
    piece = F.struct(F.lit(0).alias("at"), t.alias("part"))
    modifier = f"(?i)(?:{K.SEVERITY}|{K.LATERALITY}|{K.TEMPORALITY})"
    bare = F.regexp_replace(t, f"^{K.EDGE_CLASS}+", "")
    pairs = {
        "separators": (around(t, M._SEPARATORS), around(t, "(?i)" + K.SEPARATORS.replace(r"\s", SPACE))),
        "trimmed": (M._trimmed(piece), _trimmed_by_all(piece)),
        "edges": (stripped(piece, K.EDGE_CLASS)["part"], F.regexp_replace(bare, f"(?<!{K.EDGE_CLASS}){K.EDGE_CLASS}++$", "")),
        "modified": (X.is_modified(t), t.rlike(modifier)),
        "without": (X.without_modifiers(t), X._without_modifiers(t)),
        "header": (X.is_section_header(t), X.normal_header(t).isin(K.SECTION_HEADERS)),
    }
    texts = [*_texts(6000, 1), *_texts(2000, 2, 3), *K.SECTION_HEADERS]
    columns = [c.alias(f"{n}_{k}") for n, p in pairs.items() for k, c in enumerate(p)]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "t string").repartition(4).select("t", *columns).collect()
    for n in pairs:
        assert [r.t for r in rows if r[f"{n}_0"] != r[f"{n}_1"]] == [], n
    assert all(r[f"{n}_1"] is None for r in rows if r.t is None for n in pairs if n != "trimmed")


def test_sentences_equal_trimmed_runs(spark):
    texts = _texts(2000, 3, 30)
    rows = spark.createDataFrame(list(enumerate(texts)), "note_id long, text string").repartition(4).select("note_id", X.sentence_spans(F.col("text")).alias("s"), X.sentence_spans(F.col("text"), False).alias("w")).collect()
    found = {r.note_id: ([tuple(x) for x in r.s or []], [tuple(x) for x in r.w or []]) for r in rows}
    spans = lambda text, pattern: [(m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), m[0].strip()) for m in re.finditer(pattern, text) if len(m[0].strip()) > 3]
    for k, text in enumerate(texts):
        assert found[k] == (spans(text, r"[^.;!\n]+"), spans(text, r"(?s).+")), text


def test_mentions_of_a_sentence_are_one_for_each_expansion(spark):
    texts = ["HTN, hypertension, dm, DM, diabetes mellitus, pain", "plan, PAIN, pain, labs, pain", "pain, pain \x01, rash", "rash, knee pain -\x85-"]
    rows = extract.note_mentions(spark.createDataFrame(list(enumerate(texts)), "note_id long, text string")).collect()
    assert {k: [r.text for r in sorted(rows, key=lambda r: r.start) if r.note_id == k] for k in range(4)} == {3: ["rash", "knee pain "], 0: ["HTN", "dm", "DM", "pain"], 1: ["PAIN"], 2: ["pain", "rash"]}
    assert all(texts[r.note_id][r.start : r.end] == r.text for r in rows)


def test_mentions_are_described_once_and_in_columns(spark, sf_dir):
    plan = extract.note_mentions(Q.notes(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "AS expanded_text" in plan and "AS modified" in plan
    assert not re.search(r"^\W*Filter", plan, re.M)


def test_vectors_of_texts_are_not_staged(spark, monkeypatch):
    seen = {}
    real = concepts.staged
    monkeypatch.setattr(concepts, "staged", lambda df, name: seen.setdefault(name, df) and real(df, name))
    notes = spark.createDataFrame([(1, "Severe knee pain, COPD. Rash.")], "note_id long, text string")
    found = concepts.extract_concepts(notes, Q.term_concepts(spark), ExtractOptions(threshold=0.9)).collect()
    assert {r.preferred_term for r in found} >= {"knee pain", "rash"}
    assert seen["concept-texts"].columns == ["normalized_text"] and "mention_id" not in seen["concept-mentions"].columns
    assert seen["concept-found"].filter("score < 0.9").count() == 0
