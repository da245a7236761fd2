"""Quality rules as a short-circuit cascade: the rule that rejects most per second of its cost goes first.

The order is found on a sample: every rule is run, alone and from nothing, on each sampled text, which gives its cost and
the share that it rejects. A text then meets the rules in that order until one rejects it. The verdict doesn't depend on the
order, so neither the sample nor the clock can change a result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

_WHITE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


class Text:
    """A text's measures, each computed when it is first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(_WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that the text holds twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        counts, covered, upto = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if counts[x] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
        return covered


Rule = Callable[[Text], bool]
#: A rule says whether it rejects. The first two are the base; limits in hundredths, so that they compare whole numbers.
BASE: dict[str, Rule] = {"few_words": lambda t: t.n_words < 50, "repeated_words": lambda t: 100 * t.n_repeat_words > 50 * t.n_words}
RULES: dict[str, Rule] = BASE | {
    "symbols": lambda t: 100 * t.n_symbols > 10 * t.n_words,
    "repeated_lines": lambda t: 100 * t.n_dup_lines > 40 * len(t.lines),
    "long_word": lambda t: max(map(len, t.words), default=0) > 4000,
}
#: The sample is a random twentieth of the table, or, of a large table, about this many rows of it.
SAMPLE_ROWS, SAMPLE_SHARE = 5000, 0.05


def estimate(docs: DataFrame, rules: dict[str, Rule] = RULES, text_col: str = "text") -> dict[str, tuple[float, float]]:
    """The mean cost in seconds and the share of rejected texts of each rule over the sample; empty if the sample is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, rejected, n = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for name, rule in rules.items():
                    began = time.perf_counter()
                    rejected[name] += rule(Text(text))
                    cost[name] += time.perf_counter() - began
        if n:
            yield pa.RecordBatch.from_pydict({"name": list(rules), "cost": list(cost.values()), "rejected": pa.array(list(rejected.values()), pa.int64()), "n": pa.array([n] * len(rules), pa.int64())})

    # each partition sums its own rows; the sample isn't gathered
    share = min(SAMPLE_SHARE, SAMPLE_ROWS / max(1, docs.count()))
    sample = docs.select(text_or_empty(text_col).alias("t")).sample(share, seed=8)
    sums = sample.mapInArrow(run, "name string, cost double, rejected long, n long").groupBy("name").agg(F.sum("cost"), F.sum("rejected"), F.sum("n")).collect()
    return {name: (cost / n, rejected / n) for name, cost, rejected, n in sums}


def ordered(rules: dict[str, Rule], found: dict[str, tuple[float, float]]) -> dict[str, Rule]:
    """The rules by rejection per cost, most first; as given where nothing is known."""
    gain = {k: found[k][1] / max(found[k][0], 1e-9) if k in found else 0.0 for k in rules}
    return dict(sorted(rules.items(), key=lambda kv: -gain[kv[0]]))


def passes(text: Text, rules: dict[str, Rule]) -> bool:
    return not any(rule(text) for rule in rules.values())


def keep_good(docs: DataFrame, rules: dict[str, Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs whose whole text no rule rejects, with their columns. A null text is an empty one (rejected for few
    words); repeated rows, null ids and other columns are passed on; an empty table stays empty."""
    cascade = ordered(rules, estimate(docs, rules, text_col))
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [passes(Text(t or ""), cascade) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, the base measures, base_failed, and kept, for which a text that the base passes goes
    through the other rules of the cascade. A null text is an empty one; repeated rows and null ids stay; other columns are left out;
    an empty table gives no row."""
    cascade = ordered(RULES, estimate(docs, RULES, text_col))
    rest = {k: r for k, r in cascade.items() if k not in BASE}
    base = {k: r for k, r in cascade.items() if k in BASE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                out = {m: [] for m in MEASURES}
                failed, kept = [], []
                for t in map(Text, piece.column(1).to_pylist()):
                    for m in MEASURES:
                        out[m].append(getattr(t, m))
                    failed.append(not passes(t, base))
                    kept.append(not failed[-1] and passes(t, rest))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(v, pa.int64()) for v in out.values()), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=[id_col, *out, "base_failed", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("__text"))
    return rows.mapInArrow(run, f"{id_col} long, {', '.join(f'{m} long' for m in MEASURES)}, base_failed boolean, kept boolean")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the base measures, base_failed and kept. Null texts have no words and fail."""
    return measure(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT *, len(w) AS n_words, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM d
), p AS (
  SELECT r, w, n_words, unnest(range(1, n_words - 1)) AS i FROM x WHERE n_words >= 3
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p
), c AS (
  SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, list_max(list_transform(w, lambda s: octet_length(encode(s)))) AS longest
  FROM x LEFT JOIN c USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_symbols <= 10 * n_words AND 100 * n_dup_lines <= 40 * n_lines AND coalesce(longest, 0) <= 4000 AS kept
FROM b
"""
