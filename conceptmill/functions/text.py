"""Text functions: Column in, Column out. Offsets are in code points, from 0."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .pieces import MARK, SPACES, around, let, matches, placed, plain


def sentence_spans(text: Column, extract_all: bool = True) -> Column:
    """array<struct<start,end,text>>: runs between `.`, `;`, `!` and line feeds, trimmed, of more than three characters; without
    extract_all, all of the text is one. The trimmed runs and what stands between them are both extracted, so that lengths add up to
    offsets; a text of three characters at most has none, a null."""
    cuts = r".;!\n" if extract_all else ""
    inside = f"[^{cuts}]*" if extract_all else "(?s:.*)"
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{cuts}{SPACES}](?:{inside}[^{cuts}{SPACES}])?|[{cuts}{SPACES}]+"), F.lit(0))
    # runs and what stands between them alternate
    nth = lambda k: lambda ps: F.filter(placed(ps), lambda p, i: (i % 2 == k) & (F.char_length(p["part"]) > 3))
    runs = let(parts, lambda ps: F.when(F.get(ps, F.lit(0)).rlike(f"^[{cuts}{SPACES}]"), nth(1)(ps)).otherwise(nth(0)(ps)))
    found = F.transform(runs, lambda p: F.struct(p["at"].alias("start"), (p["at"] + F.char_length(p["part"])).alias("end"), p["part"].alias("text")))
    return F.when(text.rlike(f"(?s)[^{SPACES}].{{2,}}?[^{SPACES}]"), found)


def context(sentence: Column) -> Column:
    """struct<prefix, assertion, subject> of the first context rule that matches; a prefix of over 80 characters is not stripped."""
    none = out = F.struct(F.lit("").alias("prefix"), F.lit(None).cast("string").alias("assertion"), F.lit(None).cast("string").alias("subject"))
    for pattern, assertion, subject in reversed(K.CONTEXT_RULES):
        prefix = F.regexp_extract(sentence, f"(?is){pattern}" if ".*?" not in pattern else f"(?i){pattern}", 0)
        kept = F.when(F.char_length(F.trim(prefix)) <= K.MAX_PREFIX, prefix).otherwise("")
        found = F.struct(kept.alias("prefix"), F.lit(assertion).cast("string").alias("assertion"), F.lit(subject).cast("string").alias("subject"))
        out = F.when(sentence.rlike(f"(?i){pattern}"), found).otherwise(out)
    # most sentences match no rule, which one pattern tells
    return F.when(sentence.rlike(f"(?i)^(?:{'|'.join(pattern.removeprefix('^') for pattern, _, _ in K.CONTEXT_RULES)})"), out).otherwise(none)


def normal_header(text: Column) -> Column:
    t = F.lower(F.trim(text))
    # a plain word, by far the most common, is its own header
    return F.when(t.rlike(r"[/:\s]"), F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s*/\s*", "/"), ":+$", ""), r"\s+", " ")).otherwise(t)


def _header_starts() -> dict[int, list[str]]:
    """What a text in lower case begins with if it is a section header, by length: letters, which the normal form leaves as they stand."""
    found: dict[int, list[str]] = {}
    for start in sorted({re.match("[a-z]{0,3}", h)[0] for h in K.SECTION_HEADERS}):
        found.setdefault(len(start), []).append(start)
    return found


def is_section_header(text: Column) -> Column:
    start = F.lower(F.left(F.trim(text), F.lit(3)))
    return reduce(or_, [F.left(start, F.lit(n)).isin(s) for n, s in _header_starts().items()]) & normal_header(text).isin(K.SECTION_HEADERS)


def alnum(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def allowed_span(text: Column) -> Column:
    """At least four letters or digits, or one of the short spans."""
    return text.rlike("[A-Za-z0-9](?:[^A-Za-z0-9]*+[A-Za-z0-9]){3}") | F.upper(alnum(text)).isin(K.SHORT_SPANS)


def _keys(dictionary: dict[str, str], min_length: int) -> dict[str, str]:
    return {k.upper(): v for k, v in dictionary.items() if len(k) >= min_length}


def _alternation(keys: list[str]) -> str:
    """Whole words, the longest key first; keys are grouped by their first character, so that few are tried at a place."""
    by_first: dict[str, list[str]] = {}
    for k in sorted(keys, key=len, reverse=True):
        by_first.setdefault(k[0], []).append(re.escape(k[1:]))
    return r"(?i)(?=[" + "".join(map(re.escape, by_first)) + r"])\b(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + r")\b"


def _table(keys: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])


def _expansion(p: Column, keys: dict[str, str]) -> Column:
    """What a found key stands for; one of two letters must be in capitals."""
    return F.when((F.char_length(p) > 2) | (p == F.upper(p)), F.try_element_at(_table(keys), F.upper(p)))


def _found(dictionary: dict[str, str], min_length: int) -> tuple[dict[str, str], str]:
    keys = {k: v for k, v in _keys(dictionary, min_length).items() if len(k) >= 3 or k in K.SAFE_PAIRS}
    return keys, _alternation(list(keys)) if keys else "(?!)"


def holds_key(text: Column, dictionary: dict[str, str] = K.ABBREVIATIONS, min_length: int = 2) -> Column:
    """Whether expand looks at a word of text."""
    return plain(text).rlike(_found(dictionary, min_length)[1])


def expand(text: Column, dictionary: dict[str, str] = K.ABBREVIATIONS, min_length: int = 2) -> Column:
    """Whole-word keys replaced by their expansions: any case, but keys of two letters in capitals only, and of those the safe ones.
    Keys may hold spaces and other characters; one pass, the longest key first."""
    keys, pattern = _found(dictionary, min_length)
    if not keys:
        return text
    parts = F.split(around(plain(text), pattern), MARK)
    expanded = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.coalesce(_expansion(p, keys), p)).otherwise(p)), "")
    return F.when(holds_key(text, dictionary, min_length), expanded).otherwise(plain(text))


def expansions(text: Column, dictionary: dict[str, str] = K.ABBREVIATIONS, min_length: int = 2) -> Column:
    """array<struct<original, expanded, start, end>> of what expand replaces, with offsets in text."""
    keys, pattern = _found(dictionary, min_length)
    found = F.transform(matches(text, pattern), lambda p: F.struct(p["part"].alias("original"), _expansion(p["part"], keys).alias("expanded"), p["at"].alias("start"), (p["at"] + F.char_length(p["part"])).alias("end")))
    return F.filter(found, lambda x: x["expanded"].isNotNull())


def expansion_of(term: Column, dictionary: dict[str, str] = K.ABBREVIATIONS, min_length: int = 2) -> Column:
    """A single term's expansion, in any case; null if it is none of the dictionary's."""
    return F.try_element_at(_table(_keys(dictionary, min_length)), F.upper(F.trim(term)))


def is_abbreviation(term: Column, dictionary: dict[str, str] = K.ABBREVIATIONS, min_length: int = 2) -> Column:
    return F.coalesce(expansion_of(term, dictionary, min_length).isNotNull(), F.lit(False))


def abbreviation_spans(text: Column, allowed: list[str] = K.SHORT_SPANS, dictionary: dict[str, str] = K.ABBREVIATIONS) -> Column:
    """array<struct<start, end, text, normalized>>: words of 2 to 12 letters and digits, with a capital or a digit, that are allowed."""
    # the allowed words alone are marked, in any case; few are found, and those without a capital or a digit dropped
    words = [w for w in allowed if re.fullmatch("[A-Za-z0-9]{2,12}", w)]
    if not words:
        return F.array().cast("array<struct<start:int,end:int,text:string,normalized:string>>")
    found = F.filter(matches(text, _alternation(words)), lambda p: p["part"].rlike("[A-Z0-9]"))
    return F.transform(found, lambda p: F.struct(p["at"].alias("start"), (p["at"] + F.char_length(p["part"])).alias("end"), p["part"].alias("text"), F.coalesce(expansion_of(p["part"], dictionary), p["part"]).alias("normalized")))


#: Any modifier; most places are passed over by their first letter, as they don't begin a word, or by their second character.
_MODIFIER = rf"(?=[abclmprstuABCLMPRSTU])\b(?=[mM][aAiIoO]|[sS][eEiIlLuU]|[pP][rR]|[tT][rR]|[lL][eE]|[rR][iI]|[bB][iI/\\]|[uU][nN]|[aA][cC]|[cC][hH])(?i:{K.SEVERITY}|{K.LATERALITY}|{K.TEMPORALITY})"
#: What else without_modifiers changes in a text, but for spaces at its ends.
_UNTIDY = r"[\t\n\x0b\f\r\d]|\s\s|^\s?(?i:any|some|the|a|an)\s"


def is_modified(text: Column) -> Column:
    """Whether a severity, a side or a time is in text."""
    return text.rlike(_MODIFIER)


def severity(text: Column) -> Column:
    found = F.lower(F.regexp_extract(text, f"(?i){K.SEVERITY}", 1))
    return F.when(is_modified(text), F.nullif(F.regexp_replace(found, "ly$", ""), F.lit("")))


def laterality(text: Column) -> Column:
    found = F.replace(F.lower(F.regexp_extract(text, f"(?i){K.LATERALITY}", 0)), F.lit("\\"), F.lit("/"))
    return F.when(is_modified(text), F.nullif(found, F.lit("")))


def temporality(text: Column) -> Column:
    return F.when(is_modified(text), F.nullif(F.lower(F.regexp_extract(text, f"(?i){K.TEMPORALITY}", 1)), F.lit("")))


def without_modifiers(text: Column, modified: Column | None = None) -> Column:
    """modified: is_modified of text, if it is there already."""
    return F.when((is_modified(text) if modified is None else modified) | text.rlike(_UNTIDY), _without_modifiers(text)).otherwise(F.trim(text))


def _without_modifiers(text: Column) -> Column:
    for pattern in (K.SEVERITY, K.LATERALITY, K.TEMPORALITY):
        text = F.regexp_replace(text, f"(?i)(?:{pattern})", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.regexp_replace(text, r"(?i)^(?:any|some|the|a|an)\s+", "")
    text = F.trim(F.regexp_replace(text, r"^(?:\d{1,4}\s+)++", ""))
    return F.trim(F.regexp_replace(text, r"\s+\d+(?:\.\d+)?\s*$", ""))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", " ")), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two token sets; two empty ones give both_empty, one gives 0."""
    # no branch: what branches share is computed in each
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(float(both_empty)))


def space_tokens(text: Column) -> Column:
    """Lower-case words between white space, a slash counting as white space."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("/"), F.lit(" "))), r"\s+")), "")


def term_penalty(term: Column) -> Column:
    return reduce(add, [F.when(term.rlike(f"(?i){p}"), F.lit(w)).otherwise(0.0) for p, w in K.TERM_PENALTIES])


def span_penalty(span: Column, term: Column) -> Column:
    """A long term for a short span; the first condition that holds counts."""
    s, t = F.trim(span), F.trim(term)
    ns, nt, ls, lt = F.size(token_set(s)), F.size(token_set(t)), F.char_length(s), F.char_length(t)
    ladder = F.when((ns <= 1) & (nt >= 5), -0.05).when((ns <= 2) & (nt >= 7), -0.04).when((ls <= 6) & (lt >= 30), -0.03).when((ls <= 10) & (lt >= 45), -0.02)
    return F.when((ls == 0) | (lt == 0), 0.0).otherwise(ladder.otherwise(0.0))


def tui_key(key: Column) -> Column:
    k = F.upper(F.trim(F.coalesce(key, F.lit(""))))
    digits = F.regexp_replace(k, "^T", "")
    return F.when(k.rlike("^T?[0-9]+$"), F.concat(F.lit("T"), F.when(F.char_length(F.ltrim(digits, F.lit("0"))) >= 3, F.ltrim(digits, F.lit("0"))).otherwise(F.lpad(F.ltrim(digits, F.lit("0")), 3, "0")))).otherwise(k)


def cui_of(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^[Cc]", "").try_cast("int")


def cui_text(cui: Column) -> Column:
    return F.format_string("C%07d", cui)


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    shorter = F.least(e1 - s1, e2 - s2)
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when((shorter <= 0) | (inter <= 0), 0.0).otherwise(inter / shorter)


def first_sentences(text: Column, n: int | None) -> Column:
    """Up to the end of the n-th delimiter run; all of it if there are fewer, or n is none or 0."""
    if not n or n <= 0:
        return text
    head = F.regexp_extract(text, rf"(?s)^(?:[^.;!\n]*[.;!\n]+){{{n}}}", 0)
    return F.when(head == "", text).otherwise(head)


def window(text: Column, start: Column, end: Column, chars: int = 80) -> Column:
    left = F.greatest(F.lit(0), start - chars)
    return F.struct(F.substr(text, left + 1, start - left).alias("left"), F.substr(text, start + 1, end - start).alias("span"), F.substr(text, end + 1, F.lit(chars)).alias("right"))


def score_bucket(score: Column) -> Column:
    return F.when(score < 0.55, "low").when(score >= 0.70, "high").otherwise("mid")


def group_color(group: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(K.GROUP_COLORS), F.upper(F.trim(group))), F.lit(K.OTHER_GROUP))


def assertion_color(assertion: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(K.ASSERTION_COLORS), F.upper(F.trim(assertion))), F.lit(K.OTHER_ASSERTION))
