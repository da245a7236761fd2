"""Mentions of a sentence, with offsets, as columns: the sentence is marked where it is to be cut, split there, and each piece trimmed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .pieces import MARK, SPACE, SPACES, around, let, placed, plain, stripped, without_head, without_tail


def _known_headers() -> str:
    """A pattern of the section headers, as they may be written before a colon."""
    words = sorted(K.SECTION_HEADERS, key=len, reverse=True)
    flexible = ["".join({" ": " +", "/": " */ *"}.get(c, re.escape(c)) for c in w) for w in words]
    return rf"{SPACE}*(?:{'|'.join(flexible)}){SPACE}*:{SPACE}*"


def _wide(pattern: str) -> str:
    return pattern.replace(r"\s", SPACE)


_HEADERS = f"(?i:{_known_headers()})"
#: Each trim removes its fragment as often as it stands there, with the edge characters behind it. Repeated groups are possessive:
#: the JVM matches others by a call within a call for each repetition, and a long row of them ends the executor.
_HEAD = f"(?:{_HEADERS}{K.EDGE_CLASS}*+)++"
_LEAD = f"(?i:{_wide(K.LEAD_FRAGMENT)}{K.EDGE_CLASS}*+)++"
_GAP = rf"[{SPACES}{K.EDGE_CLASS[1:-1]}]"


def _row(fragment: str) -> str:
    """A pattern of fragments, which begin with white space, in a row up to the end, edge characters before, between and behind them."""
    word = rf"(?:{_wide(fragment.removeprefix(r"\s+"))})(?={_GAP}|\z)"
    return rf"{K.EDGE_CLASS}*{SPACE}+(?i:{word}(?:{_GAP}++(?<={SPACE}){word})*+){_GAP}*+"


_TAIL, _FIELD = _row(K.TAIL_FRAGMENT), _row(K.TAIL_FIELD)
#: What every piece to be trimmed, but for a header, begins or ends with, within so many characters: an edge character or gap, the first
#: word of a fragment and white space, white space and the last word of a fragment or field.
_FIRST = rf"(?i)^(?:{K.EDGE_CLASS}|(?:of|for|with|without|in|on|at|to|from){SPACE})"
_LAST = rf"(?i)(?:{_GAP}|{SPACE}(?:of|for|with|without|in|on|at|to|from|the|a|an|date|types?))$"
_END_CHARS = 8
#: K.SEPARATORS, by the first character: white space is taken whole, and is a separator by itself if it is long or holds a tab.
_SIGNS, _WORDS = "[,;/~|]", r"(?i:and|or)\b"
_SEPARATORS = rf"{SPACE}++(?:(?:{_SIGNS}|{_WORDS}){SPACE}*+|(?<={SPACE}{{3}})|(?<=\t)|(?<=\t{SPACE}))|{_SIGNS}{SPACE}*+|(?=[aAoO])\b{_WORDS}{SPACE}*+"


def _cut(body: Column) -> Column:
    """The pieces of a sentence's content between headers inside it and separators, with their offsets in it."""
    # a header inside the sentence cuts it, but not within the header that it begins with
    upto = F.char_length(F.regexp_extract(body, f"^{_HEADERS}", 0))
    segments = placed(F.split(F.regexp_replace(body, _wide(K.MID_HEADER), f"$1{MARK}$2"), MARK))
    marked = F.array_join(F.transform(segments, lambda p, i: F.when((i == 0) | (p["at"] < upto), p["part"]).otherwise(F.concat(F.lit(MARK + MARK), p["part"]))), "")
    every = F.split(around(F.when(body.contains(":"), marked).otherwise(body), _SEPARATORS), MARK)
    return F.filter(placed(every), lambda p, i: i % 2 == 0)


def _trimmed(p: Column) -> Column:
    """A piece without what is trimmed at its ends; looks at both ends first, as most pieces have nothing there."""
    first = lambda x: F.left(x["part"], F.lit(_END_CHARS)).rlike(_FIRST)
    last = lambda x: F.right(x["part"], F.lit(_END_CHARS)).rlike(_LAST)
    header = lambda x: x["part"].contains(":")
    head = lambda x: F.when(header(x), let(without_head(x, _HEAD), lambda y: without_head(y, _LEAD))).when(first(x), without_head(x, _LEAD)).otherwise(x)
    tail = lambda x: F.when(last(x), let(without_tail(x, _TAIL), lambda y: without_tail(y, _FIELD))).otherwise(x)
    return F.when(header(p) | first(p) | last(p), let(let(stripped(p, K.EDGE_CLASS), head), tail)).otherwise(p)


def content(sentence: Column, prefix: Column) -> Column:
    """struct<at, part> of a trimmed sentence's content, after its context prefix."""
    skip, s = F.char_length(prefix), plain(sentence)
    return stripped(F.struct(skip.alias("at"), F.when(skip == 0, s).otherwise(F.substr(s, skip + 1, F.char_length(s))).alias("part")), K.CONTENT_CLASS)


def pieces_of(body: Column) -> Column:
    """array<struct<at, part>>: the content's pieces that may be mentions, trimmed; none of a content of two characters at most."""
    found = F.filter(F.transform(_cut(body["part"]), _trimmed), lambda p: (F.char_length(p["part"]) > 2) | F.upper(p["part"]).isin(K.SAFE_PAIRS))
    return F.when(F.char_length(body["part"]) > 2, found).otherwise(F.array().cast("array<struct<at:int,part:string>>"))


def found_or_whole(sentence: Column, body: Column, found: Column) -> Column:
    """array<struct<at, part>>, offsets in the sentence less start_of: the pieces found; the whole content if none is left, the whole
    sentence if there is no content."""
    whole = F.when(F.char_length(body["part"]) <= 2, plain(sentence)).otherwise(body["part"])
    return F.when(F.size(found) == 0, F.array(F.struct(F.lit(0).alias("at"), whole.alias("part")))).otherwise(found)


def start_of(body: Column) -> Column:
    return F.when(F.char_length(body["part"]) <= 2, 0).otherwise(body["at"])


def to_cut_from(sentence: Column) -> Column:
    """The sentence if the text of a piece may not be the piece itself, else null: its marks were taken for spaces, and `$` also stands
    before a line's end at the end, so that a piece may have lost characters before that."""
    return F.when(sentence.rlike(rf"[{MARK}\n\r\x85\u2028\u2029]"), sentence)


def text_of(cut_from: Column, p: Column, start: Column) -> Column:
    """The text of a piece that starts there."""
    return F.when(cut_from.isNotNull(), F.substr(cut_from, start + 1, F.char_length(p["part"]))).otherwise(p["part"])


def mentions(sentence: Column, prefix: Column) -> Column:
    """array<struct<text,start,end>> of a trimmed sentence, after its context prefix; the whole content if no piece is left, the whole
    sentence if there is no content."""

    def span(body: Column, p: Column) -> Column:
        start = start_of(body) + p["at"]
        return F.struct(text_of(to_cut_from(sentence), p, start).alias("text"), start.alias("start"), (start + F.char_length(p["part"])).alias("end"))

    return let(content(sentence, prefix), lambda body: F.transform(found_or_whole(sentence, body, pieces_of(body)), lambda p: span(body, p)))
