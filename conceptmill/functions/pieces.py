"""Strings cut into pieces with their offsets, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as Python's regular expressions see it: the inside of a class, and a class. Characters of Latin-1 are listed, too, as the
#: JVM looks those up in a table; ranges would be slow where case is ignored.
SPACES = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\p{Z}"
SPACE = f"[{SPACES}]"
#: Stands around what a pattern finds; a text's own ones are taken for spaces while it is cut.
MARK = "\x01"
_FEW = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)


def offsets(parts: Column) -> Column:
    """The offset of each part in their concatenation, in code points. Sums are taken in chunks, the longer the more parts, so that the
    work hardly grows faster than the parts."""

    def of(lens: Column, n: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(lens) - 1, F.lit(0)) / n).cast("int")), lambda c: F.slice(lens, c * n + 1, n))
        return let(chunks, lambda cs: let(F.transform(cs, _sum), lambda totals: F.flatten(F.zip_with(cs, F.transform(totals, lambda _, c: _sum(F.slice(totals, F.lit(1), c))), _inside))))

    long = lambda lens: let(F.ceil(F.cbrt(2 * F.size(lens))).cast("int"), lambda n: of(lens, n))
    return let(F.transform(parts, F.char_length), lambda lens: F.when(F.size(lens) <= _FEW, _inside(lens, F.lit(0))).otherwise(long(lens)))


def _inside(chunk: Column, base: Column) -> Column:
    return F.transform(chunk, lambda _, i: base + _sum(F.slice(chunk, F.lit(1), i)))


def placed(parts: Column) -> Column:
    """array<struct<at, part>> of an array of parts."""
    whole = lambda ps: F.array(F.struct(F.lit(0).alias("at"), F.get(ps, F.lit(0)).alias("part")))
    return let(parts, lambda ps: F.when(F.size(ps) == 1, whole(ps)).otherwise(F.zip_with(offsets(ps), ps, lambda a, p: F.struct(a.alias("at"), p.alias("part")))))


def around(text: Column, pattern: str) -> Column:
    """text with marks around whatever pattern finds."""
    return F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")


def plain(text: Column) -> Column:
    return F.when(text.contains(MARK), F.translate(text, MARK, " ")).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<at, part>> of all that pattern finds, in order; an empty match counts for nothing."""
    every = placed(F.split(around(plain(text), pattern), MARK))
    return F.filter(every, lambda p, i: (i % 2 == 1) & (F.char_length(p["part"]) > 0))


def stripped(p: Column, chars: str) -> Column:
    """A piece without the characters of a class at both ends."""
    # most pieces have none there; `$` also stands before a line's end at the end
    ends = F.concat(F.left(p["part"], F.lit(1)), F.right(p["part"], F.lit(1)))
    # only the first character of a run is tried, so that long runs cost no more than their length
    bare = let(F.regexp_replace(p["part"], f"^{chars}+", ""), lambda left: F.struct((p["at"] + F.char_length(p["part"]) - F.char_length(left)).alias("at"), F.regexp_replace(left, f"(?<!{chars}){chars}++$", "").alias("part")))
    return F.when(ends.rlike(rf"{chars}|[\n\r\x85\u2028\u2029]"), bare).otherwise(p)


def without_head(p: Column, pattern: str) -> Column:
    rest = let(F.regexp_replace(p["part"], f"^(?:{pattern})", ""), lambda rest: F.struct((p["at"] + F.char_length(p["part"]) - F.char_length(rest)).alias("at"), rest.alias("part")))
    return F.when(p["part"].rlike(f"^(?:{pattern})"), rest).otherwise(p)


def without_tail(p: Column, pattern: str) -> Column:
    return F.struct(p["at"].alias("at"), F.regexp_replace(p["part"], f"(?:{pattern})$", "").alias("part"))
