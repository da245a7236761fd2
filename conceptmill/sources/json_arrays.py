"""JSON arrays of any size: a file is read in splits at its commas, and what a comma means is found by composing the splits.

The text source cuts a file at commas, a split a task. First every split says, for a start outside and inside a string, where it would
end and by how much the nesting would change; these small tables, taken in order, give each split its start. Then the splits count
the items that begin in them, which gives each its first position, and at last they write their items. Only the pieces of an item
that a split's border cuts are put together by a shuffle. The driver holds a row per split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[{\]}]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)
_ANY = re.compile(r'["\[{\]}]')
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:')


def _brackets(text: str, inside: bool) -> tuple[list[tuple[int, int]], bool]:
    """Places of brackets outside strings with +1 or -1, and whether the text ends inside a string. inside: it begins in one."""
    at, found = 0, []
    if inside:
        m = _REST.match(text)
        if not m[1]:
            return found, True
        at = m.end()
    if not _ANY.search(text, at):
        return found, False
    inside = False
    for m in _TOKEN.finditer(text, at):
        c = m[0][0]
        if c == '"':
            inside = not m[1]
        else:
            found.append((m.start(), 1 if c in "[{" else -1))
    return found, inside


class _Walk:
    """A split's fragments, with the state that each begins with: inside a string, depth, whether the wanted array's key is the last."""

    def __init__(self, inside: bool, depth: int, wanted: bool, key: str | None):
        self.inside, self.depth, self.wanted, self.key = inside, depth, wanted, key
        self.level = 1 if key is None else 2
        self.keyed = False

    def step(self, text: str) -> tuple[bool, str | None]:
        """Whether an item of the array begins in the fragment, and the fragment's part of an item (None: it has none)."""
        began = not self.inside and self.depth == self.level and self.wanted
        lo, hi = (0, len(text)) if self.depth >= self.level and self.wanted else (None, None)
        start_inside, start_depth = self.inside, self.depth
        found, self.inside = _brackets(text, self.inside)
        if self.key is not None and not start_inside and start_depth < self.level and (m := _KEY.search(text, 0)) and self._outer(found, m.start()) == 1:
            self.wanted, self.keyed = m[1] == self.key, True
        for place, change in found:
            self.depth += change
            if change > 0 and self.depth == self.level and self.wanted and text[place] == "[":
                lo, hi, began = place + 1, len(text), True
            elif change < 0 and self.depth == self.level - 1 and lo is not None:
                hi = place
        if lo is None or not self.wanted:
            return False, None
        return began, text[lo:hi]

    def _outer(self, found: list[tuple[int, int]], place: int) -> int:
        return self.depth + sum(change for at, change in found if at < place)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", ",").text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True)


def _frame(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, schema.split(", "))])
    return pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(kinds)}, schema=kinds)


#: What a split says of itself, for both starts, and of the items that begin in it, before and after its first key.
_ENDS = "file long, block long, out_in boolean, out_depth long, in_in boolean, in_depth long"
_COUNTS = "file long, block long, keyed boolean, wanted boolean, first long, rest long"
_CUT = "file long, pos long, block long, part boolean, value string"


def items(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """file (a hash of its path), pos (long, from 0 in each file) and value (the item's JSON text) of files that each are one array or,
    with key, of the array under that key of files that each are one object. An empty array has no row."""
    parts = _fragments(spark, path)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple, list] = {}
        for block, text in _by_block(batches):
            held = out.setdefault(block, [False, 0, True, 0])
            for k in (0, 2):
                found, held[k] = _brackets(text, held[k])
                held[k + 1] += sum(change for _, change in found)
        yield _frame([(*b, *x) for b, x in out.items()], _ENDS)

    starts: dict[tuple, list] = {}
    file = None
    for r in sorted(parts.mapInArrow(ends, _ENDS).collect()):
        inside, depth = (False, 0) if r.file != file else (inside, depth)
        file, starts[r.file, r.block] = r.file, [inside, depth]
        inside, depth = (r.in_in, depth + r.in_depth) if inside else (r.out_in, depth + r.out_depth)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[tuple, list] = {}
        for block, text in _by_block(batches):
            if block not in walks:  # until a key comes, the one before may be the wanted one
                walks[block] = [_Walk(*starts[block], True, key), 0, 0]
            walk = walks[block]
            began, _ = walk[0].step(text)
            walk[2 if walk[0].keyed else 1] += began
        yield _frame([(*b, w.keyed, w.wanted, first, rest) for b, (w, first, rest) in walks.items()], _COUNTS)

    file = None
    for r in sorted(parts.mapInArrow(counts, _COUNTS).collect()):
        wanted, upto = (key is None, 0) if r.file != file else (wanted, upto)
        file = r.file
        starts[r.file, r.block] += [wanted, upto]
        upto += (r.first if wanted else 0) + r.rest
        wanted = r.wanted if r.keyed else wanted

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, now, pos, held, first = None, None, 0, [], False
        out: list[tuple] = []
        for block, text in _by_block(batches):
            if block != now:
                if held:
                    out.append((now[0], pos - 1, now[1], True, ",".join(held)))
                now, held = block, []
                inside, depth, is_wanted, pos = starts[block]
                walk, first = _Walk(inside, depth, is_wanted, key), True
            began, piece = walk.step(text)
            if began:
                if held:
                    out.append((now[0], pos - 1, now[1], first, ",".join(held)))
                pos, held, first = pos + 1, [], False
            if piece is not None:
                held.append(piece)
            if len(out) >= 10_000:
                yield _frame(out, _CUT)
                out = []
        if held:
            out.append((now[0], pos - 1, now[1], True, ",".join(held)))
        yield _frame(out, _CUT)

    made = parts.mapInArrow(cut, _CUT)
    whole = made.filter("not part").select("file", "pos", "value")
    pieces = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = made.filter("part").groupBy("file", "pos").agg(F.array_join(F.transform(pieces, lambda x: x["value"]), ",").alias("value"))
    return whole.unionByName(joined).filter(F.col("value").rlike(r"\S"))


def array(spark: SparkSession, path: str, item: str, key: str | None = None) -> DataFrame:
    """pos (int), item (of the type item) of an array, see items; an item that isn't of the type is null. Of several files the positions
    repeat."""
    value = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), f"array<{item}>")
    return items(spark, path, key).select(F.col("pos").cast("int").alias("pos"), F.get(value, 0).alias("item"))


def positional(spark: SparkSession, path: str, wanted: DataFrame, item: str = "string", key: str | None = None) -> DataFrame:
    """pos, item of the array's items at the wanted positions (column pos): an equi-join; an error when it runs if the array has none at
    one."""
    held = array(spark, path, item, key).withColumn("__there", F.lit(True))
    found = wanted.select("pos").join(held, "pos", "left")
    there = F.when(F.col("__there").isNull(), F.raise_error(F.format_string("no item %d", "pos"))).otherwise(F.col("pos"))
    return found.select(there.cast("int").alias("pos"), "item")


def write(df: DataFrame, path: str) -> None:
    """Files that each are one JSON array, a file a partition, rows in the order of the partition; a line a row, as it comes."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            out = []
            for j in batch.column(0).to_pylist():
                out.append(before + j)
                before = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(["]" if before == "," else "[]"])})

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    rows.mapInArrow(lines, "value string").write.text(path)
