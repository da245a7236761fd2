"""Folds over the sorted rows of each key, with a state that outlives a batch: no key is a group in memory or an array in a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Step(Protocol):
    """The state of one key."""

    def feed(self, columns: list[list], lo: int, hi: int, out: list[tuple]) -> None:
        """Takes the rows lo to hi of the columns, in order, and appends to out what is settled."""

    def end(self, out: list[tuple]) -> None:
        """Appends to out what is left after the key's last row."""


def fold(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str], step: Callable[[], Step], schema: str, dealt: bool = False) -> DataFrame:
    """keys and schema: what the steps of each key's rows (columns, in order) append. Nulls are a key of their own.

    Rows are dealt by keys and sorted in the partition, which spills; a task then holds a batch of rows and the state of one key. The
    time of one key is that of its rows, as each step needs the last one's state. dealt: rows of a key are in one partition already."""
    names = [f"__k{i}" for i in range(len(keys))]
    spread = rows if dealt else rows.repartition(*keys)
    ready = spread.sortWithinPartitions(*keys, *order).select(*[rows[k].alias(n) for k, n in zip(keys, names, strict=True)], *columns)
    kinds = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(kinds)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None
        out: list[tuple] = []

        def settled(found: list[tuple]) -> None:
            out.extend([(*key, *x) for x in found])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [c.to_pylist() for c in batch.columns[n_keys:]]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in batch.columns[:n_keys]:
                code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            heads = np.flatnonzero(change)
            own = [c.take(pa.array(heads)).to_pylist() for c in batch.columns[:n_keys]]
            for at, (lo, hi) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True)):
                here = tuple(c[at] for c in own)
                found: list[tuple] = []
                if state is None or here != key:
                    if state is not None:
                        state.end(found)
                        settled(found)
                        found = []
                    state, key = step(), here
                state.feed(held, lo, hi, found)
                settled(found)
            if len(out) >= 10_000:
                yield _batch(out, arrow)
                out = []
        if state is not None:
            found = []
            state.end(found)
            settled(found)
        if out:
            yield _batch(out, arrow)

    return ready.mapInArrow(run, kinds)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Apart:
    """Keeps each span that begins at the last kept one's end or later."""

    def __init__(self) -> None:
        self.upto = 0

    def feed(self, columns: list[list], lo: int, hi: int, out: list[tuple]) -> None:
        upto = self.upto
        for start, end in zip(columns[0][lo:hi], columns[1][lo:hi], strict=True):
            if start >= upto and end > start:
                upto = end
                out.append((start, end))
        self.upto = upto

    def end(self, out: list[tuple]) -> None:
        pass


def apart(spans: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """keys, start, end of spans (keys, start, end): of each key in order of start, the longer first, a span that begins before the last
    kept one's end is skipped. Null, empty and negative spans are left out; repeated rows count once; other columns are left out."""
    good = spans.filter("start >= 0 and end > start")
    order = [good["start"].asc(), good["end"].desc()]
    kind = good.schema["start"].dataType.simpleString(), good.schema["end"].dataType.simpleString()
    return fold(good, keys, order, ["start", "end"], _Apart, f"start {kind[0]}, end {kind[1]}", dealt)
