"""Matrices of vectors in .npy files as a data source: format "npy", of a file or a folder of parts, through the URI's file system.

    spark.dataSource.register(NpyDataSource)
    spark.read.format("npy").load("s3://bucket/vectors.npy")
    vectors.write.format("npy").mode("append").save("hdfs://host/vectors")

Only headers are read while planning; a task reads the bytes of its rows. A writing task makes a file of its own, with the row numbers
in one beside it, under a name that readers skip; commit gives the files of the tasks that Spark took their names and removes the
job's others. What a job left that never came to its commit is never read.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "concept_row long, v array<float>"
#: Bytes of a partition, and rows of a batch.
_PART, _ROWS = 1 << 26, 1024


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:", "", uri).lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def header(fs: pafs.FileSystem, path: str) -> tuple[int, tuple[int, ...], np.dtype]:
    """Where the numbers begin, the shape and the type of the numbers; an error for anything but an array in rows."""
    with fs.open_input_file(path) as f:
        head = f.read(1 << 12)
    made = io.BytesIO(head)
    try:
        version = np.lib.format.read_magic(made)
        shape, by_column, kind = np.lib.format.read_array_header_1_0(made) if version == (1, 0) else np.lib.format.read_array_header_2_0(made)
    except ValueError as e:
        raise ValueError(f"{path} is not an .npy file: {e}") from e
    if by_column and len(shape) > 1 or kind.kind not in "fiu":
        raise ValueError(f"{path} must hold numbers by rows")
    return made.tell(), shape, kind


@dataclass
class _Rows(InputPartition):
    path: str
    lo: int
    hi: int
    base: int | None  # number of the file's first row; None: numbers are in the file beside it


def _beside(path: str) -> str:
    return path.removesuffix(".npy") + ".rows"


class _Reader(DataSourceReader):
    def __init__(self, uri: str, rows: int | None):
        self.uri, self.rows = uri, rows

    def partitions(self) -> list[_Rows]:
        fs, path = filesystem(self.uri)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(path))
            files = sorted(f.path for f in found if f.path.endswith(".npy") and not f.base_name.startswith((".", "_")))
            numbered = {f.path for f in found if f.path.endswith(".rows")}
        else:
            files, numbered = [path], set()
        parts, base, dims = [], 0, set()
        for file in files:
            _, shape, kind = header(fs, file)
            if len(shape) != 2:
                raise ValueError(f"{file} must hold a matrix, not {len(shape)} dimensions")
            dims |= {shape[1]} if shape[0] else set()
            step = self.rows or max(1, _PART // max(1, shape[1] * kind.itemsize))
            own = None if _beside(file) in numbered else base
            parts += [_Rows(file, lo, min(shape[0], lo + step), own) for lo in range(0, shape[0], step)]
            base += shape[0]
        if len(dims) > 1:
            raise ValueError(f"vectors of different lengths: {sorted(dims)}")
        return parts or [_Rows("", 0, 0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.uri)
        if part.lo == part.hi:
            return
        at, shape, kind = header(fs, part.path)
        width = shape[1] * kind.itemsize
        with fs.open_input_file(part.path) as f:
            numbers = None
            if part.base is None:
                with fs.open_input_file(_beside(part.path)) as g:
                    g.seek(8 * part.lo)
                    numbers = np.frombuffer(g.read(8 * (part.hi - part.lo)), "<i8")
            f.seek(at + part.lo * width)
            for lo in range(part.lo, part.hi, _ROWS):
                hi = min(part.hi, lo + _ROWS)
                data = f.read((hi - lo) * width)
                if len(data) < (hi - lo) * width:
                    raise ValueError(f"{part.path} ends before its last row")
                values = pa.array(np.frombuffer(data, kind).astype(np.float32))
                offsets = pa.array(np.arange(0, (hi - lo) * shape[1] + 1, shape[1], dtype=np.int32)) if shape[1] else pa.array(np.zeros(hi - lo + 1, np.int32))
                rows = np.arange(part.base + lo, part.base + hi) if numbers is None else numbers[lo - part.lo : hi - part.lo]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["concept_row", "v"])


@dataclass
class _Made(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, uri: str, kind: str, overwrite: bool):
        self.uri, self.kind, self.overwrite, self.job = uri, np.dtype(kind), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Made:
        fs, path = filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        name, numbers, n, dim, body = f"part-{self.job}-{uuid.uuid4().hex}", [], 0, None, io.BytesIO()
        for row in rows:  # a task's vectors; deal them to as many tasks as memory asks for
            if row.concept_row is None or row.v is None:
                raise ValueError("concept_row and v must not be null")
            v = np.asarray(row.v, self.kind.newbyteorder("<"))
            dim = len(v) if dim is None else dim
            if len(v) != dim:
                raise ValueError(f"vectors of different lengths: {dim} and {len(v)}")
            body.write(v.tobytes())
            numbers.append(row.concept_row)
            n += 1
        if not n:
            return _Made([])
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": self.kind.newbyteorder("<").str, "fortran_order": False, "shape": (n, dim)})
        with fs.open_output_stream(f"{path}/_{name}.npy") as f:
            f.write(head.getvalue())
            f.write(body.getbuffer())
        with fs.open_output_stream(f"{path}/_{name}.rows") as f:
            f.write(np.array(numbers, "<i8").tobytes())
        return _Made([name])

    def commit(self, messages: list) -> None:
        fs, path = filesystem(self.uri)
        if self.overwrite:
            self._remove(fs, path, lambda n: n.startswith("part-"))
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{path}/_{name}.rows", f"{path}/{name}.rows")
                fs.move(f"{path}/_{name}.npy", f"{path}/{name}.npy")
        self._remove(fs, path, lambda n: n.startswith(f"_part-{self.job}"))

    def abort(self, messages: list) -> None:
        fs, path = filesystem(self.uri)
        for m in messages:
            for name in m.names if m else []:
                for end in (".npy", ".rows"):
                    if fs.get_file_info(f"{path}/_{name}{end}").type == pafs.FileType.File:
                        fs.delete_file(f"{path}/_{name}{end}")

    def _remove(self, fs: pafs.FileSystem, path: str, which) -> None:
        for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if which(f.base_name):
                fs.delete_file(f.path)


class NpyDataSource(DataSource):
    """Options: path; rows (of a reading task); dtype of written numbers, float32 by default or float16."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options["rows"]) if "rows" in self.options else None)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("dtype", "float32"), overwrite)


def read(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """concept_row, v of a file (rows numbered by place) or a folder of parts (numbered by the file beside each, else on and on by
    name)."""
    spark.dataSource.register(NpyDataSource)
    reader = spark.read.format("npy")
    return (reader.option("rows", rows) if rows else reader).load(path)


def append(vectors: DataFrame, path: str, dtype: str = "float32") -> None:
    """Adds vectors (concept_row, v) to the folder of parts at path."""
    vectors.sparkSession.dataSource.register(NpyDataSource)
    row = vectors["concept_row"].cast("long").alias("concept_row")
    vectors.select(row, vectors["v"].cast("array<float>").alias("v")).write.format("npy").mode("append").option("dtype", dtype).save(path)


def exists(path: str) -> bool:
    fs, local = filesystem(path)
    return fs.get_file_info(local).type != pafs.FileType.NotFound


def append_missing(texts: DataFrame, embed, path: str, text: Column, dtype: str = "float32") -> None:
    """Embeds the texts (concept_row, ...) whose row the folder at path lacks and adds them: a run that was cut short goes on where its
    last whole one ended."""
    if exists(path):
        texts = texts.join(read(texts.sparkSession, path).select("concept_row"), "concept_row", "left_anti")
    append(texts.select("concept_row", embed(text).alias("v")), path, dtype)
