"""Resumable runs over a folder that grows: each file once, by a checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def run_available(spark: SparkSession, path: str, schema: StructType | str, checkpoint: str, sink: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Reads the JSON-lines files under path that no run before has read, transforms them and appends Parquet to sink."""
    stream = transform(spark.readStream.schema(schema).json(path))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start().awaitTermination()


def pending(rows: DataFrame, done: DataFrame, key: str = "note_file") -> DataFrame:
    """Rows whose key hasn't been done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def read_notes(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """A stream over a folder that grows: kind "json" or "parquet" (rows of the schema), "text" (note_file, text: a note a file) or "binary"
    (note_file, bytes_read, text: as sources.files.notes, for bytes that may be damaged)."""
    reader = spark.readStream
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("note_file")
    if kind == "text":
        return reader.text(path, wholetext=True).select(name, F.col("value").alias("text"))
    if kind == "binary":
        raw = reader.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
        text = F.make_valid_utf8(F.col("content").cast("string"))
        return raw.select(F.element_at(F.split("path", "/"), -1).alias("note_file"), F.octet_length("content").alias("bytes_read"), text.alias("text"))
    return reader.schema(schema).format(kind).load(path)


@dataclass(frozen=True)
class Output:
    """Where a batch's rows go: transform makes them of the batch, into the table at path (Parquet, a folder a batch) or, if write is
    given, to what write(rows, batch_id) does, which must do no harm if it is called again for a batch that wasn't marked."""

    path: str
    transform: Callable[[DataFrame], DataFrame]
    write: Callable[[DataFrame, int], None] | None = None


def run_batches(stream: DataFrame, checkpoint: str, outputs: list[Output], key: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts a query that gives every batch to every output once.

    The batch's number names the folder that an output writes and the marker that says it is whole. A batch that comes again, as after
    a failure between two outputs, skips the outputs that have their marker and writes the folders of the others anew. With key, rows
    whose key an output's table holds from other batches are left out (a note that comes under two batches counts once). A batch is
    kept in memory or on the executors' disks while its outputs are written."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        open_ = [o for o in outputs if not _exists(spark, _marker(o, number))]
        if not open_:
            return
        batch.persist()
        try:
            for o in open_:
                rows = batch
                if key is not None and (held := _table(spark, o)) is not None:
                    rows = rows.join(held.filter(F.col("batch_id") != number).select(key).distinct(), key, "left_anti")
                made = o.transform(rows)
                if o.write is not None:
                    o.write(made, number)
                else:
                    made.write.mode("overwrite").parquet(f"{o.path}/batch_id={number}")
                _mark(spark, _marker(o, number))
        finally:
            batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def written(spark: SparkSession, output: Output) -> DataFrame | None:
    """What the marked batches of an output hold, with batch_id; None if there is none. A batch that was cut short isn't seen."""
    rows = _table(spark, output)
    if rows is None:
        return None
    done = [int(f.getPath().getName()) for f in _fs(spark, f"{output.path}/_done").listStatus(_path(spark, f"{output.path}/_done"))] if _exists(spark, f"{output.path}/_done") else []
    table = spark.createDataFrame([(n,) for n in done], "batch_id int")  # a row a batch
    return rows.join(F.broadcast(table), "batch_id", "left_semi")


def _marker(o: Output, number: int) -> str:
    return f"{o.path}/_done/{number}"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def _mark(spark: SparkSession, path: str) -> None:
    _fs(spark, path).create(_path(spark, path), True).close()


def _table(spark: SparkSession, o: Output) -> DataFrame | None:
    """The output's table, if it has a folder with rows."""
    where = _path(spark, f"{o.path}/batch_id=*/*.parquet")
    if not _fs(spark, o.path).globStatus(where):
        return None
    return spark.read.option("mergeSchema", "false").parquet(o.path)
