"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames with whole records in each, then two skippable frames: the record
map (identifier, frame, offset in the decompressed frame, length) and, last, a seek table in the public seekable
format (compressed and decompressed size of each frame, their number, magic 0x8F92EAB1). A reader that knows neither
decompresses the file as one WARC stream; one that does reads a record with one seek and one frame.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, sized, staged, table
from .files import filesystem, make_dir

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
MAP_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ---------------------------------------------------------------------------------------------------


def record(record_id: str, url: str | None, payload: bytes, n_bytes: int, sha1_hex: str, date: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or, with refers_to, a revisit, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The header fields and the block of the record at an offset, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    stop = end + 4 + int(head["Content-Length"])
    return head, data[end + 4 : stop], stop + 4


def page_of(record_id: str) -> int | None:
    part = record_id.strip("<>").split(":")[2]
    return None if part == "null" else int(part)


# --- bundles ---------------------------------------------------------------------------------------------------


class BundleWriter:
    """Writes records to a stream; add returns where the record will be: frame, offset, length."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes, self.packer = out, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame, self.size, self.sizes, self.map, self.written = [], 0, [], [], 0

    def add(self, record_id: str, data: bytes) -> tuple[int, int, int]:
        place = (len(self.sizes), self.size, len(data))
        self.map.append((record_id, *place))
        self.frame.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.written += len(packed)
            self.frame, self.size = [], 0

    def close(self) -> None:
        self._flush()
        rows = b"".join(struct.pack("<HIII", len(i), f, o, n) + i for i, f, o, n in ((i.encode(), f, o, n) for i, f, o, n in self.map))
        self.out.write(struct.pack("<II", MAP_MAGIC, len(rows)) + rows)
        table_ = b"".join(struct.pack("<II", a, b) for a, b in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table_)) + table_)


class Bundle:
    """Random access to a bundle: frames and single records."""

    def __init__(self, file):
        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        raw = self._at(size - 9 - entry * n, entry * n)
        self.sizes = [struct.unpack_from("<II", raw, entry * k) for k in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        packed, plain = self.sizes[k]
        return self.unpacker.decompress(self._at(self.starts[k], packed), max_output_size=plain)

    def record_map(self) -> dict[str, tuple[int, int, int]]:
        _, n = struct.unpack("<II", self._at(self.starts[-1], 8))
        raw, at, out = self._at(self.starts[-1] + 8, n), 0, {}
        while at < n:
            k, frame, offset, length = struct.unpack_from("<HIII", raw, at)
            out[raw[at + 14 : at + 14 + k].decode()] = (frame, offset, length)
            at += 14 + k
        return out

    def record(self, place: tuple[int, int, int]) -> bytes:
        frame, offset, length = place
        return self.frame(frame)[offset : offset + length]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.sizes)):
            data, at = self.frame(k), 0
            while at < len(data):
                head, block, at = parse(data, at)
                yield head, block


# --- the operator ----------------------------------------------------------------------------------------------

INDEX = "path string, record_id string, page_id long, frame int, offset long, length long"


def write_bundles(pages: DataFrame, out_dir: str, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the staged record index.

    A null html is an empty payload; a null url leaves the target out. Of rows with equal payloads (SHA-1) of at least
    least_bytes, those of the largest page_id are responses (repeated rows of it all are) and the others revisits; rows
    without a page_id are revisits only where another row of the payload has one. An empty table gives no bundle; other
    columns are left out. Bundles of attempts that failed are in no index and are never read."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    same = rows.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id"))
    same = staged(same.filter("n > 1").select("digest", "response_id"), "op2-repeats")
    joined = rows.join(sized(same), "digest", "left")
    refers = F.when(F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id")), F.col("response_id"))
    make_dir(out_dir)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, root = filesystem(out_dir)
        bundle = out = None
        seq = k = 0
        for batch in batches:
            found = []
            for page_id, url, payload, digest, n_bytes, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    name = f"part-{part:06d}-{seq:04d}-{attempt}.warc.zst"
                    out = fs.open_output_stream(posixpath.join(root, name), compression=None)
                    bundle, seq = BundleWriter(out), seq + 1
                record_id = f"urn:x-page:{'null' if page_id is None else page_id}:{part}.{k}"
                k += 1
                found.append((f"{out_dir}/{name}", record_id, page_id, *bundle.add(record_id, record(record_id, url, payload, n_bytes, digest, date, refers_to))))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    out.close()
                    bundle = None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["path", "record_id", "page_id", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()
            out.close()

    return staged(joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", "n_bytes", refers.alias("refers_to")).mapInArrow(write, INDEX), "op2-index")


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(index: DataFrame) -> DataFrame:
    """A row per record, from the bundles that the index names. The digest of every response is checked against its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    rows = []
                    for head, block in Bundle(f).records():
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind, refers = head["WARC-Type"], head.get("WARC-Refers-To")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"a payload in {path} is damaged")
                        n = len(payload) if kind == "response" else int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((page_of(head["WARC-Record-ID"]), n, digest, kind, page_of(refers) if refers else None))
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000], strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])

    paths = staged(index.select("path").distinct(), "op2-paths")
    # a task per bundle: without a number they would be few small rows, and one task
    return paths.repartition(max(1, min(paths.count(), 20_000)), "path").mapInArrow(read, ROWS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, read back from the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty
    payload."""
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), new_path(spark, "op2-bundles")))


ORACLE = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n_bytes, sha1(coalesce(html, '')) AS digest FROM pages
), same AS (
  SELECT digest, max(page_id) AS response_id, count(*) AS n FROM rows WHERE n_bytes >= 1000 GROUP BY digest
)
SELECT page_id, CAST(n_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n > 1 AND response_id IS DISTINCT FROM page_id AND response_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND response_id IS DISTINCT FROM page_id THEN response_id END AS refers_to
FROM rows LEFT JOIN same USING (digest)
"""
