import hashlib
import io

import pyarrow.fs as pafs
import zstandard
from conceptmill.llm import op2_warc as op

BIG, BIG2 = "x\r\n\r\ny é" * 300, "WARC/1.1\r\n" * 200


def test_round_trip_and_random_access(spark, tmp_path):
    rows = [(1, "http://a/ b\r\nc", BIG, "q"), (2, None, BIG, "q"), (9, "u", BIG, "q"), (None, "u", BIG, "q"), (3, "u", None, "q"), (4, "é", "", "q"), (5, "u", "short", "q"), (6, "u", "short", "q"), (7, "u", BIG2, "q"), (7, "u", BIG2, "q"), (8, "u", "z" * 3_000_000, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    index = op.write_bundles(pages, f"file://{tmp_path}/w")
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op.read_bundles(index).collect())
    payloads = [(i, (h or "").encode()) for i, _, h, _ in rows]
    want = sorted((i or 0, len(p), hashlib.sha1(p).hexdigest(), "revisit" if p == BIG.encode() and i != 9 else "response", 9 if p == BIG.encode() and i != 9 else None) for i, p in payloads)
    assert got == want
    for r in index.collect():
        path = r.path.removeprefix("file://")
        with pafs.LocalFileSystem().open_input_file(path) as f:
            bundle = op.Bundle(f)
            assert bundle.record_map()[r.record_id] == (r.frame, r.offset, r.length)
            head, _, _ = op.parse(bundle.record((r.frame, r.offset, r.length)))
            assert op.page_of(head["WARC-Record-ID"]) == r.page_id
        # an ordinary reader sees one stream of records
        with open(path, "rb") as f:
            plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert op.read_bundles(op.write_bundles(pages, f"file://{tmp_path}/w")).count() == 0


def test_query(spark, sf_dir):
    rows = op.op2_warc(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
