import zlib

import numpy as np
import pyarrow as pa
from conceptmill.llm import op1_repair as op
from conceptmill.llm.byte_bpe import ByteBpe
from tokenizers import Tokenizer

ODD = [None, "", " ", "a", "a  b", "  a", "a \nb", "a\n  b\n\n c ", "don't stop.'s, we'll", "x<|endoftext|>y z", "é" * 3000, "  日本 語", "tab\t tab", "a" * 5000, "the the the", "the the the"]


def plain(texts):
    t = Tokenizer.from_file(op.default_tokenizer())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_words_give_the_librarys_ids(spark, sf_dir):
    texts = [x or "" for x in ODD] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    codec = ByteBpe(op.default_tokenizer(), cached_words=500)
    for _ in range(2):
        ids, lens = codec.encode(pa.array(texts))
        want = plain(texts)
        assert lens.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.zeros(4097, np.uint32), rng.integers(0, 7, 20_000).astype(np.uint32), np.tile(rng.integers(0, 900, 50), 100).astype(np.uint32)):
        cuts = np.array([0, len(ids) // 3, len(ids) // 3, len(ids)])
        data = op.pack([5, None, 7], np.diff(cuts), ids, 1000)
        shard = op.Shard(data)
        assert (shard.all_ids() == ids).all() and shard.doc_ids == [5, None, 7]
        for k in range(3):
            assert (shard.document(k) == ids[cuts[k] : cuts[k + 1]]).all()
        for a, b in ((0, 1), (len(ids) // 2, len(ids) // 2 + 700), (len(ids) - 1, len(ids))):
            if 0 <= a < b <= len(ids):
                assert (shard.ids(a, b) == ids[a:b]).all()
    assert len(data) < 4 * len(ids)


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 900, 1000)
    ids = np.concatenate([np.append(passage, rng.integers(0, 900, 3)) for _ in range(64)]).astype(np.uint32)
    symbols, rules, lengths = op.compress(ids, 1000)
    assert lengths.max() >= 500 and len(symbols) < 64 * 8  # with symbols of 64 ids at most, a copy takes 16 or more
    assert np.unique((symbols[:-1] << 32) | symbols[1:], return_counts=True)[1].max() < 8
    assert (op.expand(symbols, rules, 1000) == ids).all()


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(ODD)] + [(4, "again", "y"), (4, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = op.read_digests(op.write_shards(docs, op.default_tokenizer(), f"file://{tmp_path}/s", shard_ids=50)).orderBy("start").collect()
    want = {(i, zlib.crc32(np.array([*w, 0], "<u4").tobytes()), len(w) + 1) for (i, _, _), w in zip(rows, plain([r[1] for r in rows]), strict=True)}
    assert {(r.doc_id, r.ids_crc32, r.n_tokens) for r in got} == want and len(got) == len(rows)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert op.read_digests(op.write_shards(docs.limit(0), op.default_tokenizer(), f"file://{tmp_path}/e")).count() == 0
