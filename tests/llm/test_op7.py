import pytest
import sentencepiece
from conceptmill.llm import op7_counts as op
from tokenizers import Tokenizer

ODD = [None, "", " ", "a", "a", "a  b\n", "<s> x </s>", "<|endoftext|>", "日本 \U0001f600", "z" * 4000, None]


def plain(path, texts):
    if path.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_librarys(spark, tmp_path, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    rows = [(None if i == 2 else i, t, 1) for i, t in enumerate(ODD)] + [(1, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = op.token_counts(docs, path, f"file://{tmp_path}/c").collect()
    texts = [t or "" for _, t, _ in rows]
    want = sorted((-1 if i is None else i, len(t.encode()), n) for (i, _, _), t, n in zip(rows, texts, plain(path, texts), strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert op.token_counts(docs.limit(0), path, f"file://{tmp_path}/e").count() == 0


def test_cache_is_used_and_grows(spark, tmp_path, monkeypatch):
    path, cache = op.default_tokenizer(), f"file://{tmp_path}/c"
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "c")], "doc_id long, text string")
    op.token_counts(docs, path, cache).collect()
    assert op.open_cache(spark, cache).count() == 2
    more = docs.union(spark.createDataFrame([(4, "d e f"), (5, "a b"), (6, "d e f")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in op.token_counts(more, path, cache).collect()}
    assert op.open_cache(spark, cache).count() == 3
    assert got[1] == got[5] and got[4] == got[6] and len(got) == 6
