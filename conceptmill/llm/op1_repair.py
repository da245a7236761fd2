"""Token ids as Re-Pair grammars: a binary shard format with random access.

A shard holds the ids of whole documents. Frequent pairs of ids are replaced by nonterminals, again and again;
the shard keeps the rules, the length of each nonterminal's expansion, the shortened sequence, and the
expanded position of every 512th symbol, so that any range of ids is decoded without the ids before it.

Shard layout, little-endian: header of 8 uint32 (magic, version, terminals, documents, ids, symbols, rules, sample
step); document ids int64; null flags uint8; ids of each document uint32; rules uint32 pairs; expansion lengths
uint32; positions uint32; symbols uint32 or, if the header's version is 1, uint16.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .common import new_path, slices, staged, table, text_or_empty
from .files import filesystem, make_dir

MAGIC, STEP = 0x43475052, 512
#: Ids after which a shard is closed (with the document that reaches it).
SHARD_IDS = 1 << 20
END_ID = 0

_codecs: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
    return _codecs[path]


# --- the grammar -----------------------------------------------------------------------------------------------


def compress(ids: np.ndarray, terminals: int, min_count: int = 8, per_round: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over ids, until no pair occurs min_count times. Each round replaces the per_round most frequent pairs at once; where two of them overlap the
    left one is taken, and a rule that is then used less than twice is dropped. After the first round only places are counted that
    touch a new symbol or held a frequent pair: any other pair can only have become rarer. Returns symbols, rules (n x 2; the k-th
    is symbol terminals + k), and the length of each rule's expansion."""
    seq = ids.astype(np.int64)
    rules, size = [np.zeros((0, 2), np.int64)], np.ones(terminals, np.int64)
    hot = np.arange(len(seq) - 1)
    while len(hot):
        pairs = (seq[hot] << 32) | seq[hot + 1]
        found, counts = np.unique(pairs, return_counts=True)
        good = counts >= min_count
        found, counts = found[good], counts[good]
        hot, at = _places(hot, pairs, found)
        if len(found) > per_round:
            best = np.zeros(len(found), bool)
            best[np.argsort(-counts, kind="stable")[:per_round]] = True
        else:
            best = np.ones(len(found), bool)
        taken = best[at]
        mark, which = hot[taken], at[taken]
        taken = _alternate(mark)
        mark, which = mark[taken], which[taken]
        used = np.bincount(which, minlength=len(found)) >= 2
        mark, which = mark[used[which]], which[used[which]]
        if not len(mark):
            break
        new = np.stack([found[used] >> 32, found[used] & 0xFFFFFFFF], axis=1)
        number = len(size) - 1 + np.cumsum(used)
        seq[mark] = number[which]
        rules.append(new)
        size = np.concatenate([size, size[new[:, 0]] + size[new[:, 1]]])
        # places in the shortened sequence
        keep = np.ones(len(seq), bool)
        keep[mark + 1] = False
        moved = np.cumsum(keep) - 1
        seq = seq[keep]
        next_ = np.zeros(len(seq) + 1, bool)
        next_[moved[hot[keep[hot]]]] = True
        next_[moved[mark]] = True
        next_[moved[mark] - 1] = True  # of the first symbol: the spare last place
        hot = np.flatnonzero(next_[: max(0, len(seq) - 1)])
    return seq, np.concatenate(rules), size[terminals:]


def _places(places: np.ndarray, pairs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose pair is one of found (sorted), and which: by a table of hashes, and by a search where two of found share a slot."""
    if not len(found):
        return places[:0], places[:0]
    slots = np.full(1 << 20, -1, np.int32)
    own = _short_hash(found)
    slots[own] = np.arange(len(found))
    shared = np.zeros(1 << 20, bool)
    shared[own[slots[own] != np.arange(len(found))]] = True
    hashes = _short_hash(pairs)
    at = slots[hashes]
    kept = np.flatnonzero(at >= 0)
    at = at[kept].astype(np.int64)
    again = np.flatnonzero(shared[hashes[kept]])
    at[again] = np.minimum(np.searchsorted(found, pairs[kept[again]]), len(found) - 1)
    hit = found[at] == pairs[kept]
    return places[kept[hit]], at[hit]


def _short_hash(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


def _alternate(mark: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring positions, the first, third, fifth and so on."""
    if not len(mark):
        return np.zeros(0, bool)
    head = np.concatenate([[True], np.diff(mark) > 1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(mark)), 0))
    return (np.arange(len(mark)) - first) % 2 == 0


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """All ids that symbols stand for, level by level."""
    seq = symbols.astype(np.int64)
    while (deep := seq >= terminals).any():
        n = np.where(deep, 2, 1)
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        out[at[~deep]] = seq[~deep]
        pair = rules[seq[deep] - terminals]
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq.astype(np.uint32)


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """As expand, for a whole shard: each rule is expanded once, and the sequence is put together from copies."""
    table = np.concatenate([np.arange(terminals, dtype=np.uint32), expand(np.arange(terminals, terminals + len(rules)), rules, terminals)])
    size = np.concatenate([np.ones(terminals, np.int64), lengths])
    starts, n = (np.cumsum(size) - size)[symbols], size[symbols]
    return table[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


# --- the shard -------------------------------------------------------------------------------------------------


def pack(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray, terminals: int) -> bytes:
    symbols, rules, lengths = compress(ids, terminals)
    size = np.concatenate([np.ones(terminals, np.int64), lengths])
    positions = (np.cumsum(size[symbols]) - size[symbols])[::STEP]
    narrow = terminals + len(rules) <= 0xFFFF
    parts = [
        struct.pack("<8I", MAGIC, 1 if narrow else 2, terminals, len(doc_ids), len(ids), len(symbols), len(rules), STEP),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), lens.astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), positions.astype("<u4").tobytes(), symbols.astype("<u2" if narrow else "<u4").tobytes(),
    ]
    return b"".join(parts)


class Shard:
    """Reads a shard; ids(start, end) and document(k) expand only the symbols that they need."""

    def __init__(self, data: bytes):
        magic, version, self.terminals, docs, self.n_ids, symbols, rules, self.step = struct.unpack_from("<8I", data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.lens = take("<u4", docs).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.positions = take("<u4", -(-symbols // self.step)).astype(np.int64)
        self.symbols = take("<u2" if version == 1 else "<u4", symbols)

    def all_ids(self) -> np.ndarray:
        return expand_all(self.symbols, self.rules, self.lengths, self.terminals)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        a = max(0, int(np.searchsorted(self.positions, start, "right")) - 1)
        b = int(np.searchsorted(self.positions, end, "left"))
        part = self.symbols[a * self.step : b * self.step].astype(np.int64)
        size = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])[part]
        upto = int(self.positions[a]) + np.cumsum(size)
        lo, hi = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, end, "left")) + 1
        skip = start - int(upto[lo] - size[lo])
        return expand(part[lo:hi], self.rules, self.terminals)[skip : skip + end - start]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k] + self.lens[k]))


# --- the operator ----------------------------------------------------------------------------------------------

INDEX = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"


def write_shards(docs: DataFrame, tokenizer_path: str, out_dir: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes shards in ascending id order under out_dir.

    Returns the index, a row for each shard: part, seq (the order of the shards), path, n_docs, n_ids, n_bytes. It is
    staged, so that later reads don't write again; a file of a task that was run again and that the index doesn't name is
    never read. A null text is empty (the end id alone); null ids come first; repeated ids stay, ordered by a hash of the
    text; an empty table gives no shard; other columns are left out."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, context = byte_bpe(tokenizer_path), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = filesystem(out_dir)
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        seq = count = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, count, held
            docs_ = [d for ds, _, _ in held for d in ds]
            data = pack(docs_, np.concatenate([n for _, n, _ in held]), np.concatenate([i for _, _, i in held]), codec.vocab_size)
            name = f"part-{part:06d}-{seq:06d}-{attempt}.rp"
            with fs.open_output_stream(posixpath.join(root, name)) as f:
                f.write(data)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{out_dir}/{name}"], "n_docs": [len(docs_)], "n_ids": [count], "n_bytes": [len(data)]})
            seq, count, held = seq + 1, 0, []
            # the pool keeps what the texts before took
            pa.default_memory_pool().release_unused()
            return row

        for batch in batches:
            for piece in slices(batch, 1, n_bytes=1 << 21):
                ids, lens = codec.encode(piece.column(1))
                out = np.full(len(ids) + len(lens), end_id, np.uint32)
                ends = np.cumsum(lens + 1) - 1
                keep = np.ones(len(out), bool)
                keep[ends] = False
                out[keep] = ids
                doc_ids, begin = piece.column(0).to_pylist(), 0
                while begin < len(doc_ids):
                    base = int(ends[begin - 1]) + 1 if begin else 0
                    upto = min(len(doc_ids), int(np.searchsorted(ends, base + shard_ids - count, "left")) + 1)
                    stop = int(ends[upto - 1]) + 1
                    held.append((doc_ids[begin:upto], lens[begin:upto] + 1, out[base:stop]))
                    count, begin = count + stop - base, upto
                    if count >= shard_ids:
                        yield close()
        if held:
            yield close()

    make_dir(out_dir)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    return staged(ordered.select("id", "t").mapInArrow(write, INDEX), "op1-index")


def read_shards(index: DataFrame) -> DataFrame:
    """A row per document, from the shard files: doc_id, start (ids before it, over all shards in order), n_tokens, ids (binary, little-endian uint32)."""
    return _read(index, "doc_id long, start long, n_tokens long, ids binary", lambda ids: ids.astype("<u4").tobytes())


def read_digests(index: DataFrame) -> DataFrame:
    """As read_shards, with the unsigned CRC-32 of the ids in their place."""
    return _read(index, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(index: DataFrame, schema: str, of) -> DataFrame:
    from pyspark.sql import Window as W

    # starts: within a part by a window, and over the parts (a row each) by one over their sums
    sums = index.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = sums.withColumn("before", F.sum("part_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    inside = index.withColumn("inside", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)))
    placed = inside.join(before.select("part", "before"), "part").select("path", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("base"))
    last = schema.split()[-2]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    shard = Shard(f.read())
                ids = shard.all_ids()
                made = [of(ids[a : a + n]) for a, n in zip(shard.starts.tolist(), shard.lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(base + shard.starts, pa.int64()), "n_tokens": pa.array(shard.lens, pa.int64()), last: pa.array(made, pa.binary() if last == "ids" else pa.int64())})

    # a number of partitions, as the rows are few and small: without one they would be one task
    return placed.repartition(max(1, min(index.count(), 20_000) // 2), "path").mapInArrow(read, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_shards(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes docs as shards into the shared folder and returns the index."""
    return write_shards(docs, tokenizer_path or default_tokenizer(), new_path(docs.sparkSession, "op1-shards"))


def op1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, read back from the shards: doc_id, start, n_tokens, ids_crc32. Null texts hold the end id alone."""
    return read_digests(token_shards(table(spark, sf_dir, "documents")))
