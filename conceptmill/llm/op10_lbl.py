"""Scoring by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The model predicts a token from the two before it: the context vectors are mixed by a matrix for each place, and the score of
a class, or of an entry within its class, is the product of that prediction with its vector, plus its bias. The vocabulary is
the end, a band for the rare tokens of each power of two of their count, and the frequent tokens, whose number follows the
root of that of all distinct tokens. An entry's probability is that of its class times its own within the class, each
normalised: batches of distinct contexts times all class vectors, and times all vectors of a class, give every score. The share of a band is dealt
among the tokens it stands for by their smoothed counts.

Texts are coded in blocks. A block has a lexicon of its own; the lexicons are summed over the corpus and each block gets its
tokens' counts back, so that no task holds the vocabulary of the corpus. Training is by rounds: every block of training texts
trains the model of the last round on its own, and the blocks' models are averaged by their tokens.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table, text_or_empty

#: Tokens after which a block is closed; frequent tokens that have a vector, as a multiple of the root of the distinct tokens; its
#: length; noise classes of a batch, and noise entries of a class in it; tokens of a batch; passes over all training blocks.
BLOCK_TOKENS, VOCAB_RATE, DIM, NOISE, MEMBERS, BATCH, ROUNDS = 1 << 20, 8, 16, 64, 4, 4096, 2
#: The end of a text, which no word can equal, and the entries of the model's vocabulary before the frequent tokens: the end, then
#: the bands, the first of which also stands for unknown tokens.
END_TOKEN = " "
END, BANDS = 0, 1
SMOOTH = 0.1
#: Models of a group of the sum; training tokens of a task for each number of the model.
FAN_IN, NUMBER_TOKENS = 64, 16


# --- blocks ----------------------------------------------------------------------------------------------------

CODED = "kind string, block long, id long, held_out boolean, n_tokens long, codes binary, token string, code int, count long"


def _lexicon() -> defaultdict[bytes, int]:
    """Gives each new word the next number."""
    lexicon: defaultdict[bytes, int] = defaultdict()
    lexicon.default_factory = lexicon.__len__
    return lexicon


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and the number of those before each text and after the last."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    # a text that begins or ends with white space has an empty word there
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def _numbered(words: list[pa.Array], lens: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words and then the end, and the numbers of all words, with that of the end behind each text; lens counts it."""
    found = pa.chunked_array(words, words[0].type).dictionary_encode()
    # without any words there are no chunks; otherwise all share one dictionary
    distinct = found.chunk(0).dictionary if found.num_chunks else words[0]
    codes, ends = np.empty(int(lens.sum()), np.int32), np.zeros(int(lens.sum()), bool)
    ends[np.cumsum(lens) - 1] = True
    codes[ends] = len(distinct)
    codes[~ends] = np.concatenate([np.empty(0, np.int32), *(x.indices.to_numpy() for x in found.chunks)])
    return pa.concat_arrays([distinct, pa.array([END_TOKEN], distinct.type)]), codes


BLOCK_SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("codes", pa.binary()), ("token", pa.string()), ("code", pa.int32()), ("count", pa.int64())])


def blocks(batches: Iterator[pa.RecordBatch], part: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """The rows of coded for (id, text) of a partition."""
    seq = total = 0
    held: list[tuple[list[int | None], np.ndarray, np.ndarray, pa.Array]] = []

    def rows(kind: str, n: int, **given) -> pa.RecordBatch:
        given |= {"kind": [kind] * n, "block": np.full(n, (part << 24) + seq)}
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in BLOCK_SCHEMA], schema=BLOCK_SCHEMA)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal seq, total, held
        ids, (out, lens) = [i for x in held for i in x[0]], (np.concatenate([x[k] for x in held]) for k in (1, 2))
        lexicon, codes = _numbered([x[3] for x in held], lens)
        counts = np.bincount(codes[np.repeat(~out, lens)], minlength=len(lexicon))
        upto = np.cumsum(lens)
        yield rows("doc", len(ids), id=ids, held_out=out, n_tokens=lens, codes=[codes[a:b].tobytes() for a, b in zip(upto - lens, upto, strict=True)])
        for lo in range(0, len(lexicon), 50_000):
            n = len(lexicon[lo : lo + 50_000])
            yield rows("word", n, token=lexicon[lo : lo + n], code=np.arange(lo, lo + n, dtype=np.int32), count=counts[lo : lo + n])
        seq, total, held = seq + 1, 0, []

    for texts in (x for batch in batches for x in slices(batch, 1, n_bytes=1 << 21)):
        ids = texts.column(0).to_pylist()
        out = np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids), bool, len(ids))
        words, upto = _words(texts.column(1))
        # up to the text that fills the block, again and again
        lo = 0
        while lo < len(ids):
            lens = np.diff(upto[lo:]) + 1
            hi = lo + 1 + int(np.searchsorted(np.cumsum(lens)[:-1], block_tokens - total))
            lens = lens[: hi - lo]
            held.append((ids[lo:hi], out[lo:hi], lens, words[upto[lo] : upto[hi]]))
            total, lo = total + int(lens.sum()), hi
            if total >= block_tokens:
                yield from close()
    if held:
        yield from close()


def coded(docs: DataFrame, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """Rows of two kinds: doc (block, id, held_out, n_tokens, codes: int32) and word (block, token, code, count in training texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return blocks(batches, TaskContext.get().partitionId(), block_tokens)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, CODED)


# --- the model -------------------------------------------------------------------------------------------------


class Model:
    """q: a vector for each entry within its class, g: for each class, r: for each entry as context, c: a mixing matrix for each of the
    two places, b and d: biases of entries and classes. A class is a run of entries: those before first, then about the root of
    their number each."""

    def __init__(self, unigram: np.ndarray, first: int = 1, dim: int = DIM, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = len(unigram)
        self.starts = np.concatenate([[0], np.arange(first, n, max(1, math.isqrt(max(0, n - first))))])
        self.width = np.diff(np.append(self.starts, n))
        self.of = np.repeat(np.arange(len(self.starts)), self.width)
        self.share = np.add.reduceat(unigram, self.starts)
        self.q, self.r, self.g = (rng.normal(0, 0.1, (m, dim)).astype(np.float32) for m in (n, n, len(self.starts)))
        self.c = np.stack([np.eye(dim, dtype=np.float32) * s for s in (0.8, 0.4)])
        self.b, self.d = np.log(unigram / self.share[self.of]).astype(np.float32), np.log(self.share).astype(np.float32)

    NAMES = ("q", "r", "g", "c", "b", "d")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for name in self.NAMES:
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def predict(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        made, dim = np.empty((len(one), self.q.shape[1]), np.float32), self.q.shape[1]
        for lo in range(0, len(one), BATCH):
            before = np.stack([one[lo : lo + BATCH], two[lo : lo + BATCH]], axis=1)
            np.matmul(self.r.take(before, axis=0).reshape(len(before), -1), self.c.reshape(-1, dim), out=made[lo : lo + BATCH])
        return made

    def train(self, grams: np.ndarray, counts: np.ndarray, rate: float, seed: int) -> None:
        """One pass of NCE over distinct trigrams (one before, two before, token) with counts, in shuffled batches. The noise classes
        of a batch are drawn by their share and serve all of it; the noise entries of a class are drawn alike and serve its tokens
        in the batch. Steps are scaled by AdaGrad and touch the batch's rows alone."""
        rng = np.random.default_rng(seed)
        dim = self.q.shape[1]
        sums = {name: np.full_like(getattr(self, name), 1e-8) for name in self.NAMES}
        # entries in few bytes are sorted by radix
        short = np.min_scalar_type(len(self.b))
        of, starts = self.of.astype(short), self.starts
        pairs, targets = grams[:, :2].astype(short), grams[:, 2].astype(short)
        upto = np.cumsum(self.share / self.share.sum())

        def step(at: np.ndarray, **gradients: np.ndarray) -> None:
            for name, g in gradients.items():
                seen = sums[name].take(at, axis=0)
                seen += g * g
                sums[name][at] = seen
                g *= rate
                g /= np.sqrt(seen, out=seen)
                g += getattr(self, name).take(at, axis=0)
                getattr(self, name)[at] = g

        # a frequent trigram comes in several batches, so that no batch is one trigram's
        copies = -(-counts // 16)
        shares = (counts / copies).astype(np.float32)
        order = rng.permutation(np.repeat(np.arange(len(grams)), copies))
        log_kc = np.log(NOISE * self.share).astype(np.float32)
        log_kw = np.log(MEMBERS / self.width).astype(np.float32)
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            part = part.take(np.argsort(targets.take(part), kind="stable"))
            target, before = targets.take(part), pairs.take(part, axis=0)
            weight = shares.take(part)
            weight /= weight.sum()
            # both places side by side meet both matrices, one above the other
            r, c = self.r.take(before, axis=0).reshape(len(part), -1), self.c.reshape(-1, dim)
            p = r @ c
            # wanted classes against noise: sigmoid of the score less log(k times the noise's probability); a class that is drawn
            # several times is scored once and counts as often
            kind = of.take(target)
            drawn, times = np.unique(np.searchsorted(upto, rng.random(NOISE), "right").clip(max=len(upto) - 1).astype(short), return_counts=True)
            g_kind, g_drawn = self.g.take(kind, axis=0), self.g.take(drawn, axis=0)
            e = _miss(np.einsum("ij,ij->i", p, g_kind) + (self.d - log_kc).take(kind)) * weight
            en = _miss((log_kc - self.d)[drawn] - p @ g_drawn.T)
            en *= -weight[:, None]
            en *= times.astype(np.float32)
            g_kind *= e[:, None]
            gp = en @ g_drawn
            gp += g_kind
            # wanted entries against others of their class; the batch is in order of entries, so a class is a run
            heads = _heads(kind)
            here = kind[heads]
            noise = starts[here][:, None] + (rng.random((len(here), MEMBERS)) * self.width[here][:, None]).astype(np.int64)
            q_target = self.q.take(target, axis=0)
            w = _miss(np.einsum("ij,ij->i", p, q_target) + self.b.take(target) - log_kw.take(kind)) * weight
            q_target *= w[:, None]
            gp += q_target
            # runs in blocks of the same length, multiplied together; a block's rows beyond its run weigh nothing
            run, at, inside = _blocks(heads, len(kind))
            vectors, bias = self.q.take(noise, axis=0).take(run, axis=0), (log_kw[here][:, None] - self.b[noise]).take(run, axis=0)
            p_in = p.take(at, axis=0)
            wn = p_in @ vectors.transpose(0, 2, 1)
            np.subtract(bias[:, None, :], wn, out=wn)
            _miss(wn)
            wn *= np.where(inside, -weight.take(at), np.float32(0))[:, :, None]
            gp += (wn @ vectors).reshape(-1, dim).take(np.flatnonzero(inside), axis=0)
            q_noise, b_noise = wn.transpose(0, 2, 1) @ p_in, wn.sum(axis=1)
            mix = (r.T @ gp).reshape(self.c.shape)
            # the targets are sorted, so that their sums are those of runs
            same = _heads(target)
            own = np.concatenate([target[same], noise.take(run, axis=0).ravel().astype(short)])
            at, q, b = _sums(own, np.concatenate([_run_sums(w[:, None] * p, same), q_noise.reshape(-1, dim)]), np.concatenate([np.add.reduceat(w, same), b_noise.ravel()]))
            step(at, q=q, b=b)
            at, g, d = _sums(np.concatenate([here, drawn]), np.concatenate([_run_sums(e[:, None] * p, heads), en.T @ p]), np.concatenate([np.add.reduceat(e, heads), en.sum(axis=0)]))
            step(at, g=g, d=d)
            at, g = _sums(before.ravel(), (gp @ c.T).reshape(-1, dim))
            step(at, r=g)
            sums["c"] += mix * mix
            self.c += rate * mix / np.sqrt(sums["c"])

    def log_probs(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural logarithms. Each distinct context is multiplied with all class vectors once, and once with the vectors of
        each class that follows it, in batches."""
        n = len(self.b)
        key = (one.astype(np.int64) * n + two) * n + target
        order = np.argsort(key)
        key = key.take(order)
        distinct = _heads(key)
        grams = key.take(distinct)
        pair = grams // n
        target = grams - pair * n
        kind = self.of.take(target)
        # sorted, so that the grams of a context are a run, and in it those of a class, as classes are runs of entries
        heads = _heads(pair)
        contexts, which = pair.take(heads), np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(pair))))
        earlier = contexts // n
        p = self.predict(earlier, contexts - earlier * n)
        met = _heads(which * len(self.starts) + kind)
        kinds, whiches = kind.take(met), which.take(met)
        by = np.argsort(kinds.astype(np.min_scalar_type(len(self.starts))), kind="stable")
        bounds = np.searchsorted(kinds.take(by), np.arange(len(self.starts) + 1))
        z, zw = _log_sums(p, self.g, self.d), np.empty(len(met), np.float32)
        for k, (a, m) in enumerate(zip(self.starts, self.width, strict=True)):
            rows = by[bounds[k] : bounds[k + 1]]
            zw[rows] = _log_sums(p.take(whiches.take(rows), axis=0), self.q[a : a + m], self.b[a : a + m])
        logs = self.d.take(kind) + self.b.take(target) - z.take(which) - np.repeat(zw, np.diff(np.append(met, len(pair))))
        for lo in range(0, len(logs), BATCH):
            here = slice(lo, lo + BATCH)
            logs[here] += np.einsum("ij,ij->i", p.take(which[here], axis=0), self.g.take(kind[here], axis=0) + self.q.take(target[here], axis=0))
        made = np.empty(len(key))
        made[order] = np.repeat(logs, np.diff(np.append(distinct, len(key))))
        return made


def _heads(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def _miss(s: np.ndarray) -> np.ndarray:
    """1 less the sigmoid of s, in its place."""
    np.exp(s, out=s)
    s += 1
    return np.reciprocal(s, out=s)


def _log_sums(p: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """For each row of p the logarithm of the sum of exponentials of its scores. Few rows at a time, so that their scores stay in the
    cache; the greatest score is taken off first only where lengths and biases don't bound all scores."""
    z = np.empty(len(p), np.float32)
    if not len(p):
        return z
    rows, across = max(64, (1 << 16) // len(vectors)), np.ascontiguousarray(vectors.T)
    bound = math.sqrt(float(np.einsum("ij,ij->i", p, p).max()) * float(np.einsum("ij,ij->i", vectors, vectors).max())) + float(np.abs(bias).max())
    times = np.exp(bias) if bound < 60 else None
    for lo in range(0, len(p), rows):
        s = p[lo : lo + rows] @ across
        if times is not None:
            z[lo : lo + rows] = np.exp(s, out=s) @ times
        else:
            s += bias
            top = s.max(axis=1)
            s -= top[:, None]
            z[lo : lo + rows] = top + np.log(np.exp(s, out=s).sum(axis=1))
    return z if times is None else np.log(z, out=z)


def _run_sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The sums of runs of rows. Two numbers of four bytes side by side are added as one complex number."""
    if values.ndim == 2 and values.dtype == np.float32 and values.shape[1] % 2 == 0:
        return np.add.reduceat(np.ascontiguousarray(values).view(np.complex64), heads).view(np.float32)
    return np.add.reduceat(values, heads)


def _sums(rows: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows, ascending, and the sum of each one's values, for each of values."""
    by = np.argsort(rows, kind="stable")
    at = rows.take(by)
    heads = _heads(at)
    return at[heads], *(_run_sums(x.take(by, axis=0), heads) for x in values)


def _blocks(heads: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of n rows cut into blocks, about as long as a run is on average and 4 to 32 rows: the run of each block, its rows
    (block by block) and which of them belong to its run. Others are any rows."""
    long = 1 << min(5, max(2, (n // len(heads)).bit_length() - 1))
    ends = np.append(heads[1:], n)
    blocks = -(-(ends - heads) // long)
    run = np.repeat(np.arange(len(heads)), blocks)
    at = (heads[run] + (np.arange(len(run)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * long)[:, None] + np.arange(long)
    return run, at.clip(max=n - 1), at < ends[run][:, None]


def contexts(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one before, two before, token) of all texts; before a text stands the end."""
    flat = np.concatenate(tokens).astype(np.int64)
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(lens) - lens
    one, two = np.roll(flat, 1), np.roll(flat, 2)
    one[starts] = END
    two[starts] = END
    second = (starts + 1)[lens > 1]
    two[second] = END
    return one, two, flat


# --- the operator ----------------------------------------------------------------------------------------------


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: int | None = None, rounds: int = ROUNDS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams), score (the model's
    log10 probability of the whole text).

    Rows whose CRC-32 of the id as text (a null id: of nothing) is 0 modulo 10 are held out: nothing is learnt from them.
    A null text is empty and has its end alone; repeated rows stay, and teach twice. Without training tokens every token is
    unknown and base_score is 0, as is score. The model's frequent tokens are at most vocab, or VOCAB_RATE times the root of the
    distinct training tokens; tokens of about the same count (an eighth of a power of two) are all among them or none. They are
    collected: of ten thousand million distinct tokens 800,000 at most, a model of 106 MB."""
    spark = docs.sparkSession
    both = staged(coded(docs, id_col, text_col, block_tokens), "op10-coded", ["kind"])
    words = both.filter("kind = 'word'").select("block", "token", "code", "count")
    counts = staged(words.groupBy("token").agg(F.sum("count").alias("c")), "op10-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    bucket = F.floor(F.log2(F.greatest("c", F.lit(1))) * 8).cast("int")
    seen = counts.filter((F.col("c") > 0) & (F.col("token") != END_TOKEN)).withColumn("bucket", bucket)
    # tokens and occurrences of each bucket, the most frequent first, until the vocabulary is full
    sizes = {r.bucket: r for r in seen.groupBy("bucket").agg(F.count("*").alias("tokens"), F.sum("c").alias("c")).collect()}
    left = math.ceil(VOCAB_RATE * math.sqrt(v)) if vocab is None else vocab
    least = max(sizes, default=0) + 1
    for at in sorted(sizes, reverse=True):
        if sizes[at].tokens > left:
            break
        left, least = left - sizes[at].tokens, at
    top = sorted(seen.filter(F.col("bucket") >= least).select("token", "c").collect(), key=lambda r: (-r.c, r.token))
    end = counts.filter(F.col("token") == END_TOKEN).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # the smoothed mass of each band; the first has the unknown tokens'
    mass = np.zeros(max(0, least - 1) // 8 + 1)
    mass[0] = SMOOTH
    for at in sizes:
        if at < least:
            mass[at // 8] += sizes[at].c + SMOOTH * sizes[at].tokens
    first = BANDS + len(mass)
    entries = spark.createDataFrame([(END_TOKEN, END), *((r.token, k + first) for k, r in enumerate(top))], "token string, entry int")
    unigram = np.array([end, *mass, *(r.c for r in top)], np.float64) + SMOOTH
    unigram /= unigram.sum()
    width = "<u2" if len(unigram) <= 0xFFFF else "<u4"

    # each block's tokens with their counts over the corpus and their entries
    band = BANDS + F.floor(bucket / 8).cast("int")
    known = words.join(counts, "token").join(F.broadcast(entries), "token", "left").select(F.col("block").alias("of"), F.col("code").alias("at"), "c", F.coalesce("entry", band).alias("entry"))
    base_z = n + SMOOTH * (v + 1)
    texts = both.filter("kind = 'doc'").select("block", "id", "held_out", "n_tokens", "codes")

    def recode(lines: pd.DataFrame, lexicon: pd.DataFrame) -> pd.DataFrame:
        size = int(lexicon["at"].max()) + 1 if len(lexicon) else 0
        c, entry = np.zeros(size, np.int64), np.zeros(size, np.int64)
        c[lexicon["at"]], entry[lexicon["at"]] = lexicon["c"], lexicon["entry"]
        base = np.log10((c + SMOOTH) / base_z) if n else np.zeros(size)
        rest = np.zeros(size)
        rare = (entry >= BANDS) & (entry < first)
        rest[rare] = np.log10((c[rare] + SMOOTH) / mass[entry[rare] - BANDS])
        out = []
        for block, i, held_out, n_tokens, codes in zip(*(lines[x] for x in ("block", "id", "held_out", "n_tokens", "codes")), strict=True):
            k = np.frombuffer(codes, np.int32)
            out.append((block, i, held_out, n_tokens, int((c[k] > 0).sum()), float(base[k].sum()), float(rest[k].sum()), entry[k].astype(width).tobytes()))
        made = pd.DataFrame(out, columns=["block", "id", "held_out", "n_tokens", "n_known", "base_score", "rest", "entries"])
        return made.astype({"id": "Int64"})

    # a block's texts and its lexicon meet in one task
    schema = "block long, id long, held_out boolean, n_tokens long, n_known long, base_score double, rest double, entries binary"
    rows = staged(texts.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(recode, schema), "op10-entries")

    model = Model(unigram, first)
    for k in range(rounds if n else 0):
        model = _round(rows, model, unigram, first, width, k, n)
    flat = model.flat()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(unigram, first).load(flat)
        for frame in batches:
            made = np.zeros(len(frame))
            lo = 0
            lens = frame["n_tokens"].to_numpy()
            upto = np.cumsum(lens)
            while lo < len(frame):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 20), "right")))
                tokens = [np.frombuffer(x, width) for x in frame["entries"].iloc[lo:hi]]
                logs = own.log_probs(*contexts(tokens)) / np.log(10)
                made[lo:hi] = np.add.reduceat(logs, np.cumsum(lens[lo:hi]) - lens[lo:hi])
                lo = hi
            yield pd.DataFrame({"id": frame["id"].astype("Int64"), "held_out": frame["held_out"], "n_tokens": frame["n_tokens"], "n_known": frame["n_known"], "train_tokens": n, "base_score": frame["base_score"], "score": made + frame["rest"] if n else 0.0})

    out = rows.drop("block").mapInPandas(apply, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def _round(rows: DataFrame, model: Model, unigram: np.ndarray, first: int, width: str, k: int, n: int) -> Model:
    """Every task trains the model on the training texts of its partition, and the mean by tokens comes back: as long as the
    model, whatever the corpus. A task has at least NUMBER_TOKENS tokens for each number of the model, if that leaves a task a core, so that
    the models stay a small share of the input. They are summed in Spark by a tree: a group holds a piece of FAN_IN models at most."""
    flat, size = model.flat(), 4096

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = Model(unigram, first).load(flat), 0
        for step, frame in enumerate(batches):
            tokens = [np.frombuffer(x, width) for x, out in zip(frame["entries"], frame["held_out"], strict=True) if not out]
            lo = 0
            while lo < len(tokens):
                hi, here = lo, 0
                while hi < len(tokens) and here < 1 << 20:
                    here += len(tokens[hi])
                    hi += 1
                one, two, target = contexts(tokens[lo:hi])
                m = len(unigram)
                grams, counts = np.unique((one * m + two) * m + target, return_counts=True)
                own.train(np.stack([grams // (m * m), grams // m % m, grams % m], axis=1), counts, 0.03 / (1 + k), 1000 * k + step)
                total, lo = total + here, hi
        if total:
            x = own.flat() * np.float32(total / n)
            pieces = [x[a : a + size].astype("<f4").tobytes() for a in range(0, len(x), size)]
            yield pd.DataFrame({"task": TaskContext.get().partitionId(), "piece": range(len(pieces)), "x": pieces, "n": [total] * len(pieces)})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(x, "<f4") for x in frame.sort_values("task")["x"]]).sum(axis=0, dtype=np.float64)
        return pd.DataFrame({"task": [key[0]], "piece": [key[1]], "x": [x.astype("<f4").tobytes()], "n": [int(frame["n"].sum())]})

    schema = "task long, piece int, x binary, n long"
    training = rows.filter("not held_out").select("held_out", "entries")
    training = training.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, n // (NUMBER_TOKENS * len(flat))))
    # staged: an executor that is lost while models are summed costs no training
    parts, tasks = staged(training.mapInPandas(train, schema), "op10-models"), training.rdd.getNumPartitions()
    while tasks > 1:
        parts = parts.groupBy(F.floor(F.col("task") / FAN_IN).alias("to"), "piece").applyInPandas(add, schema)
        tasks = -(-tasks // FAN_IN)
    summed = parts.orderBy("piece").collect()
    if not summed:
        return model
    return model.load(np.concatenate([np.frombuffer(r.x, "<f4") for r in summed]) * np.float32(n / summed[0].n))


def op10_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null texts are their end alone."""
    return score(table(spark, sf_dir, "documents"))


