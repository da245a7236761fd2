"""Whole texts to token ids with a byte-level BPE of the tokenizers library, each distinct word encoded once.

A byte-level BPE first cuts a text into words (a space stays with the word after it) and merges bytes inside
each word only. So a text's ids are those of its words, one after another, and the library needs to see a
repeated word only once. Texts where cutting at spaces alone could differ from the library's own cut (a space
before other white space or at the end of a text) and texts that hold an added token go to the library whole.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept between batches; a bound on memory, not on what is encoded.
CACHED_WORDS = 200_000
_TEXTS = 128
#: White space as the library sees it, for RE2.
_WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class ByteBpe:
    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        # a task has one core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced_id = np.zeros(self.vocab_size, bool)
        self.spaced_id[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.startswith("Ġ")]] = True
        self.cached_words = cached_words
        self._reset()

    def _reset(self) -> None:
        self.words = pa.array([], pa.string())
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each text, flat, and how many each has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # few at a time: an encoding holds far more than its ids
        flat, lens = [], []
        for k in range(0, len(texts), _TEXTS):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + _TEXTS], add_special_tokens=False)]
            lens.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lens[-1].sum())))
        return np.concatenate(flat), np.concatenate(lens)

    def _odd(self, texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring_regex(texts, rf" (?:[{_WHITE}]|\z)")
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        return odd.to_numpy(zero_copy_only=False).astype(bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: strings without nulls. Returns all ids, flat, and the number of ids of each text."""
        odd = self._odd(texts)
        whole_ids, whole_lens = self._plain(texts.filter(pa.array(odd)).to_pylist())
        even = texts.filter(pa.array(~odd))
        ids, lens = self._by_words(even) if len(even) else (whole_ids[:0], whole_lens[:0])
        if not odd.any():
            return ids, lens
        # back in the order of the texts
        order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), kind="stable")
        all_ids, all_lens = np.concatenate([ids, whole_ids]), np.concatenate([lens, whole_lens])
        return _gather(all_ids, _starts(all_lens)[order], all_lens[order]), all_lens[order]

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word with a space before it. Many go to the library as one text: there, too, each is cut off at its space,
        and the ids that begin with a space tell where the words begin."""
        groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), 64), len(words)), pa.int32()), words)
        ids, _ = self._plain([" " + x for x in pc.binary_join(groups, " ").to_pylist()])
        begins = np.flatnonzero(self.spaced_id[ids])
        if len(begins) != len(words):
            return self._plain([" " + w for w in words.to_pylist()])
        return ids, np.diff(np.append(begins, len(ids)))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.split_pattern(texts, " ")
        offsets = np.asarray(pieces.offsets).astype(np.int64)
        offsets = offsets - offsets[0]
        coded = pieces.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        # the first piece of a text has no space before it
        heads = offsets[:-1]
        head_ids, head_lens = self._plain(words.take(pa.array(codes[heads])).to_pylist())
        n = len(words)
        inside = np.ones(len(codes), bool)
        inside[heads] = False
        counts = np.bincount(codes[inside], minlength=n)
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero((known < 0) & (counts > 0))
        new_ids, new_lens = self._spaced(words.take(pa.array(fresh)))
        starts, lens = np.zeros(n + len(heads), np.int64), np.zeros(n + len(heads), np.int64)
        old = np.flatnonzero(known >= 0)
        starts[old], lens[old] = self.starts[known[old]], self.lens[known[old]]
        starts[fresh], lens[fresh] = len(self.ids) + _starts(new_lens), new_lens
        starts[n:], lens[n:] = len(self.ids) + len(new_ids) + _starts(head_lens), head_lens
        codes[heads] = n + np.arange(len(heads))
        flat = np.concatenate([self.ids, new_ids, head_ids])
        out_lens = lens[codes]
        out = _gather(flat, starts[codes], out_lens)
        ends = np.concatenate([[0], np.cumsum(out_lens)])[offsets]
        self._keep(words, fresh, counts, starts, lens, flat)
        return out, np.diff(ends)

    def _keep(self, words: pa.Array, which: np.ndarray, counts: np.ndarray, starts: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> None:
        which = which[lens[which] <= 16]
        if len(self.words) + len(which) > self.cached_words:
            which = which[counts[which] > 1]
        if len(self.words) + len(which) > self.cached_words:
            self._reset()
            which = which[: self.cached_words]
        at = len(self.ids) + _starts(lens[which])
        self.ids = np.concatenate([self.ids, _gather(flat, starts[which], lens[which])])
        self.words = pa.concat_arrays([self.words, words.take(pa.array(which))])
        self.starts, self.lens = np.concatenate([self.starts, at]), np.concatenate([self.lens, lens[which]])


def _starts(lens: np.ndarray) -> np.ndarray:
    return np.cumsum(lens) - lens


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of flat[s : s + n] over starts and lens."""
    total = int(lens.sum())
    return flat[np.repeat(starts - _starts(lens), lens) + np.arange(total)]
