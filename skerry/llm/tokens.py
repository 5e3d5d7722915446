"""Exact BPE encoding of whole texts by way of short chunks whose ids are kept.

A chunk ends only where every pre-tokenizer match must end, so that the ids of a text are those of its chunks,
end to end. Short chunks repeat far more than texts do: their ids are kept in a cache of bounded bytes, which starts
anew when it is full. Long chunks are encoded each time they come. Texts with blanks outside ASCII are encoded whole, and so are texts that hold the string of
an added token, if such a string stands for its token.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skerry.llm.arrow_text import BLANK, CLASS, LETTER, LOWER, PUNCT, WIDE, as_bytes, per_text, pieces, starts_of

CACHED_BYTES, LONGEST, ENTRY_BYTES = 48 << 20, 64, 16  # beside its text and ids an entry holds an offset and a number
SCHEMES = ("bytes", "words")


def _odd_blanks(data: np.ndarray) -> np.ndarray:
    """Positions of lead bytes of blanks outside ASCII."""
    at = np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3)))
    padded = np.append(data, np.zeros(2, np.uint8))
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    ogham = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    wide = (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[two | ogham | general | wide]


class Encoder:
    """Encodes texts with a tokenizer file; `scheme` says how its pre-tokenizer treats blanks.

    bytes: a blank run belongs to what follows it; words: blanks are dropped and case is folded. With `added`, the
    string of an added token in a text gives that token, as the library has it by default; else it is ordinary text.
    """

    def __init__(self, path: str, scheme: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core; more threads only hold memory
        from tokenizers import Tokenizer

        if scheme not in SCHEMES:
            raise ValueError(f"scheme must be one of {SCHEMES}")
        self.scheme = scheme
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        # A normalised token is matched in the folded text: whatever may fold to it counts.
        self.added = [(t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.held = pa.array([], pa.large_string()), 0
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids end to end."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        return lengths, np.fromiter(chain.from_iterable(each), self.dtype, int(lengths.sum()))

    def _learn(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the distinct chunks in the two arrays that follow: numbers of ids, and all ids. New short chunks are kept."""
        if self.held > CACHED_BYTES:
            self._forget()
        at = pc.index_in(distinct, value_set=self.chunks)
        if not at.null_count:
            return at.to_numpy(zero_copy_only=False), self.lengths, self.flat
        place = pc.cast(at, pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        missing = np.flatnonzero(place < 0)
        sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False)[missing]
        missing, short = missing[np.argsort(sizes > LONGEST, kind="stable")], int((sizes <= LONGEST).sum())
        new = distinct.take(pa.array(missing))
        lengths, flat = self._ids(new.to_pylist())
        place[missing] = len(self.chunks) + np.arange(len(new))
        every, ids, kept = np.append(self.lengths, lengths), np.append(self.flat, flat), int(lengths[:short].sum())
        # Long chunks stand last, so that what is kept is the first part of both arrays.
        self.lengths, self.flat = every[: len(self.chunks) + short], ids[: len(self.flat) + kept]
        self.chunks = pa.concat_arrays([self.chunks, new.slice(0, short)])
        self.held += int(sizes[sizes <= LONGEST].sum()) + short * ENTRY_BYTES + kept * self.dtype.itemsize
        return place, every, ids

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        c = CLASS[data]
        mark = np.zeros(len(data), bool)
        before, after = c[:-1], c[1:]
        word_end = (before == LETTER) & (after == PUNCT)
        if self.scheme == "bytes":
            mark[1:] = ((after == BLANK) & (before != BLANK)) | word_end
        else:
            mark[1:] = ((after == BLANK) != (before == BLANK)) | word_end
        return starts_of(mark, offsets)

    def _with_added(self, texts: pa.Array) -> np.ndarray:
        """Places of the texts that hold the string of an added token."""
        held = np.zeros(len(texts), bool)
        for content, folded in self.added:
            held |= pc.fill_null(pc.match_substring(texts, content, ignore_case=folded), False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(held)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        data, offsets = as_bytes(texts)
        n = len(offsets) - 1
        if not len(data):
            return [np.zeros(0, self.dtype)] * n
        starts = self._starts(data, offsets)
        if self.scheme == "words":
            wide = np.logical_or.reduceat(CLASS[data] == WIDE, starts)
            folded = LOWER[data]
            held = np.repeat(wide, np.diff(np.append(starts, len(data))))
            folded[held] = data[held]  # a mark may join the letter before it: the tokenizer folds these itself
            data = folded
        chunks = pieces(data, starts).dictionary_encode()
        places, lengths, flat = self._learn(chunks.dictionary)
        which = places[chunks.indices.to_numpy()]
        first = np.cumsum(lengths) - lengths
        counts = lengths[which]
        ends = np.cumsum(counts)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - (ends - counts), counts)]
        cuts = np.append(0, ends)[per_text(starts, offsets)]
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        odd = np.union1d(np.searchsorted(offsets, _odd_blanks(data), side="right") - 1, self._with_added(texts))
        if len(odd):
            lengths, flat = self._ids([texts[int(i)].as_py() for i in odd])
            for i, ids in zip(odd, np.split(flat, np.cumsum(lengths)[:-1])):
                out[i] = ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, scheme: str, added: bool = False) -> Encoder:
    """One per Python worker, so that the cache outlives a batch and a task."""
    return Encoder(path, scheme, added)
