"""Token ids of whole Arrow text columns for a BPE whose pre-tokens never cross white space.

Distinct pieces are encoded once per Python worker; all else is array work.  A piece is a run of
bytes without white space, split further where an ASCII or Latin-1 letter meets ASCII punctuation.
Such a place is always a border between pre-tokens (the apostrophe, which contractions hold, and the
characters of special tokens aside), and ASCII letters may be lower-cased first because the
tokenizer's own normaliser does so; hence ids equal those of encoding each text as a whole.
"""

from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np
import pyarrow as pa

from ledgerloom.llm.words import _SPACE, as_binary, buffers

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: distinct pieces that a worker remembers at most, and bytes of them; beyond either, it starts afresh
MEMO_PIECES, MEMO_BYTES = 400_000, 16 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_pieces(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All pieces of all texts, ASCII lower-cased, and the n + 1 piece offsets of the texts."""
    data, offsets = buffers(as_binary(column))
    if b"<|" not in data.tobytes():
        data = _LOWER[data]
    letter, punct = _LETTER[data], _PUNCT[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    keep = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = (keep[1:] & ~keep[:-1]) | (letter[1:] & punct[:-1]) | (punct[1:] & letter[:-1])
    begins[offsets] = True
    begins[:-1] &= keep
    starts = np.flatnonzero(begins[:-1])
    # a piece ends where the next begins or white space follows; compacted, it ends where the next begins
    at = np.append(np.cumsum(keep)[starts] - 1, int(keep.sum())).astype(np.int64) if len(starts) else np.zeros(1, np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[keep])])
    return pieces, np.searchsorted(starts, offsets)


class PieceTokenizer:
    """``ids`` and ``counts`` of Arrow columns, as by ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, int] = {}
        self._fresh()

    def _fresh(self) -> None:
        self.memo.clear()
        self.memo_bytes = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.n = np.zeros(1 << 14, np.int64), 0  # one longer than the pieces known

    def _add(self, pieces: list[bytes]) -> None:
        """Learns the ids of pieces that the memo lacks."""
        plain, odd = [], []
        for p in pieces:
            s = p.decode()
            (plain if s.isalpha() and (s.isascii() or unicodedata.is_normalized("NFC", s)) else odd).append((p, s))
        lens, parts = [], []
        for at in range(0, len(plain), 2000):
            group = plain[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(s for _, s in group)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):  # one pre-token each
                lens.append(np.diff(stops, prepend=0))
                parts.append(ids)
            else:
                each = [e.ids for e in self.tokenizer.encode_batch_fast([s for _, s in group], add_special_tokens=False)]
                lens.append(np.array([len(e) for e in each]))
                parts.append(np.array([i for e in each for i in e], np.uint32))
        if odd:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([s for _, s in odd], add_special_tokens=False)]
            lens.append(np.array([len(e) for e in each]))
            parts.append(np.array([i for e in each for i in e], np.uint32))
        new = np.concatenate(parts)
        ends = np.cumsum(np.concatenate(lens)) + self.used
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + len(new)] = new
        self.starts[self.n + 1 : self.n + 1 + len(pieces)] = ends
        for k, (p, _) in enumerate([*plain, *odd], self.n):
            self.memo[p] = k
            self.memo_bytes += len(p)
        self.used += len(new)
        self.n += len(pieces)

    def _known(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece its place in ``flat`` and its number of ids; the piece offsets of the texts."""
        if len(self.memo) > MEMO_PIECES or self.memo_bytes > MEMO_BYTES:
            self._fresh()
        pieces, at = split_pieces(column)
        if len(pieces) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), at
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := [p for p in distinct if p not in self.memo]:
            self._add(new)
        memo = self.memo
        known = np.array([memo[p] for p in distinct])
        return self.starts[known][index := coded.indices.to_numpy()], np.diff(self.starts[: self.n + 1])[known][index], at

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and the n + 1 id offsets of the texts."""
        starts, lens, at = self._known(column)
        ends = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=ends[1:])
        return self.flat[np.repeat(starts - ends[:-1], lens) + np.arange(ends[-1])], ends[at]

    def counts(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        _, lens, at = self._known(column)
        ends = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=ends[1:])
        return np.diff(ends[at])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    """One per Python worker and vocabulary."""
    return PieceTokenizer(path)
