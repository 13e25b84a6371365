"""SentencePiece encoding (merge type, byte fallback) by a table of prefixes, and decoding.

Of a text's every prefix one token can be the last. The table holds it: an automaton names the pieces
that end at a place, from the longest on, and the one that goes with the last token of the prefix
before it is stored. Read backwards from the end, the table gives the ids. Two tokens go together if
no merge across their border comes up while the symbols along it grow; pairs are judged once.

A chunk is text between places that no piece crosses, so that encoding chunks is encoding the text.
Each worker encodes distinct chunks once; all else is array work. Memory is bounded by the slice of
text in hand and by the memo's limits, whatever the documents.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, text_batches
from ledgerloom.llm.words import as_binary, buffers, slices

SPACE = "▁"
#: last "tokens" of a prefix that are no pieces: none yet, the text's beginning, a character without a piece
_NONE, _START, _OTHER = -1, -2, -3
#: distinct chunks, bytes of them, and judged pairs that a worker remembers at most; beyond, it starts afresh
MEMO_CHUNKS, MEMO_BYTES, MEMO_PAIRS = 400_000, 16 << 20, 1 << 20
#: a piece lives for ever along a border unless it is merged into a larger one
_NEVER = 1 << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTable:
    """Ids of single chunks. ``merges`` holds each piece's rank, equal for equal scores."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.processor = sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in plain) or sp.normalize(f"AＡ \t{SPACE} é ") != f"{SPACE}AＡ{SPACE}\t{SPACE}{SPACE}é{SPACE}":
            raise ValueError("models with unused pieces, a normaliser, or no leading space are not supported")
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.pieces = {i: sp.id_to_piece(i) for i in plain}
        self.merges = {sp.id_to_piece(i): order[sp.get_score(i)] for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.halves = {p: h for p in self.merges if (h := self._halves(p)) is not None}
        self.born = {}
        for p in sorted(self.halves, key=len):
            left, right = self.halves[p]
            self.born[p] = max(self.merges[p], self.born[left], self.born[right]) if left else -1
        self.automaton = ahocorasick.Automaton()
        for i, p in self.pieces.items():
            if p in self.halves:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.characters = {p for p in self.halves if len(p) == 1}
        self.longest = max(map(len, self.merges))
        self.edges: dict[tuple[int, int], list[tuple[str, int, int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        #: which bytes may follow each other inside a piece
        self.inside = np.zeros((256, 256), dtype=bool)
        self.inside[:, 0x80:0xC0] = True
        for p in self.merges:
            b = p.replace(SPACE, " ").encode()
            self.inside[list(b[:-1]), list(b[1:])] = True

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that are merged last into a piece on its own; empty for a character, None if it never comes up."""
        symbols, halves = list(piece), ("", "")
        while len(symbols) > 1:
            ranked = [(r, k) for k in range(len(symbols) - 1) if (r := self.merges.get(symbols[k] + symbols[k + 1])) is not None]
            if not ranked:
                return None
            k = min(ranked)[1]
            halves = symbols[k], symbols[k + 1]
            symbols[k : k + 2] = ["".join(halves)]
        return halves

    def _edge(self, token: int, side: int) -> list[tuple[str, int, int, int]]:
        """The symbols that a token has at its left (0) or right (1) end while it grows: each with the time it is born,
        the rank of the merge that takes it, and the time of that merge."""
        if (found := self.edges.get((token, side))) is None:
            found, piece, rank, gone = [], self.pieces[token], _NEVER, _NEVER
            while piece:
                found.append((piece, self.born[piece], rank, gone))
                rank, gone, piece = self.merges[piece], self.born[piece], self.halves[piece][side]
            self.edges[token, side] = found
        return found

    def together(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their characters are encoded as one text. Of merges of one rank the
        leftmost comes first: those of the left token, then one across, then those of the right token."""
        if (known := self.pairs.get((left, right))) is not None:
            return known
        good = True
        for x, born_x, rank_x, gone_x in self._edge(left, 1):
            for y, born_y, rank_y, gone_y in self._edge(right, 0):
                if len(x) + len(y) > self.longest or (r := self.merges.get(x + y)) is None:
                    continue
                if r < rank_x and r <= rank_y and born_x <= gone_y and born_y < gone_x:
                    good = False
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def last_tokens(self, text: str) -> list[int]:
        """The last token of every prefix; ``_OTHER`` where it ends in a character without a piece."""
        last = [_START, *(_NONE if c in self.characters else _OTHER for c in text)]
        for end, (token, length) in self.automaton.iter(text):
            if last[end + 1] == _NONE:
                before = last[end + 1 - length]
                if before <= _START or (before >= 0 and self.together(before, token)):
                    last[end + 1] = token
        return last

    def encode(self, text: str) -> list[int]:
        """Ids of a text whose spaces are written as pieces have them."""
        last, at, ids = self.last_tokens(text), len(text), []
        while at:
            token = last[at]
            if token == _OTHER:
                at -= 1
                ids += [self.bytes[b] for b in reversed(text[at].encode())]
            else:
                at -= len(self.pieces[token])
                ids.append(token)
        ids.reverse()
        return ids


class PieceEncoder:
    """``ids`` of Arrow columns, as by ``SentencePieceProcessor.encode(text)``."""

    def __init__(self, path: str):
        self.table = PieceTable(path)
        size = self.table.processor.get_piece_size()
        self.decimal = pa.array([str(i) for i in range(size)])
        self._fresh()

    def _fresh(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.memo_bytes, self.flat, self.starts = 0, array("i"), array("q", [0])

    def chunks(self, column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """All chunks of all texts, with the leading space that each text but the empty one gets, and the n + 1 chunk
        offsets of the texts."""
        text = pc.replace_substring(as_binary(column).cast(pa.large_string()), SPACE, " ")
        lead = pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, offsets = buffers(pc.binary_join_element_wise(lead, text, pa.scalar("", pa.large_string())).cast(pa.large_binary()))
        begins = np.ones(len(data), dtype=bool)
        begins[1:] = ~self.table.inside[data[:-1], data[1:]]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins).astype(np.int64)
        ends = np.append(starts, len(data)).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.searchsorted(starts, offsets)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and the n + 1 id offsets of the texts."""
        if len(self.memo) > MEMO_CHUNKS or self.memo_bytes > MEMO_BYTES:
            self._fresh()
        chunks, at = self.chunks(column)
        if len(chunks) == 0:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        coded = chunks.dictionary_encode()
        known = np.empty(len(coded.dictionary), np.int64)
        memo = self.memo
        for k, chunk in enumerate(coded.dictionary.to_pylist()):
            if (number := memo.get(chunk)) is None:
                number = memo[chunk] = len(self.starts) - 1
                self.flat.extend(self.table.encode(chunk.decode().replace(" ", SPACE)))
                self.starts.append(len(self.flat))
                self.memo_bytes += len(chunk)
            known[k] = number
        flat, starts = np.array(self.flat, np.int32), np.array(self.starts, np.int64)
        number = known[coded.indices.to_numpy()]
        first, lens = starts[number], starts[number + 1] - starts[number]
        ends = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=ends[1:])
        return flat[np.repeat(first - ends[:-1], lens) + np.arange(ends[-1])], ends[at]

    def decimals(self, flat: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by one space."""
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.decimal.take(pa.array(flat)))
        return pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One per Python worker and model."""
    return PieceEncoder(path)


def encode_documents(docs: DataFrame, *, text: str = "text", end_id: int | None = 2, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Every row with ``ids`` (array of int, with ``with_ids``), ``n_tokens``, ``ids_sha256`` (of the decimal ids joined
    by one space), ``decoded`` (with ``with_ids``) and ``decoded_sha256``; input columns of these names are replaced.
    Without ``with_ids`` the text is left out too, so that rows stay narrow.

    A null or empty text is the end id alone, which decodes to the empty text. Long texts are encoded whole. Repeated
    rows stay, each with its own result; an empty table gives an empty one. ``path`` is the model's on the workers, by
    default the public one there.
    """
    added = [("ids", "array<int>"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded", "string"), ("decoded_sha256", "string")]
    if not with_ids:
        added = [a for a in added if a[0] not in ("ids", "decoded")]
    names = {a[0] for a in added} | (set() if with_ids else {text.lower()})
    body = free_name(docs, "_body")
    kept = [c for c in docs.columns if c.lower() not in names]
    source = docs.select(*kept, F.col(text).alias(body))
    drop_body = [c for c in source.columns if c != body]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or default_path())
        for batch in batches:
            for part in slices(batch, body):
                flat, at = coder.ids(part.column(part.schema.get_field_index(body)))
                ends = np.arange(1, len(at)) if end_id is not None else np.zeros(len(at) - 1, np.int64)
                if end_id is not None:
                    flat, at = np.insert(flat, at[1:], end_id), at + np.append(0, ends)
                bounds = at.tolist()
                decoded = [coder.table.processor.decode(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                made = {
                    "ids": pa.LargeListArray.from_arrays(pa.array(at), pa.array(flat)).cast(pa.list_(pa.int32())) if with_ids else None,
                    "n_tokens": pa.array(np.diff(at)),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coder.decimals(flat, at)], pa.string()),
                    "decoded": pa.array(decoded, pa.string()) if with_ids else None,
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in drop_body), *(made[n] for n, _ in added)], names=[*drop_body, *(n for n, _ in added)])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != body), *(f"{n} {t}" for n, t in added)])
    return text_batches(source).mapInArrow(run, fields)
