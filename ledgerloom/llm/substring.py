"""Removal of passages that documents with smaller ids hold: relative Lempel-Ziv factors over words.

The reference of a document is all documents with smaller ids. Its index is spread over blocks by windows of 13
words; a block tells for each window the first place that holds it (document and word). Three passes over the text,
which moves once:

1. each chunk of documents names the minimizers of its windows (the least hash among a window's 6 runs of 8 words,
   so that equal windows name the same); those of one document only are dropped;
2. windows with other minimizers go to their blocks, where each finds the first place that holds it;
3. each document is factored greedily from left to right: where an indexed window begins, the factor copies the
   reference from the place that the block names and goes on while the next word continues that place; the next
   factor begins behind it, and words that begin no indexed window are literals. Factors have 13 words at least and
   are duplicate spans. At the end of each factor, the windows across the border are looked up as well, and those
   that are indexed are spans too; hence every indexed window is found, in a factor or at a border.

Chunks are sets of documents by hash of the id, about CHUNK_BYTES of text each. Each names a minimizer or window
once, so a passage in very many documents is at most as many rows as there are chunks (12 million at 100 TB, fewer
than an average task of such a job reads), and these are narrow and spilled where they are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut
from ledgerloom.llm.words import hash_words, slices, split_words, windows

CHUNK_BYTES = 8 << 20
GRAM = 8
_COPY, _SHARED, _FIRST = 0, 1, 2  # kinds of answers to a chunk


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class _Windows:
    """The windows of a slice of documents that lie within one document."""

    def __init__(self, texts: pa.Array, width: int):
        words, self.at = split_words(texts)
        first, second = hash_words(words)
        n = max(0, len(first) - width + 1)
        doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.start = np.flatnonzero(doc[:n] == doc[width - 1 :]) if n else np.zeros(0, np.int64)
        self.doc = doc[self.start]
        self.word = self.start - self.at[self.doc]
        gram = min(GRAM, width)
        self.minimizer = _sliding_min(windows(first, gram), width - gram + 1)[self.start] if n else np.zeros(0, np.uint64)
        self.hash = windows(second, width)[self.start]


def _split(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three values of a chunk's answers of one kind, by the first of them."""
    own = np.flatnonzero(answers.column("kind").to_numpy() == kind)
    a, b, c = (answers.column(x).to_numpy()[own] for x in ("a", "b", "c"))
    order = np.argsort(a, kind="stable")
    return a[order], b[order], c[order]


def _parts(docs: pa.Table, copies: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the documents that are no copies, by id, with their ids."""
    keep = ~np.isin(docs.column("row").to_numpy(), copies)
    for batch in docs.filter(pa.array(keep)).sort_by("doc_id").combine_chunks().to_batches():
        for part in slices(batch, "text"):
            yield part, part.column("doc_id").to_numpy()


class _Firsts:
    """Keys with the first place (id, word) and the last id of each, from parts in the order of ids."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, key: np.ndarray, ids: np.ndarray, at: np.ndarray, last: np.ndarray | None = None) -> None:
        order = np.argsort(key, kind="stable")
        key, last = key[order], (ids if last is None else last)[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        end = np.append(begin[1:], len(key))[: len(begin)] - 1
        self.parts.append((key[begin], ids[order][begin], at[order][begin], last[end]))

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, ids, at, last = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        self.parts = []
        self.add(key, ids, at, last)
        return self.parts[0]


def _name_minimizers(width: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        copies, _, _ = _split(answers, _COPY)
        firsts = _Firsts()
        for part, ids in _parts(docs, copies):
            w = _Windows(part.column("text"), width)
            firsts.add(w.minimizer, ids[w.doc], w.start)
        key, lo, _, hi = firsts.merged()
        chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
        return pa.table({"h": key.view(np.int64), "c": np.where(lo < hi, 2 * chunk + 1, 2 * chunk).astype(np.int64)})

    return run


def _send_windows(width: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        copies, _, _ = _split(answers, _COPY)
        shared = np.sort(_split(answers, _SHARED)[0].view(np.uint64))
        firsts = _Firsts()
        for part, ids in _parts(docs, copies):
            w = _Windows(part.column("text"), width)
            at = np.searchsorted(shared, w.minimizer)
            found = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == w.minimizer) if len(shared) else at[:0]
            firsts.add(w.hash[found], ids[w.doc[found]], w.word[found])
        x, d, at, _ = firsts.merged()
        chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
        return pa.table({"w": x.view(np.int64), "chunk": np.full(len(x), chunk, np.int64), "doc": d, "at": at})

    return run


def factors(start: np.ndarray, ref: np.ndarray, place: np.ndarray, width: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """The greedy factors (start, length, reference document, word there) of a document, and the windows across borders.

    ``start`` are the words, in order, at which indexed windows begin; ``ref`` and ``place`` the first place of each.
    """
    breaks = np.flatnonzero((np.diff(start) != 1) | (np.diff(ref) != 0) | (np.diff(place) != 1)) + 1
    ends = np.append(breaks, len(start)) - 1
    out, border, k = [], [], 0
    while k < len(start):
        last = int(ends[np.searchsorted(breaks, k, side="right")])  # the reference goes on up to this window
        stop = int(start[last]) + width
        out.append((int(start[k]), stop - int(start[k]), int(ref[k]), int(place[k])))
        after = int(np.searchsorted(start, stop))
        border.append(np.arange(last + 1, after))
        k = after
    return out, np.concatenate(border) if border else np.zeros(0, np.int64)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _factor(width: int, with_text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        copies, reps, _ = _split(answers, _COPY)
        known, known_doc, known_at = _split(answers, _FIRST)
        known = known.view(np.uint64)
        order = np.argsort(known, kind="stable")
        places = [(known[order], known_doc[order], known_at[order])]
        parts, firsts = [], _Firsts()
        for part, ids in _parts(docs, copies):  # windows that the chunk itself holds twice
            w = _Windows(part.column("text"), width)
            firsts.add(w.hash, ids[w.doc], w.word)
            parts.append((part, ids, w))
        key, lo, at, hi = firsts.merged()
        places.append((key[lo < hi], lo[lo < hi], at[lo < hi]))
        rows: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "factors", *(["kept"] if with_text else []))}

        def add(doc: int, words: list[bytes], gone: np.ndarray | None, found: list[tuple[int, int, int, int]]) -> None:
            left = words if gone is None else [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
            for c, v in zip(rows, (doc, len(words), len(words) - len(left), _digest(left), found), strict=False):
                rows[c].append(v)
            if with_text:
                rows["kept"].append(b" ".join(left).decode())

        for part, ids, w in parts:
            ref, place = np.full(len(w.hash), np.iinfo(np.int64).max), np.zeros(len(w.hash), np.int64)
            for k, d, p in places:
                if len(k) and len(ref):
                    at = np.minimum(np.searchsorted(k, w.hash), len(k) - 1)
                    better = (k[at] == w.hash) & (d[at] < ref)
                    ref[better], place[better] = d[at[better]], p[at[better]]
            out = ref < ids[w.doc]
            start, ref, place, doc = w.word[out], ref[out], place[out], w.doc[out]
            bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
            for d, text in enumerate(part.column("text").to_pylist()):
                words = text.encode().split()
                a, b = bounds[d], bounds[d + 1]
                if a == b:
                    add(int(ids[d]), words, None, [])
                    continue
                found, border = factors(start[a:b], ref[a:b], place[a:b], width)
                step = np.zeros(len(words) + 1, np.int64)
                for x, n, _, _ in found:
                    step[x] += 1
                    step[x + n] -= 1
                np.add.at(step, start[a:b][border], 1)
                np.add.at(step, start[a:b][border] + width, -1)
                add(int(ids[d]), words, np.cumsum(step)[:-1] > 0, found)
        mine = np.isin(docs.column("row").to_numpy(), copies)
        for row, doc, text in zip(docs.column("row").to_numpy()[mine], docs.column("doc_id").to_numpy()[mine].tolist(), docs.column("text").filter(pa.array(mine)).to_pylist(), strict=True):
            words = text.encode().split()
            rep = int(reps[np.searchsorted(copies, row)])
            whole = len(words) >= width
            add(doc, words, np.ones(len(words), bool) if whole else None, [(0, len(words), rep, 0)] if whole else [])
        return pa.table([pa.array(rows[f.name], f.type) for f in _arrow(with_text)], schema=_arrow(with_text))

    return run


def _arrow(with_text: bool) -> pa.Schema:
    factor = pa.struct([(c, pa.int64()) for c in ("start", "length", "ref_doc_id", "ref_start")])
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", pa.list_(factor))]
    return pa.schema([*fields, *([("kept", pa.string())] if with_text else [])])


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, factors, and kept if asked for), a row for each document.

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller id.
    Factors are (start, length, ref_doc_id, ref_start), in words; they don't overlap, and each is the passage of the
    reference that begins there. Documents whose text equals that of a smaller id are told by a digest and take no
    part in the passes: they are one factor.

    Null and empty texts have no words. Rows with a null id are no one's reference and lose nothing. Rows
    that repeat an id are compared with smaller ids only, not with each other, each by its own text. Ids must be
    integers. Other columns are ignored; no rows give no rows.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    chunks = max(1, -(-size // CHUNK_BYTES))
    named = base.where("doc_id IS NOT NULL").select("*", F.xxhash64("doc_id", "text").alias("row"), F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"))
    # tables of their own: the text is digested once, and a digest that very many rows share can be split in the join
    digests = cut(named.select("doc_id", "row", "chunk", F.unhex(F.sha2("text", 256)).alias("digest")))
    reps = cut(digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    none = F.lit(0).cast("long")
    answer = lambda kind, a, b, c: (F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), c.alias("c"))
    copies = digests.join(reps, "digest").where("doc_id > rep").select("chunk", *answer(_COPY, "row", "rep", none))

    # 1. minimizers of one document only go
    held = _cogroup(named, copies, _name_minimizers(width), "h long, c long")
    group = Window.partitionBy("h")
    held = held.select("h", "c", F.count("*").over(group).alias("n"), F.max(F.col("c").bitwiseAND(F.lit(1).cast("long"))).over(group).alias("m"))
    shared = held.where("n > 1 OR m = 1").select(F.shiftright("c", 1).alias("chunk"), *answer(_SHARED, "h", "h", none))

    # 2. the first place of each window
    sent = _cogroup(named, copies.unionByName(shared), _send_windows(width), "w long, chunk long, doc long, at long")
    sent = sent.withColumn("first", F.min(F.struct("doc", "at")).over(Window.partitionBy("w")))
    firsts = sent.where("first.doc < doc").select("chunk", *answer(_FIRST, "w", "first.doc", F.col("first.at")))

    # 3. factors
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:long,length:long,ref_doc_id:long,ref_start:long>>" + ", kept string" * with_text
    out = _cogroup(named, copies.unionByName(firsts), _factor(width, with_text), schema)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.encode().split() for x in batch.column(0).to_pylist()]
            cols = [[None] * len(words), [len(x) for x in words], [0] * len(words), [_digest(x) for x in words], [[] for _ in words], [b" ".join(x).decode() for x in words]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _arrow(with_text), strict=False)], schema=_arrow(with_text))

    return out.unionByName(base.where("doc_id IS NULL").select("text").mapInArrow(alone, schema))


def _cogroup(docs: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of each chunk's documents and answers. Every call has the same left side, so that one query
    with several of them shuffles the text once."""
    answers = answers.select(F.col("chunk").alias("of"), "kind", "a", "b", "c")
    return docs.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(f, schema)
