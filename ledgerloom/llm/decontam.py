"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

A sieve that loses nothing comes first: a window similar to an item to the threshold has at least a known share of
its shingles in common with it, so windows with fewer shingles of any item are passed over. The others are
fingerprinted; the fingerprint's blocks name items in the multi-index, which alone proposes items; those within the
radius are compared exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import text_batches, written
from ledgerloom.llm.words import as_binary, buffers, hash_words, slices, split_words, windows

#: bytes of benchmark text that are held and sent to the tasks at once; a larger benchmark is searched in
#: parts, each against all documents
PART_BYTES = 16 << 20
BITS, BLOCKS = 128, 16
#: bits by which a window may differ from its item. At a similarity of 0.8 about 20 of 128 bits differ
#: (standard deviation 4), between unrelated texts 64 (6); 47 is the largest radius at which one of 16 blocks
#: must be within 2 bits
RADIUS = 47
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[0x41:0x5B] += 32
_NORMAL[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_POPCOUNT = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def normal_words(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Words of texts with ASCII letters lower-cased and other ASCII characters but digits as white space."""
    column = as_binary(column)
    data, offsets = buffers(column)
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_NORMAL[data])])
    return split_words(plain)


def fingerprint_bits(first: np.ndarray, second: np.ndarray, width: int) -> np.ndarray:
    """SimHash, as 16 bytes, of every window of ``width`` consecutive shingles, given by two hashes each.
    A shingle weighs as much as it occurs in the window."""
    hashes = np.stack([first, second], axis=1)
    sums = np.zeros((len(first) + 1, BITS), np.int32)
    np.cumsum(np.unpackbits(hashes.view(np.uint8), axis=1), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[width:] - sums[:-width]) > width, axis=1)


class MultiIndex:
    """Items by each of 16 blocks of 8 bits. A fingerprint within RADIUS of an item's agrees with it in some
    block to 2 bits; the items of all block values so near are kept as a bit mask, made when first asked for.
    At so wide a radius unrelated fingerprints often meet in a block too; the Hamming distance rules them out."""

    def __init__(self, fingerprints: np.ndarray):
        self.items: list[dict[int, int]] = [defaultdict(int) for _ in range(BLOCKS)]
        for k, f in enumerate(fingerprints.tolist()):
            for b, v in enumerate(f):
                self.items[b][v] |= 1 << k
        self.near: list[dict[int, int]] = [{} for _ in range(BLOCKS)]

    def candidates(self, fingerprint: list[int]) -> int:
        out = 0
        for b, v in enumerate(fingerprint):
            found = self.near[b].get(v)
            if found is None:
                found = 0
                for value, mask in self.items[b].items():
                    if _POPCOUNT[value ^ v] <= RADIUS // BLOCKS:
                        found |= mask
                self.near[b][v] = found
            out |= found
        return out


class Benchmark:
    """Items prepared for the search: shingles with their counts, fingerprints and the index."""

    def __init__(self, texts: list[str | None], shingle: int = 5):
        words, at = normal_words(pa.array(texts, pa.string()))
        first, second = hash_words(words)
        self.sizes = np.diff(at)
        #: items shorter than a shingle are one shingle of all their words
        self.widths = np.minimum(self.sizes, shingle)
        self.shingles: list[Counter] = []
        for k in range(len(texts)):
            own = windows(first[at[k] : at[k + 1]], int(self.widths[k])) if self.sizes[k] else []
            self.shingles.append(Counter(map(int, own)))
        self.totals = [sum(c.values()) for c in self.shingles]
        prints = np.zeros((len(texts), BLOCKS), np.uint8)
        for k in range(len(texts)):
            if self.sizes[k]:
                w = int(self.widths[k])
                a, b = (windows(h[at[k] : at[k + 1]], w) for h in (first, second))
                prints[k] = fingerprint_bits(a, b, len(a))[0]
        self.prints, self.index = prints, MultiIndex(prints)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: items of a width of shingles and a size in words, as a bit mask
        self.of_size: dict[tuple[int, int], int] = defaultdict(int)
        for k in range(len(texts)):
            if self.sizes[k]:
                self.of_size[int(self.widths[k]), int(self.sizes[k])] |= 1 << k
        for w in set(self.widths.tolist()) - {0}:
            known = np.array(sorted({s for k, c in enumerate(self.shingles) if self.widths[k] == w for s in c}), np.uint64)
            sieve = np.zeros(1 << 20, bool)
            sieve[known & np.uint64((1 << 20) - 1)] = True
            self.by_width[w] = known, sieve

    def search(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, int, float]]:
        """(text, item, first word, similarity) of each text's most similar window for each item, if similar enough.

        Windows are as long as the item in words; of a text shorter than the item, the whole text is the window. The
        similarity is that of shingles weighted by their occurrences, the sum of minima over the sum of maxima (ties:
        the first window).
        """
        words, at = normal_words(texts)
        first, second = hash_words(words)
        best: dict[tuple[int, int], tuple[int, float]] = {}
        for w, (known, sieve) in self.by_width.items():
            grams = windows(first, w)
            hits = np.flatnonzero(sieve[grams & np.uint64((1 << 20) - 1)])
            hits = hits[np.isin(grams[hits], known)]
            doc = np.searchsorted(at, hits, side="right") - 1
            inside = hits + w <= at[doc + 1]
            hits, doc = hits[inside], doc[inside]
            if len(hits) == 0:
                continue
            other = windows(second, w)
            short = [(d, int(at[d]), int(at[d + 1]) - int(at[d])) for d in np.unique(doc[at[doc + 1] - at[doc] < max(n for x, n in self.of_size if x == w)]).tolist()]
            for (width, size), items in self.of_size.items():
                if width != w:
                    continue
                span = size - w + 1
                need = int(np.ceil(2 * span * threshold / (1 + threshold) - 1e-9))
                for a, b in self._runs(hits, doc, at, size, span, need):
                    d = int(np.searchsorted(at, a, side="right")) - 1
                    for lo in range(a, b + 1, 4096):  # bounds memory where a text repeats an item for long
                        self._compare(grams, other, d, int(at[d]), lo, min(b, lo + 4095), span, items, threshold, best)
                for d, begin, n in short:
                    own = n - w + 1
                    if n < size and own >= threshold * span - 1e-9:
                        shared = np.searchsorted(hits, begin + own) - np.searchsorted(hits, begin)
                        if shared >= (own + span) * threshold / (1 + threshold) - 1e-9:
                            self._compare(grams, other, d, begin, begin, begin, own, items, threshold, best)
        return [(d, k, start, similarity) for (d, k), (start, similarity) in best.items()]

    @staticmethod
    def _runs(hits: np.ndarray, doc: np.ndarray, at: np.ndarray, size: int, span: int, need: int) -> list[tuple[int, int]]:
        """First and last start of each run of windows that hold at least ``need`` shingles of items. The first
        such shingle of a window is among its first ``span - need + 1``."""
        back = np.arange(max(0, span - need) + 1)
        starts = hits[:, None] - back
        fits = (starts >= at[doc][:, None]) & (starts + size <= at[doc + 1][:, None])
        starts = np.unique(starts[fits])
        starts = starts[np.searchsorted(hits, starts + span) - np.searchsorted(hits, starts) >= need]
        if not len(starts):
            return []
        breaks = np.flatnonzero(np.diff(starts) != 1)
        begins, ends = starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)]
        # a run may go on from one text into the next
        out = []
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            while a <= b:
                stop = min(b, int(at[np.searchsorted(at, a, side="right")]) - 1)
                out.append((a, stop))
                a = stop + 1
        return out

    def _compare(self, grams: np.ndarray, other: np.ndarray, d: int, begin: int, lo: int, hi: int, span: int, items: int, threshold: float, best: dict[tuple[int, int], tuple[int, float]]) -> None:
        """Looks the windows that start at ``lo`` to ``hi`` up in the index; those of the items named are compared."""
        own = grams[lo : hi + span].tolist()
        prints = fingerprint_bits(grams[lo : hi + span], other[lo : hi + span], span)
        for s, f in enumerate(prints.tolist()):
            named, counts = self.index.candidates(f) & items, None
            while named:
                k = (named & -named).bit_length() - 1
                named &= named - 1
                if _POPCOUNT[prints[s] ^ self.prints[k]].sum() > RADIUS:
                    continue
                counts = counts or Counter(own[s : s + span])
                shared = (counts & self.shingles[k]).total()
                similarity = shared / (self.totals[k] + span - shared)
                if similarity >= threshold and ((d, k) not in best or similarity > best[d, k][1]):
                    best[d, k] = lo + s - begin, similarity


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): a row for each document and item that a window of it resembles.

    The benchmark goes to every task, PART_BYTES at a time; documents are read in place, without shuffle, once a part.
    A document shorter than an item is compared as a whole. Null and empty texts match nothing, nor do items without words. Repeated documents and repeated
    items give rows of their own, null ids stay null, other columns are ignored. An empty table on
    either side gives no rows.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", item_kind), T.StructField("start_word", T.LongType()), T.StructField("similarity", T.DoubleType())])
    out = None
    for ids, texts, whole in _parts(benchmark, item_id_col, item_text_col):
        found = _search(source, schema, ids, texts, shingle, threshold)
        if not whole:  # so that neither the driver nor a task holds more than one part
            found = written(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out


def uncontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which ``contaminated`` names none; filtered where they are read."""
    schema = docs.schema
    for _, texts, whole in _parts(benchmark, item_id_col, item_text_col):
        prepared = Benchmark(texts, shingle)

        def run(batches: Iterator[pa.RecordBatch], prepared: Benchmark = prepared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in slices(batch, text_col):
                    keep = np.ones(x.num_rows, bool)
                    keep[[d for d, _, _, _ in prepared.search(x.column(text_col), threshold)]] = False
                    yield x.filter(pa.array(keep))

        docs = text_batches(docs).mapInArrow(run, schema)
        if not whole:
            docs = written(docs, "uncontaminated")
    return docs


def _parts(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> Iterator[tuple[list, list[str | None], bool]]:
    """The benchmark's ids and texts, about PART_BYTES of them at a time, and whether this is all of it."""
    items = benchmark.select(benchmark[item_id_col].alias("item_id"), benchmark[item_text_col].alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield [r[0] for r in rows], [r[1] for r in rows], parts == 1


def _search(source: DataFrame, schema: T.StructType, ids: list, texts: list[str | None], shingle: int, threshold: float) -> DataFrame:
    prepared = Benchmark(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch, "text"):
                found = prepared.search(x.column(1), threshold)
                d, k, start, similarity = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [x.column(0).take(pa.array(d, pa.int64())), pa.array([ids[i] for i in k]).cast(arrow_kind), pa.array(start, pa.int64()), pa.array(similarity, pa.float64())],
                    names=schema.names,
                )

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(schema["item_id"].dataType)
    return text_batches(source).mapInArrow(run, schema)
