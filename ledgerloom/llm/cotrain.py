"""Quality by co-training: a text view and a metadata view teach each other, then score all documents.

The labelled sample is bounded (``max_labelled`` documents, those with the least hashes of their ids); all else
is done where the documents are. Word features are chosen by counts that Spark sums. Every document's features
(places of chosen words, style figures, places of metadata) are written once as a narrow table; each round reads
it, and every task hands on its most confident unlabelled documents, of which the best of all teach the other view.
The driver holds the features of the sample and of the documents that were chosen, no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import text_batches, written
from ledgerloom.llm.words import as_binary, buffers, mix, slices, split_words

#: labelled documents that training sees at most, by default
MAX_LABELLED = 10_000
#: rounds of co-training, and pseudo-labels of each class that a view passes on per round at most
ROUNDS, PER_ROUND = 3, 250
#: calibrated probability from which a pseudo-label counts as confident
CONFIDENT = 0.95
#: word features: whole words and beginnings of 4 and 5 bytes; those are kept whose share among rejected
#: documents differs from that among others by so many standard errors, and which so many documents have
BEGINNINGS, MIN_Z, MIN_DOCS, MAX_WORDS = (4, 5), 4.0, 4, 400
#: ridge of the text view, of the metadata view (whose features are many and weak) and of a calibration
RIDGE, META_RIDGE, SLOPE_RIDGE = 1.0, 20.0, 1.0
#: bytes of text that a task describes at once, and places that a column of metadata has
PART_BYTES, PLACES = 1 << 19, 128
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STRIPPED = np.zeros(256, bool)
_STRIPPED[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
# Characters that the style figures count.
_COUNTED = [("upper", range(0x41, 0x5B)), ("letter", [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]), ("digit", range(0x30, 0x3A)), ("bang", b"!?"), ("pipe", b"|"), ("symbol", b"#*$%&<>^~@"), ("stop", b".,;:"), ("line", b"\n")]
_CLASS = np.zeros((len(_COUNTED), 256), bool)
for _row, (_, _bytes) in enumerate(_COUNTED):
    _CLASS[_row, list(_bytes)] = True
STYLES = 11


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2 ** 64, and of its inverse."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, PART_BYTES)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        if size > 8 * PART_BYTES:
            return out[0], out[1]
        _POWERS = (out[0], out[1])
    return _POWERS[0][:n], _POWERS[1][:n]


def word_codes(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Three 32-bit codes of each word without the punctuation at its ends (all of it, and its beginnings of BEGINNINGS
    bytes, or all of it again where it is shorter), and a 64-bit hash of the word as it is. A hash is the difference of
    two sums over the text, so that no statement runs once a word."""
    data, at = buffers(words)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    whole = lambda s, e: mix((sums[e] - sums[s]) * inverse[s])
    begin, end = at[:-1].copy(), at[1:].copy()
    raw = whole(begin, end)
    for side, step in ((end, -1), (begin, 1)):
        some = np.arange(len(begin))
        while len(some := some[begin[some] < end[some]]):
            some = some[_STRIPPED[data[side[some] - (step < 0)]]]
            side[some] += step
    none = begin == end
    begin[none], end[none] = at[:-1][none], at[1:][none]
    codes = np.empty((len(begin), 1 + len(BEGINNINGS)), np.uint32)
    codes[:, 0] = whole(begin, end) >> np.uint64(32)
    for column, k in enumerate(BEGINNINGS, 1):
        codes[:, column] = codes[:, 0]
        long = np.flatnonzero(end - begin >= k)
        value = np.full(len(long), k, np.uint64)
        for j in range(k):
            value = (value << np.uint64(8)) | data[begin[long] + j].astype(np.uint64)
        codes[long, column] = mix(value) >> np.uint64(32)
    return codes, raw


def _words_and_style(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of whole texts, lower-cased, its document and its codes; and a row of style figures for each document."""
    column = as_binary(texts)
    data, offsets = buffers(column)
    n = len(column)
    lowered = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_LOWER[data])])
    words, at = split_words(lowered)
    counts = np.diff(at)
    style = np.zeros((n, STYLES))
    if len(data):
        sums = np.zeros(len(data) + 1, np.int64)
        for k in range(len(_COUNTED)):
            np.cumsum(_CLASS[k][data], out=sums[1:])
            style[:, k] = np.diff(sums[offsets])
        del sums
    letters = np.maximum(style[:, 1], 1)
    style[:, 0] /= letters
    chars = np.diff(offsets)
    per = np.maximum(counts, 1)
    style[:, 1] /= np.maximum(chars, 1)
    style[:, 2:8] /= per[:, None]
    style[:, 9] = np.log1p(counts)
    style[:, 10] = chars / per
    doc = np.repeat(np.arange(n), counts)
    codes, raw = word_codes(words)
    again = np.zeros(len(doc) + 1, np.int64)
    np.cumsum(np.append(False, (raw[1:] == raw[:-1]) & (doc[1:] == doc[:-1]))[: len(doc)], out=again[1:])
    style[:, 8] = np.diff(again[at]) / per
    return doc, codes, style


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, 32-bit word feature) pairs of whole texts, in order, and a row of style figures for each."""
    doc, codes, style = _words_and_style(texts)
    pairs = np.unique(((doc.astype(np.uint64)[:, None] << np.uint64(32)) | codes.astype(np.uint64)).ravel())
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), style


def chosen_features(texts: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``text_features``, but only the features whose codes are in ``chosen`` (sorted), given by their places there."""
    doc, codes, style = _words_and_style(texts)
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), style
    sieve = np.zeros(1 << 20, bool)  # most words are not chosen
    sieve[chosen & 0xFFFFF] = True
    row, column = np.nonzero(sieve[codes & np.uint32(0xFFFFF)])
    code = codes[row, column].astype(np.int64)
    place = np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)
    hit = chosen[place] == code
    pairs = np.unique(doc[row[hit]] * len(chosen) + place[hit])
    return pairs // len(chosen), pairs % len(chosen), style


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25, begin: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last, by Newton's method; sums over parts of the rows."""
    m = x.shape[1] + 1
    w, penalty = np.zeros(m) if begin is None else begin.copy(), np.full(m, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        gradient, hessian = penalty * w, np.diag(penalty)
        for at in range(0, len(x), 2048):
            part = np.hstack([x[at : at + 2048], np.ones((len(x[at : at + 2048]), 1))])
            p = _sigmoid(part @ w)
            gradient += part.T @ (p - y[at : at + 2048])
            hessian += (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def meta_places(columns: list) -> np.ndarray:
    """For each row and column of metadata the place of its value: strings by hash, numbers by their power of two."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.int64)
    for c, column in enumerate(columns):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        coded = column.dictionary_encode()
        places = np.array([_place(v, c) for v in coded.dictionary.to_pylist()] + [0], np.int64)
        out[:, c] = PLACES * c + places[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]
    return out


def _place(v: object, column: int) -> int:
    if v is None:
        return 0
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return 1 + min(126, int(abs(v)).bit_length()) if v == v and abs(v) != float("inf") else PLACES - 1
    return 1 + xxhash.xxh32_intdigest(str(v), column) % (PLACES - 1)


@dataclass
class Features:
    """Of each document: distinct (document, place of a chosen word) pairs in order, style figures, places of metadata."""

    doc: np.ndarray
    word: np.ndarray
    style: np.ndarray
    meta: np.ndarray

    @staticmethod
    def of(texts: pa.Array, metas: list, words: np.ndarray) -> Features:
        """``words`` are the sorted codes of the chosen words."""
        doc, word, style = chosen_features(texts, words)
        return Features(doc, word, style.astype(np.float32), meta_places(metas) if metas else np.zeros((len(style), 0), np.int64))

    def arrays(self) -> list[pa.Array]:
        """The columns ``words``, ``style`` and ``meta``."""
        n = len(self.style)
        rows = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
        at = np.searchsorted(self.doc, np.arange(n + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(self.word, pa.int32())), rows(self.style, pa.float32()), rows(self.meta, pa.int32())]

    @staticmethod
    def read(rows: pa.RecordBatch | pa.Table) -> Features:
        words, style, meta = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column(n) for n in ("words", "style", "meta")))
        n = rows.num_rows
        doc = np.repeat(np.arange(n), words.value_lengths().to_numpy(zero_copy_only=False)) if n else np.zeros(0, np.int64)
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (words, style, meta)]
        return Features(doc, flat[0].astype(np.int64), flat[1].reshape(n, STYLES) if n else np.zeros((0, STYLES), np.float32), flat[2].astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64))

    def scaled(self, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        z = (np.clip(self.style, None, 30) - mean) / scale
        return np.hstack([np.clip(z, -5, 5), np.clip(z, -1, 1) ** 2])


@dataclass
class Model:
    """Both views, each with weights and a calibration (slope, intercept), and the share of rejected documents.
    Without ``words`` (no two classes to learn from) it has the share alone."""

    prior: float = 0.0
    words: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    calibration: dict[str, tuple[float, float]] = field(default_factory=dict)

    def matrix(self, name: str, f: Features) -> np.ndarray:
        """The view's features as rows, for training on few documents."""
        if name == "meta":
            x = np.zeros((len(f.meta), PLACES * f.meta.shape[1]), np.float32)
            x[np.arange(len(f.meta))[:, None], f.meta] = 1
            return x
        x = np.zeros((len(f.style), len(self.words) + 2 * STYLES), np.float32)
        x[f.doc, f.word] = 1
        x[:, len(self.words) :] = f.scaled(self.mean, self.scale)
        return x

    def raw(self, name: str, f: Features) -> np.ndarray:
        """The view's uncalibrated log-odds, from the few features that a document has."""
        if name == "meta":
            return self.meta[f.meta].sum(axis=1) + self.meta[-1]
        k = len(self.words)
        return np.bincount(f.doc, weights=self.text[f.word], minlength=len(f.style)) + f.scaled(self.mean, self.scale) @ self.text[k:-1] + self.text[-1]

    def probability(self, name: str, f: Features) -> np.ndarray:
        if name == "meta" and not f.meta.shape[1]:
            return np.full(len(f.style), self.prior)
        a, b = self.calibration[name]
        return _sigmoid(a * self.raw(name, f) + b)

    def scores(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of rejection by text, by metadata and by both."""
        text, meta = self.probability("text", f), self.probability("meta", f)
        return text, meta, self.combine(text, meta)

    def combine(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The views' log-odds added, the prior's counted once: they are taken as independent given the class."""
        logit = lambda p: np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
        return _sigmoid(logit(text) + logit(meta) - logit(np.float64(self.prior)))


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scaling, with his smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = fit_logistic(score[:, None], target, ridge=SLOPE_RIDGE)
    return float(w[0]), float(w[1])


def _fit_view(model: Model, name: str, own: tuple[Features, np.ndarray], held: tuple[Features, np.ndarray], taught: list[tuple[Features, np.ndarray]]) -> None:
    """Weights from the labelled rows and the other view's pseudo-labels, calibration from the labelled rows held back."""
    parts = [own, *taught]
    x, y = np.vstack([model.matrix(name, f) for f, _ in parts]), np.concatenate([y for _, y in parts]).astype(float)
    setattr(model, name, fit_logistic(x, y, RIDGE if name == "text" else META_RIDGE, begin=getattr(model, name)))
    model.calibration[name] = calibrate(model.raw(name, held[0]), held[1])


SCORES = ("text_score", "meta_score", "score")


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"),
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    threshold: float = 0.5,
    max_labelled: int = MAX_LABELLED,
    rounds: int = ROUNDS,
    per_round: int = PER_ROUND,
) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept), a row for each document; scores are probabilities that
    a document should be rejected: quality 0 or toxic 1.

    Null texts count as empty, null metadata as a value of its own. A null label counts as none; of several
    labels of a document the worst counts. Labels without a document and null ids train nothing, but such
    documents are scored like any other; of several documents with a labelled id, one trains. If the labels do
    not have both classes, every score is their share of rejected documents, 0 with no labels at all, and every
    document is kept. Repeated rows are scored each, other columns are ignored, no rows give no rows.
    """
    model, features = fit(docs, labels, id_col=id_col, text_col=text_col, meta_cols=meta_cols, quality_col=quality_col, toxic_col=toxic_col, max_labelled=max_labelled, rounds=rounds, per_round=per_round)
    if model.words is None:
        return docs.select(docs[id_col].alias("doc_id"), *(F.lit(model.prior).alias(c) for c in SCORES), F.lit(True).alias("kept"))
    schema = T.StructType([features.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in SCORES), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, both = model.scores(Features.read(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (text, meta, both, both < threshold))], names=schema.names)

    return features.select("doc_id", "words", "style", "meta").mapInArrow(run, schema)


def keep_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"),
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    threshold: float = 0.5,
    max_labelled: int = MAX_LABELLED,
    rounds: int = ROUNDS,
    per_round: int = PER_ROUND,
) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that ``score_documents`` keeps; filtered where they are read.
    Nulls, empty texts, repeated rows and missing classes are treated as there."""
    model, _ = fit(docs, labels, id_col=id_col, text_col=text_col, meta_cols=meta_cols, quality_col=quality_col, toxic_col=toxic_col, max_labelled=max_labelled, rounds=rounds, per_round=per_round)
    if model.words is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, PART_BYTES):
                _, _, both = model.scores(Features.of(part.column(text_col), [part.column(c) for c in meta_cols], model.words))
                yield part.filter(pa.array(both < threshold))

    return text_batches(docs).mapInArrow(run, docs.schema)


def _columns(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...]) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *(docs[c].alias(f"meta{k}") for k, c in enumerate(meta_cols)))


def describe(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """``rows`` (text, meta0, meta1 ... and others) with words, style and meta in place of text and metadata."""
    metas = [c for c in rows.columns if c.startswith("meta")]
    others = [c for c in rows.columns if c != "text" and c not in metas]
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("style", T.ArrayType(T.FloatType())), T.StructField("meta", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                f = Features.of(part.column("text"), [part.column(c) for c in metas], words)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *f.arrays()], names=schema.names)

    return text_batches(rows).mapInArrow(run, schema)


def choose_words(sample: DataFrame, n: dict[str, int], rows: int) -> np.ndarray:
    """Sorted codes of the words of ``sample`` (text and a 0/1 column for each target) whose share differs most
    between the two classes of a target. ``n`` has the ones of each target among all ``rows``. Counts form in Spark;
    the driver gets MAX_WORDS rows a target."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                doc, code, _ = text_features(part.column("text"))
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(code), *(part.column(c).take(take) for c in n)], names=["code", *n])

    found = text_batches(sample.select("text", *n)).mapInArrow(codes, ", ".join(["code long", *(f"{c} int" for c in n)]))
    counts = written(found.groupBy("code").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in n)).where(F.col("n") >= MIN_DOCS), "words")
    chosen: set[int] = set()
    for c, ones in n.items():
        if 0 < ones < rows:
            a, b, pooled = F.col(c) / ones, (F.col("n") - F.col(c)) / (rows - ones), F.col("n") / rows
            z = F.abs(a - b) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / ones + 1 / (rows - ones)))
            chosen |= {r.code for r in counts.select("code", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "code").limit(MAX_WORDS).collect()}
    return np.array(sorted(chosen), np.int64)


def most_confident(features: DataFrame, model: Model, given: np.ndarray, per_round: int) -> dict[tuple[str, float], pa.Table]:
    """For each view and label, the ``per_round`` documents of ``features`` (key, words, style, meta) of which it is
    surest, those in ``given`` left out: each task hands on its own best, of which the best of all are taken."""
    kinds = [(view, label) for view in ("text", "meta") for label in (1.0, 0.0)]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("sure", T.DoubleType()), *(features.schema[c] for c in ("key", "words", "style", "meta"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column("key").to_numpy(), given)))
            if not batch.num_rows:
                continue
            f = Features.read(batch)
            for k, (view, label) in enumerate(kinds):
                p = model.probability(view, f)
                sure = p if label else 1 - p
                at = np.flatnonzero(sure >= CONFIDENT)
                own = pa.table([pa.array(np.full(len(at), k, np.int32)), pa.array(sure[at]), *(batch.column(c).take(pa.array(at)) for c in ("key", "words", "style", "meta"))], names=schema.names)
                own = pa.concat_tables([best[k], own]) if k in best else own
                order = np.lexsort((own.column("key").to_numpy(), -own.column("sure").to_numpy()))
                best[k] = own.take(pa.array(order[:per_round])).combine_chunks()
        for t in best.values():
            yield from t.to_batches()

    found = written(features.select("key", "words", "style", "meta").mapInArrow(run, schema).dropDuplicates(["kind", "key"]), "confident")
    return {kind: found.where(F.col("kind") == k).orderBy(F.desc("sure"), "key").limit(per_round).toArrow() for k, kind in enumerate(kinds)}


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, meta_cols: tuple[str, ...], quality_col: str, toxic_col: str, max_labelled: int, rounds: int, per_round: int
) -> tuple[Model, DataFrame | None]:
    """The model, and the features (doc_id, key, words, style, meta) of all documents; none if nothing can be learnt.

    A third of the labelled sample calibrates, the rest trains; if one part lacks a class, all rows do both.
    """
    low, toxic = labels[quality_col] == 0, labels[toxic_col] == 1
    known = labels.select(labels[id_col].alias("id"), F.coalesce(low, F.lit(False)).alias("low"), F.coalesce(toxic, F.lit(False)).alias("toxic"), (low | toxic).alias("bad"))
    known = written(known.where("id IS NOT NULL AND bad IS NOT NULL").groupBy("id").agg(*(F.max(F.col(c).cast("int")).alias(c) for c in ("bad", "low", "toxic"))), "labels")
    rows = _columns(docs, id_col, text_col, meta_cols)
    chosen = written(known.join(rows.select(F.col("doc_id").alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_labelled), "chosen")
    sample = rows.join(F.broadcast(chosen), rows["doc_id"] == F.col("id")).drop("doc_id")
    metas = [f"meta{k}" for k in range(len(meta_cols))]
    first = F.struct(F.xxhash64("text", *metas), F.coalesce(F.octet_length("text"), F.lit(-1)))
    sample = written(sample.groupBy("id").agg(F.min_by(F.struct("text", *metas, "bad", "low", "toxic"), first).alias("r")).select("id", "r.*").withColumn("held", F.pmod(F.xxhash64("id"), F.lit(3)) == 0), "sample")

    parts = {r.held: r for r in sample.groupBy("held").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("bad", "low", "toxic"))).collect()}
    n, bad = sum(r.n for r in parts.values()), sum(r.bad for r in parts.values())
    model = Model(prior=bad / n if n else 0.0)
    if not 0 < model.prior < 1:
        return model, None
    split = all(h in parts and 0 < parts[h].bad < parts[h].n for h in (True, False))
    mine = sample.where("NOT held") if split else sample
    ones = {c: sum(getattr(r, c) for h, r in parts.items() if not (split and h)) for c in ("bad", "low", "toxic")}
    model.words = choose_words(mine, ones, parts[False].n if split else n)

    table = describe(rows, model.words)
    features = written(table.select("doc_id", F.xxhash64(*table.columns).alias("key"), "words", "style", "meta"), "features")
    taught = describe(sample.select("id", "bad", "held", "text", *metas), model.words).orderBy(F.xxhash64("id"), "id").toArrow()
    held = taught.column("held").to_numpy() if split else np.zeros(taught.num_rows, bool)
    pick = lambda at: (Features.read(t := taught.filter(pa.array(at))), t.column("bad").to_numpy().astype(float))
    own, back = pick(~held), pick(held if split else ~held)
    clipped = np.clip(own[0].style.astype(np.float64), None, 30)
    model.mean, model.scale = clipped.mean(axis=0), clipped.std(axis=0) + 1e-3

    views = ("text", "meta") if meta_cols else ("text",)
    lessons: dict[str, list[tuple[Features, np.ndarray]]] = {v: [] for v in views}
    given = {v: np.zeros(0, np.int64) for v in views}
    pool = features.where("doc_id IS NOT NULL").join(known.select(F.col("id").alias("doc_id")), "doc_id", "left_anti") if len(views) > 1 and rounds else None
    if pool is not None:
        pool = written(pool.select("key", "words", "style", "meta"), "pool")
    for round_ in range(rounds + 1):
        for v in views:
            _fit_view(model, v, own, back, lessons[v])
        if round_ == rounds or pool is None:
            break
        learnt = False
        for (view, label), t in most_confident(pool, model, np.unique(np.concatenate(list(given.values()))), per_round).items():
            other = "meta" if view == "text" else "text"
            t = t.filter(pa.array(~np.isin(t.column("key").to_numpy(), given[other])))
            if t.num_rows:
                learnt = True
                given[other] = np.append(given[other], t.column("key").to_numpy())
                lessons[other].append((Features.read(t), np.full(t.num_rows, label)))
        if not learnt:
            break
    return model, features
