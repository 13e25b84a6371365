"""Ranked lexical search over sharded inverted indexes, by MaxScore in each shard.

``build_index`` turns documents into shards where they lie, without a shuffle: a shard is one row of a
written table, with the postings of some megabytes of text. ``search`` takes the queries in parts of a
checked size. In a shard, a query's lists are ordered by the most that each can give. Lists are
essential while what they and the weaker ones give together reaches the score that k documents are
known to have; the others are only probed for documents that can still reach it. That score is carried
from shard to shard in a task, and each task hands on k documents a query.

Scores are integers, so that they are the same in whatever order they are added.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import shared_dir, written
from ledgerloom.llm.words import slices, split_words

#: bytes of text of a shard; a longer document is a shard of its own
SHARD_BYTES = 12 << 20
#: bytes of query terms that go to the tasks at once
PART_BYTES = 8 << 20
#: groups in which a query's candidates are ranked before they meet in one
RANK_GROUPS = 32

_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

INDEX = "n_docs long, n_terms long, terms array<string>, dfs array<int>, ids binary, known binary, lens binary, starts binary, docs binary, tfs binary"


def terms_of(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The terms of all texts, A-Z lower-cased, and the n + 1 term offsets of the texts."""
    return split_words(column, _BREAK, _LOWER)


def counted(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, and by term and text: text and times; where each term starts among these, and each text's length."""
    words, at = terms_of(column)
    coded = words.dictionary_encode()
    lens, n = np.diff(at), max(len(at) - 1, 1)
    text = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
    pair, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + text, return_counts=True)
    starts = np.searchsorted(pair // n, np.arange(len(coded.dictionary) + 1))
    return coded.dictionary.cast(pa.large_string()).cast(pa.string()), (pair % n).astype(np.int32), times.astype(np.int32), starts.astype(np.int64), lens.astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Batches cut and joined to about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, "text", limit):
            if held and size + part.nbytes > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of all documents, a written table. Null and empty texts are documents without terms; rows that repeat
    are documents of their own; a null id stays null. Other columns, whatever their names, are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _gathered(batches, shard_bytes):
            shard = shard.combine_chunks()
            ids = shard.column("doc_id").combine_chunks()
            terms, docs, tfs, starts, lens = counted(shard.column("text").combine_chunks())
            raw = [np.asarray(ids.fill_null(0)).astype(np.int64), np.asarray(ids.is_valid()).astype(np.uint8), lens, starts, docs, tfs]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int((lens > 0).sum())], pa.int64()),
                    pa.array([int(lens.sum())], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                    pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), pa.array(np.diff(starts).astype(np.int32))),
                    *(pa.array([x.tobytes()], pa.binary()) for x in raw),
                ],
                names=["n_docs", "n_terms", "terms", "dfs", "ids", "known", "lens", "starts", "docs", "tfs"],
            )

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # rows are large: the writer looks at its size after each of them
    source.mapInArrow(run, INDEX).write.option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).parquet(path)
    return spark.read.schema(INDEX).parquet(path)


# ---- one query in one shard ------------------------------------------------------------------------------------------


def best_of_shard(lists: list[tuple[np.ndarray, np.ndarray]], bounds: list[int], scores: np.ndarray, k: int, floor: int) -> np.ndarray:
    """The documents of a shard whose score is above 0 and not below what k documents are known to reach, ``floor`` or
    more; their scores are in ``scores``. A list has ascending documents and what each gets; ``bounds`` the most of each."""
    order = sorted(range(len(lists)), key=lambda i: -bounds[i])
    rest = [0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        rest[i] = rest[i + 1] + bounds[order[i]]
    scores.fill(0)
    i = 0
    # essential lists: a document that is in none of them cannot reach the floor
    while i < len(order) and rest[i] >= floor:
        docs, gain = lists[order[i]]
        scores[docs] += gain
        i += 1
        if rest[i] < (top := scores.max()) and len(scores) >= k and top > floor:
            floor = max(floor, int(np.partition(scores, -k)[-k]))
    found = np.flatnonzero((scores > 0) & (scores + rest[i] >= floor))
    # the others are probed while a document can qualify
    for j in range(i, len(order)):
        if len(found) == 0:
            break
        docs, gain = lists[order[j]]
        at = np.searchsorted(docs, found)
        at[at == len(docs)] = 0
        hit = docs[at] == found
        scores[found[hit]] += gain[at[hit]]
        if len(found) >= k:
            floor = max(floor, int(np.partition(scores[found], -k)[-k]))
        found = found[scores[found] + rest[j + 1] >= floor]
    return found


class _Best:
    """The k best documents of one query so far; equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 0
        self.rows = np.zeros((3, 0), np.int64)  # minus the score, whether the id is null, the id

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows, rows], axis=1)
        self.rows = rows[:, np.lexsort(rows[::-1])[: self.k]]
        if self.rows.shape[1] == self.k:
            self.floor = int(-self.rows[0, -1])


def _search_task(batches: Iterator[pa.RecordBatch], part: dict, k: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    vocabulary = pa.array(part["terms"], pa.string())
    weight, rids, at, term, times = (part[x] for x in ("weights", "rids", "at", "term", "times"))
    best = [_Best(k) for _ in rids]
    for batch in batches:
        for row in batch.to_pylist():
            own = pc.index_in(pa.array(row["terms"], pa.string()), vocabulary)
            held = np.flatnonzero(np.asarray(own.is_valid()))
            if len(held) == 0:
                continue
            names = np.asarray(own.fill_null(0))[held]
            starts = np.frombuffer(row["starts"], np.int64)
            sizes = (starts[1:] - starts[:-1])[held]
            ends = np.cumsum(sizes)
            where = np.repeat(starts[held] - (ends - sizes), sizes) + np.arange(ends[-1])
            docs, tf = np.frombuffer(row["docs"], np.int32)[where], np.frombuffer(row["tfs"], np.int32)[where].astype(np.int64)
            length = 25 + 75 * np.frombuffer(row["lens"], np.int64) * n_docs // n_terms
            gain = np.repeat(weight[names], sizes) * (1_000_000_000 * tf // (1000 * tf + 8 * length[docs]))
            most = np.maximum.reduceat(gain, ends - sizes)
            slot = np.full(len(vocabulary), -1)
            slot[names] = np.arange(len(names))
            ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8)
            scores = np.zeros(len(ids), np.int64)
            for q in range(len(rids)):
                lists, bounds = [], []
                for s, c in zip(slot[term[at[q] : at[q + 1]]].tolist(), times[at[q] : at[q + 1]].tolist(), strict=True):
                    if s >= 0 and most[s] > 0:
                        a, b = int(ends[s] - sizes[s]), int(ends[s])
                        lists.append((docs[a:b], gain[a:b] if c == 1 else gain[a:b] * c))
                        bounds.append(int(most[s]) * c)
                found = best_of_shard(lists, bounds, scores, k, best[q].floor)
                if len(found):
                    best[q].add(np.stack([-scores[found], 1 - known[found].astype(np.int64), ids[found]]))
    rows = np.concatenate([b.rows for b in best], axis=1) if best else np.zeros((3, 0), np.int64)
    owner = np.repeat(np.asarray(rids, np.int64), [b.rows.shape[1] for b in best])
    yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(rows[2], mask=rows[1] == 1), pa.array(-rows[0])], names=["rid", "doc_id", "score"])


# ---- all queries over all shards -------------------------------------------------------------------------------------


def _query_terms(queries: DataFrame, item_id: str, text: str) -> DataFrame:
    """(rid, item_id, terms, times) of every query, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for k in range(part.num_rows):
                    one = part.slice(k, 1)
                    terms, _, times, _, _ = counted(one.column(1))
                    bound = pa.array([0, len(terms)], pa.int32())
                    yield pa.RecordBatch.from_arrays([one.column(0), pa.ListArray.from_arrays(bound, terms), pa.ListArray.from_arrays(bound, pa.array(times))], names=["item_id", "terms", "times"])

    kind = queries.schema[item_id].dataType.simpleString()
    source = queries.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    rows = source.mapInArrow(run, f"item_id {kind}, terms array<string>, times array<int>").where(F.size("terms") > 0)
    return written(rows.select(F.monotonically_increasing_id().alias("rid"), "*"), "queries")


def search(index: DataFrame, queries: DataFrame, *, k: int = 10, item_id: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best documents with a score above 0, fewer if there are fewer.

    Equal scores rank by ascending document id, null ids last. Queries without terms (null, empty or of other
    characters) have no rows; queries that repeat an id or a text are answered each. No documents give no rows. Queries
    go out in parts of at most about ``part_bytes`` of terms, and the index is read once for each part; the driver holds
    one part at a time.
    """
    spark = index.sparkSession
    items = _query_terms(queries, item_id, text)
    size = F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16))
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    total = items.agg(size).first()[0]
    parts = -(-total // part_bytes) if total else 0
    item = items.select("rid", F.pmod(F.xxhash64("rid"), F.lit(max(parts, 1))).alias("part"), "terms", "times")
    asked = item.select("part", F.explode("terms").alias("term")).distinct()
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    dfs = written(held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    found: list[DataFrame] = []
    for p in range(parts if n_terms else 0):
        known = {r.term: r.df for r in dfs.join(asked.where(F.col("part") == p), "term", "left_semi").collect()}
        rows = item.where(F.col("part") == p).select("rid", "terms", "times").collect()
        terms = sorted(known)
        number = {t: i for i, t in enumerate(terms)}
        lists = [[(number[t], c) for t, c in zip(r.terms, r.times, strict=True) if t in number] for r in rows]
        flat = np.array([x for own in lists for x in own], np.int64).reshape(-1, 2)
        sent = spark.sparkContext.broadcast(
            {
                "terms": terms,
                "weights": np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * known[t] + 1))) for t in terms], np.int64),
                "rids": [r.rid for r in rows],
                "at": np.cumsum([0, *map(len, lists)]),
                "term": flat[:, 0],
                "times": flat[:, 1],
            }
        )

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return _search_task(batches, sent.value, k, n_docs, n_terms)

        shards = index.select("terms", "ids", "known", "lens", "starts", "docs", "tfs")
        found.append(written(shards.mapInArrow(run, "rid long, doc_id long, score long"), "found"))
        sent.destroy()
    if not found:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    merged = found[0]
    for f in found[1:]:
        merged = merged.unionByName(f)
    # a query's candidates grow with the tasks: they are ranked by groups first
    first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    merged = merged.withColumn("_group", F.pmod(F.xxhash64("doc_id", "score"), F.lit(RANK_GROUPS)))
    for keys in (["rid", "_group"], ["rid"]):
        merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*first))).where(F.col("rank") <= k)
    return merged.join(items.select("rid", "item_id"), "rid").select("item_id", "rank", "doc_id", "score")
