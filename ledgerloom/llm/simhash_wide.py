"""SimHash at the radius that a similarity of word shingles needs: blocks, bit-sliced comparison, exact verification.

At a Jaccard similarity of 0.8 about 10 of 64 fingerprint bits differ (standard deviation 3), more than a multi-index
over so few bits can search. The blocks that are compared come from the shingles instead: the least hashes of BINS
bins, BANDS of two bins each, bring a pair of that similarity together with probability 1 - (1 - 0.8 ** 2) ** 10 =
0.99996. Inside a block the fingerprints' bit planes are compared at once by carry-save counters, and words of lanes
that have all passed the radius are abandoned; the pairs that are left are decided by their exact similarity. Every
two documents of a block that other links have not joined are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, free_name, text_batches, written
from ledgerloom.llm.graph import components
from ledgerloom.llm.simhash import BitPlanes, bit_majority, shingle_hashes
from ledgerloom.llm.words import as_binary, mix, slices

#: of pairs at similarity 0.8 about 3 in ten million differ in more bits; of unrelated pairs 92 of 100 do
RADIUS = 26
BINS, BANDS = 20, 10
#: documents of a bucket, and their shingles, that one group of comparisons holds on each side
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: texts that are compared together take so many bits, and the hash of a shingle the others
LINE_BITS = 20


def _each(column: pa.Array, shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingle hashes of each text, and how many."""
    each = [np.unique(np.array(shingle_hashes(x, shingle, 42), np.uint64)) for x in as_binary(column).to_pylist()]
    return each, np.array([len(x) for x in each], np.int64)


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with digest, n, fp and bands in place of text: the shingle set's digest, size, fingerprint and block keys."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                each, sizes = _each(part.column("text"), shingle)
                flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
                at = np.repeat(np.arange(len(each)), sizes) * BINS + (((flat >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
                first = np.append(True, at[1:] != at[:-1])[: len(at)]
                least = np.zeros(len(each) * BINS, np.uint64)
                least[at[first]] = np.maximum(flat[first], np.uint64(1))
                pairs = least.reshape(len(each), BANDS, BINS // BANDS)
                keys = mix(mix(pairs[:, :, 0] + np.arange(1, BANDS + 1, dtype=np.uint64)) + pairs[:, :, 1]).view(np.int64)
                some = (pairs > 0).any(axis=2)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some.sum(axis=1))).astype(np.int32)), pa.array(keys[some]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in each], pa.binary()), pa.array(sizes, pa.int32()), pa.array(bit_majority(flat, sizes).view(np.int64)), lists],
                    names=[*others, "digest", "n", "fp", "bands"],
                )

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return text_batches(docs.select(*others, "text")).mapInArrow(run, f"{kinds}, digest binary, n int, fp long, bands array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(lid, h) of texts (lid, text): the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                each, _ = _each(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([part.column("lid"), pa.array([x.view(np.int64) for x in each], pa.list_(pa.int64()))], names=["lid", "h"])

    return text_batches(texts.select("lid", "text")).mapInArrow(run, "lid long, h array<long>")


def _texts(nodes: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(lid, text) of these nodes, one row each: rows of one content are alike."""
    own = nodes.join(ids, "lid", "left_semi").select("lid", "content")
    return docs.select("content", "text").join(own, "content").groupBy("lid").agg(F.first("text").alias("text"))


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Of pairs (u, v) those whose exact similarity reaches the threshold."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("lid")).distinct()
    sets = written(_sets(_texts(nodes, docs, ids), shingle), "sets")
    both = pairs.join(sets.select(F.col("lid").alias("u"), F.col("h").alias("a")), "u").join(sets.select(F.col("lid").alias("v"), F.col("h").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", shared.alias("s"), (F.size("a") + F.size("b")).alias("t")).where(F.col("s") >= threshold * (F.col("t") - F.col("s")) - 1e-9).select("u", "v")


def _lead_pairs(met: DataFrame, threshold: float, radius: int) -> DataFrame:
    """(u, v): each row of a bucket with the bucket's first, if sizes and fingerprints let them be similar."""
    leads = met.groupBy("b").agg(F.min(F.struct("lid", "n", "fp")).alias("lead"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= radius
    may = (F.col("lid") != F.col("lead.lid")) & near & (F.least("n", "lead.n") >= threshold * F.greatest("n", "lead.n"))
    return met.join(leads, "b").where(may).select(F.col("lead.lid").alias("u"), F.col("lid").alias("v")).distinct()


def _block_links(met: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, threshold: float, radius: int) -> DataFrame:
    """(u, v): links that connect all similar rows of different components that share a bucket of ``met`` (lid, n, fp, b).

    In a bucket of several components, each row outside the largest meets every row of another, in blocks of about
    BLOCK rows or BLOCK_SHINGLES shingles on each side. Fingerprints are compared bit-sliced; pairs within the radius are
    decided by their whole sets where they meet, and a forest of links is handed on.
    """
    named = met.join(roots.select(F.col("node").alias("lid"), "root"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    shares = named.groupBy("b", "root").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    largest = shares.groupBy("b").agg(F.sum("k").alias("c"), F.sum("s").alias("total"), F.max("k").alias("most"), F.max_by(F.struct("root", "s"), F.struct("k", "root")).alias("big")).where("most < c")
    several = cut(named.join(largest, "b").withColumn("other", F.col("root") != F.col("big.root")))
    if several.isEmpty():
        return several.select(F.col("lid").alias("u"), F.col("lid").alias("v"))
    parts = lambda rows, size: F.ceil(F.greatest(rows / F.lit(BLOCK), size / F.lit(BLOCK_SHINGLES))).cast("int")
    all_parts, other_parts = parts(F.col("c"), F.col("total")), parts(F.col("c") - F.col("most"), F.col("total") - F.col("big.s"))
    own = lambda n: F.pmod(F.xxhash64("lid"), n).cast("int")
    shown = ("lid", "root", "other", "n", "fp")
    lefts = several.where("other").select("b", F.explode(F.sequence(F.lit(0), all_parts - 1)).alias("q"), own(other_parts).alias("p"), *shown)
    rights = several.select("b", F.explode(F.sequence(F.lit(0), other_parts - 1)).alias("p"), own(all_parts).alias("q"), *shown)
    groups = [x.select(F.xxhash64("b", "p", "q").alias("g"), F.lit(side).alias("left"), *shown) for x, side in ((lefts, True), (rights, False))]
    texts = written(_texts(nodes, docs, several.select("lid").distinct()), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            g = held.column("g").to_numpy()
            inner = np.flatnonzero(g != g[-1])
            if len(inner):  # the last group may go on in the next batch
                yield _compare(held.slice(0, int(inner[-1]) + 1), shingle, threshold, radius)
                held = held.slice(int(inner[-1]) + 1).combine_chunks()
        if held is not None:
            yield _compare(held, shingle, threshold, radius)

    rows = groups[0].unionByName(groups[1]).join(texts, "lid").repartition("g").sortWithinPartitions("g", "left", "lid")
    return text_batches(rows).mapInArrow(run, "u long, v long")


def _compare(rows: pa.Table, shingle: int, threshold: float, radius: int) -> pa.RecordBatch:
    """Of whole groups, sorted: links between similar rows of their two sides, a forest over the roots."""
    g, left, lid, root, other, n, fp = (rows.column(c).to_numpy() for c in ("g", "left", "lid", "root", "other", "n", "fp"))
    _, first, which = np.unique(lid, return_index=True, return_inverse=True)
    each, _ = _each(rows.column("text").take(pa.array(first)).combine_chunks(), shingle)

    def sets(at: np.ndarray) -> np.ndarray:
        """The sets of these rows as lines.py compares them: the row's place, then 44 bits of hash."""
        own = [each[k] for k in which[at]]
        place = np.repeat(np.arange(len(at), dtype=np.uint64), [len(x) for x in own])
        return (place << np.uint64(64 - LINE_BITS)) | ((np.concatenate(own) if own else np.zeros(0, np.uint64)) >> np.uint64(LINE_BITS))

    us, vs, joined = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}

    def link(x: np.ndarray, y: np.ndarray) -> None:
        new = joining(root[x].tolist(), root[y].tolist(), joined)
        us.append(lid[x[new]]), vs.append(lid[y[new]])

    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    for s, e in zip(starts, np.append(starts[1:], len(g)), strict=True):
        i, j = s + np.flatnonzero(left[s:e]), s + np.flatnonzero(~left[s:e])
        if not len(i) or not len(j):
            continue
        if len(j) >= 64:
            planes = BitPlanes(fp[j].view(np.uint64))
            near = np.concatenate([np.unpackbits(planes.within(fp[i[at : at + 256]].view(np.uint64), radius).view(np.uint8), axis=1, bitorder="little")[:, : len(j)] for at in range(0, len(i), 256)]).astype(bool)
        else:
            near = np.bitwise_count((fp[i][:, None] ^ fp[j]).view(np.uint64)) <= radius
        a, b = np.nonzero(near)
        x, y = i[a], j[b]
        may = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])) & (~(other[x] & other[y]) | (lid[x] < lid[y]))
        a, b = a[may], b[may]
        if len(a) > 8 * (len(i) + len(j)):  # many pairs of few rows: count what they share by a matrix product
            yes = product(sets(i), sets(j), len(i), len(j), threshold)[a, b]
            link(i[a[yes]], j[b[yes]])
        for at in range(0, 0 if len(a) > 8 * (len(i) + len(j)) else len(a), 1024):
            x, y = i[a[at : at + 1024]], j[b[at : at + 1024]]
            yes = alike(sets(x), sets(y), len(x), threshold)
            link(x[yes], y[yes])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def alike(a: np.ndarray, b: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Whether the k-th sets of a and of b, in order by k, reach the threshold."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    of = lambda x: np.bincount((x >> np.uint64(64 - LINE_BITS)).astype(np.int64), minlength=n)
    shared = of(both[1:][both[1:] == both[:-1]])
    return shared >= threshold * (of(a) + of(b) - shared) - 1e-9


def joining(a: list[int], b: list[int], joined: dict[int, int]) -> list[int]:
    """Places k at which a[k] and b[k] are not connected yet, by ``joined`` (a forest of parents) or earlier places."""
    out = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        while (p := joined.get(x, x)) != x:
            joined[x] = joined.get(p, p)
            x = p
        while (p := joined.get(y, y)) != y:
            joined[y] = joined.get(p, p)
            y = p
        if x != y:
            joined[max(x, y)] = min(x, y)
            out.append(k)
    return out


def product(a: np.ndarray, b: np.ndarray, n: int, m: int, threshold: float) -> np.ndarray:
    """For n sets a and m sets b whether each two reach the threshold; only shingles that both sides have are counted."""
    rest, mask = np.uint64(64 - LINE_BITS), np.uint64((1 << 64 - LINE_BITS) - 1)
    ha, hb = a & mask, b & mask
    common = np.intersect1d(ha, hb)
    of = lambda x, k: np.bincount((x >> rest).astype(np.int64), minlength=k)
    shared = np.zeros((n, m), np.float32)
    for at in range(0, len(common), 8192):
        part = common[at : at + 8192]
        x, y = np.zeros((n, len(part)), np.float32), np.zeros((m, len(part)), np.float32)
        for sets, h, into in ((a, ha, x), (b, hb, y)):
            k = np.minimum(np.searchsorted(part, h), len(part) - 1)
            hit = part[k] == h
            into[(sets[hit] >> rest).astype(np.int64), k[hit]] = 1
        shared += x @ y.T
    return shared >= threshold * (of(a, n)[:, None] + of(b, m) - shared) - 1e-9


def near_copies(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(content, first) for every distinct content of docs (doc_id, content, text), content a hash of the two others:
    whether it is its component's first, by id (null ids last), then by content.

    Documents are linked if the Jaccard similarity of their shingle sets reaches the threshold; those of equal sets,
    and so all without words, are one node.
    """
    described = written(_described(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "n", "fp", "bands")).alias("at")
    nodes = described.groupBy("digest").agg(first).select(F.monotonically_increasing_id().alias("lid"), "digest", F.struct("at.none", "at.doc_id", "at.content").alias("at"), "at.content", "at.n", "at.fp", "at.bands")
    nodes = written(nodes, "nodes")
    buckets = nodes.select("lid", "n", "fp", F.explode("bands").alias("b"))
    met = written(buckets.join(buckets.groupBy("b").agg(F.count("*").alias("k")).where("k > 1").select("b"), "b", "left_semi").select(buckets.columns), "met")
    pairs = cut(_lead_pairs(met, threshold, radius))
    roots = components(_similar(pairs, nodes, docs, shingle, threshold))
    edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = components(edges.unionByName(_block_links(met, roots, nodes, docs, shingle, threshold, radius)))
    named = nodes.join(roots, nodes["lid"] == roots["node"], "left").select("digest", "at", F.coalesce("root", "lid").alias("root"))
    least = named.groupBy("root").agg(F.min("at").alias("at"))
    kept = cut(least.select(F.col("at.content").alias("content"), F.lit(True).alias("kept")))
    return described.select("content").distinct().join(kept, "content", "left").select("content", F.coalesce("kept", F.lit(False)).alias("first"))


def one_of_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component of ``near_copies``, all columns unchanged, whatever their names.

    It is that of the smallest id, null ids after all others; among rows that repeat an id with different texts,
    that of the least hash of both; among rows that repeat id and text, any one. Null, empty and blank texts are one
    component. No rows give no rows. Integer ids only.
    """
    content = free_name(docs, "content")
    key = F.xxhash64(docs[id_col].cast("long"), docs[text_col])
    found = near_copies(docs.select(docs[id_col].cast("long").alias("doc_id"), key.alias("content"), docs[text_col].alias("text")), shingle=shingle, threshold=threshold, radius=radius)
    first = cut(found.where("first").select(F.col("content").alias(content)))
    kept = docs.withColumn(content, key).join(first, content, "left_semi")
    twice = cut(kept.groupBy(content).agg(F.count("*").alias("c")).where("c > 1").select(content))
    if not twice.isEmpty():
        kept = kept.join(twice, content, "left_anti").unionByName(kept.join(twice, content, "left_semi").dropDuplicates([content]))
    return kept.select(docs.columns)
