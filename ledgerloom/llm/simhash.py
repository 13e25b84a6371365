"""SimHash near-duplicates: fingerprints, multi-index buckets, bit-sliced comparison, components.

For radii beyond 2, as word similarity needs, see ``simhash_wide``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, text_batches
from ledgerloom.llm.graph import components
from ledgerloom.llm.words import as_binary, slices

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANES = np.uint64(0x0101010101010101)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)
#: fingerprints in one 32-bit bucket beyond which it is divided by 16 bits more, which leaves
#: 2 ** 16 different fingerprints in a bucket at most, whatever the data
REFINE_ABOVE = 2048


def bit_majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of ``sizes`` hashes, the 64 bits that are set in over half of each run; an empty run has none.

    Byte lanes count up to 255 hashes at once: eight passes with one bit of each byte.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full) == 0:
        return out
    n = sizes[full]
    chunks = -(-n // 255)
    first = np.cumsum(chunks) - chunks
    inner = np.arange(chunks.sum()) - np.repeat(first, chunks)
    starts = np.repeat(np.cumsum(n) - n, chunks) + 255 * inner
    half = n[:, None]
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        set_ = (2 * counts > half).astype(np.uint64)
        for byte in range(8):
            out[full] |= set_[:, byte] << np.uint64(8 * byte + j)
    return out


def shingle_hashes(text: bytes, shingle: int, seed: int) -> list[int]:
    """XXH64 of each run of ``shingle`` words of lower-cased text, or of all its words if they are fewer."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [h(joined, seed)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist()[shingle - 1 :], len(joined)]
    return [h(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long. Null, empty and blank texts have fingerprint 0."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                each = [shingle_hashes(x, shingle, seed) for x in as_binary(part.column(1)).to_pylist()]
                sizes = np.array([len(x) for x in each])
                flat = np.concatenate([np.array(x, np.uint64) for x in each]) if len(each) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bit_majority(flat, sizes).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))).mapInArrow(fold, f"doc_id {kind}, fp long")


class BitPlanes:
    """Fingerprints stored vertically: plane j holds bit j of all of them, 64 to a word."""

    def __init__(self, fps: np.ndarray):
        self.n, self.fps = len(fps), fps
        padded = np.zeros(-(-self.n // 64) * 64, np.uint64)
        padded[: self.n] = fps
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
        self.valid = np.packbits(np.arange(len(padded)) < self.n, bitorder="little").view(np.uint64)

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """A row of words for each query, a bit for each fingerprint at most ``radius`` bits away.

        The differences of all lanes are counted by carry-save adders, one bitwise counter per binary
        digit; a lane whose count passes the radius stays out, and words of which all lanes are out, for
        all queries, are abandoned.
        """
        digits = (radius + 1).bit_length()
        out = np.zeros((len(queries), self.planes.shape[1]), np.uint64)
        live = np.arange(self.planes.shape[1])
        over = np.broadcast_to(~self.valid, out.shape).copy()
        counter = [np.zeros(out.shape, np.uint64) for _ in range(digits)]
        for j in range(64):
            flip = np.where((queries >> np.uint64(j)) & _ONE, _ALL, np.uint64(0))
            carry = self.planes[j, live][None, :] ^ flip[:, None]
            for digit in counter:
                carry, digit[...] = digit & carry, digit ^ carry
            over |= carry
            if j % 8 == 7:
                over |= self._above(counter, radius)
                keep = ~(over == _ALL).all(axis=0)
                if not keep.all():
                    live, over, counter = live[keep], over[:, keep], [d[:, keep] for d in counter]
                    if len(live) == 0:
                        return out
        out[:, live] = ~over
        return out

    @staticmethod
    def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
        """Lanes whose count, given by its binary digits, is over the radius."""
        above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _ALL)
        for k in range(len(counter) - 1, -1, -1):
            if radius >> k & 1:
                equal &= counter[k]
            else:
                above |= equal & counter[k]
                equal &= ~counter[k]
        return above

    def forest(self, radius: int) -> list[tuple[int, int]]:
        """(member, first member) for all members of each component of the radius graph but the first.

        A breadth-first search over lanes: each fingerprint is a query once, and no list of pairs is made.
        """
        todo = self.valid.copy()
        links = []
        for word in range(len(todo)):
            while todo[word]:
                w = int(todo[word])
                root = 64 * word + (w & -w).bit_length() - 1
                todo[word] &= np.uint64(w & (w - 1))
                front = [root]
                while front:
                    batch, front = front[:256], front[256:]
                    near = np.bitwise_or.reduce(self.within(self.fps[batch], radius), axis=0) & todo
                    if near.any():
                        todo &= ~near
                        new = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")).tolist()
                        links += [(x, root) for x in new]
                        front += new
        return links


def small_groups(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """As BitPlanes.forest, for many groups of at most 64 fingerprints: one word of lanes for each group."""
    lane = (np.arange(len(fps)) - np.repeat(starts, sizes)).astype(np.uint64)
    digits = (radius + 1).bit_length()
    valid = np.where(sizes == 64, _ALL, (_ONE << (sizes % 64).astype(np.uint64)) - _ONE)
    over = np.repeat(~valid, sizes)
    counter = [np.zeros(len(fps), np.uint64) for _ in range(digits)]
    live, bits = np.arange(len(fps)), fps
    out = np.zeros(len(fps), np.uint64)
    for j in range(64):
        plane = np.repeat(np.bitwise_or.reduceat(((fps >> np.uint64(j)) & _ONE) << lane, starts), sizes)[live]
        carry = plane ^ np.where((bits >> np.uint64(j)) & _ONE, _ALL, np.uint64(0))
        for digit in counter:
            carry, digit[...] = digit & carry, digit ^ carry
        over |= carry
        if j % 16 == 15:
            over |= BitPlanes._above(counter, radius)
            mine = _ONE << lane[live]
            keep = (over | mine) != _ALL  # others than itself are left
            live, bits, over, counter = live[keep], bits[keep], over[keep], [d[keep] for d in counter]
            if len(live) == 0:
                return []
    out[live] = ~over
    links = []
    group = np.repeat(np.arange(len(starts)), sizes)
    for g in np.unique(group[live]).tolist():
        a, n = int(starts[g]), int(sizes[g])
        near = out[a : a + n].tolist()
        todo = (1 << n) - 1
        for root in range(n):
            if not todo >> root & 1 or not near[root]:
                continue
            todo &= ~(1 << root)
            front = near[root] & todo
            while front:
                x = (front & -front).bit_length() - 1
                front &= front - 1
                if todo >> x & 1:
                    todo &= ~(1 << x)
                    links.append((a + x, a + root))
                    front |= near[x] & todo
    return links


def _bits(fp: Column, start: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _choices(word: Column, blocks: int, bits: int) -> Column:
    """For each choice of two of the blocks, the choice and those bits in ``key``, the other bits in ``rest``."""
    out = []
    for t, (a, b) in enumerate(combinations(range(blocks), 2)):
        others = [c for c in range(blocks) if c not in (a, b)]
        key = F.lit(t << 2 * bits).cast("long") + F.shiftleft(_bits(word, a * bits, bits), bits) + _bits(word, b * bits, bits)
        rest = F.lit(0).cast("long")
        for c in others:
            rest = F.shiftleft(rest, bits) + _bits(word, c * bits, bits)
        out.append(F.struct(key.alias("key"), rest.alias("rest")))
    return F.array(*out)


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): a spanning forest of each bucket's radius graph over ``nodes`` (fp, rep); u and v are reps.

    Four blocks of 16 bits: fingerprints at most two bits apart agree in two blocks, so six buckets of 32
    equal bits find every pair. Buckets above REFINE_ABOVE are divided in the same way by the 32 bits that
    are left, in blocks of 8. The radius is at most 2 for that reason.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four blocks guarantee a radius of 2 at most")
    first = nodes.select("fp", "rep", F.inline(_choices(F.col("fp"), 4, 16)))
    sizes = first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = first.join(sizes, "key")
    small = shared.where(F.col("n") <= REFINE_ABOVE).select("key", F.lit(-1).cast("long").alias("key2"), "fp", "rep")
    large = shared.where(F.col("n") > REFINE_ABOVE).select("key", "fp", "rep", F.inline(_choices(F.col("rest"), 4, 8)).alias("key2", "rest2"))
    buckets = small.unionByName(large.drop("rest2"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(t: pa.Table) -> pa.RecordBatch:
            key, key2, fp, rep = (t.column(c).to_numpy() for c in ("key", "key2", "fp", "rep"))
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            fps = fp.view(np.uint64)
            pairs = []
            few = (sizes > 1) & (sizes <= 64)
            if few.any():
                take = np.flatnonzero(np.repeat(few, sizes))
                n = sizes[few]
                pairs += [(int(take[a]), int(take[b])) for a, b in small_groups(fps[take], np.cumsum(n) - n, n, radius)]
            for a, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
                pairs += [(a + x, a + y) for x, y in BitPlanes(fps[a : a + n]).forest(radius)]
            at = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rep[at[:, 0]]), pa.array(rep[at[:, 1]])], names=["u", "v"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own]).combine_chunks()
            key, key2 = held.column("key").to_numpy(), held.column("key2").to_numpy()
            inner = np.flatnonzero((key != key[-1]) | (key2 != key2[-1]))
            if len(inner):  # the last bucket may go on in the next batch
                yield solve(held.slice(0, int(inner[-1]) + 1))
                held = held.slice(int(inner[-1]) + 1)
        if held is not None and held.num_rows:
            yield solve(held)

    kind = nodes.schema["rep"].dataType.simpleString()
    return buckets.repartition("key", "key2").sortWithinPartitions("key", "key2", "fp").mapInArrow(compare, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id that links reach, its own included.

    Equal fingerprints are one node, whose id is the smallest among them; only nodes are compared.
    Null, empty and blank texts have fingerprint 0 and link like any other. Rows with a null id take the
    component of their fingerprint, or null if no row with an id has it; they link nothing by themselves.
    Repeated rows come back as often as they came. Other columns are ignored. No rows give no rows.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed))
    nodes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(nodes, radius))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
