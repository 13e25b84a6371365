"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import text_batches
from ledgerloom.llm.tokens import default_path, tokenizer
from ledgerloom.llm.words import slices

#: estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. Attention stays within a piece,
#: so pieces that share a sequence add up. The ratio is that of a model 4096 wide: at 4096 tokens, the
#: quadratic part is about a sixth of the whole.
LINEAR, QUADRATIC = 1.0, 1.0 / 20_480
#: tokens that are packed together; bounds a task's memory whatever its partition holds
GROUP_TOKENS = 1 << 22


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def plan(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length), the documents given by their token counts.

    Whole runs of ``capacity`` tokens fill sequences of their own. What is left of the documents is
    assigned in descending length (ties: earlier document first) to the sequence of lowest cost that has
    room for it, over as many sequences as those tokens fill; what fits nowhere whole is cut, again into
    the sequence of lowest cost with room. Tokens beyond the last full sequence go to sequences whose
    lengths are powers of two, so that no padding is left.
    """
    out: list[list[tuple[int, int, int]]] = []
    tails = []
    for d, n in enumerate(lengths.tolist()):
        full = n - n % capacity
        out += [[(d, at, capacity)] for at in range(0, full, capacity)]
        if n > full:
            tails.append((d, full, n - full))
    tails.sort(key=lambda t: (-t[2], t[0]))
    total = sum(t[2] for t in tails)
    whole, rest = divmod(total, capacity)
    sizes = [capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    room = sizes[:]
    seqs: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    heap = [(0.0, k) for k in range(len(sizes))]
    left: list[tuple[int, int, int]] = []
    largest = max(room, default=0)
    for d, at, n in tails:
        if n > largest:
            left.append((d, at, n))
            continue
        aside = []
        while heap and room[heap[0][1]] < n:
            aside.append(heapq.heappop(heap))
        if heap:
            c, k = heapq.heappop(heap)
            seqs[k].append((d, at, n))
            room[k] -= n
            if room[k]:
                heapq.heappush(heap, (c + cost(n, linear, quadratic), k))
        else:
            left.append((d, at, n))
            largest = max((room[k] for _, k in aside), default=0)
        for x in aside:
            heapq.heappush(heap, x)
    for d, at, n in left:
        while n:
            c, k = heapq.heappop(heap)
            take = min(n, room[k])
            seqs[k].append((d, at, take))
            room[k] -= take
            at, n = at + take, n - take
            if room[k]:
                heapq.heappush(heap, (c + cost(take, linear, quadratic), k))
    return out + seqs


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    tokenizer_path: str | None = None,
    end_id: int = 2,
    with_ids: bool = True,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document's ids are those of the tokenizer, then ``end_id``; each lies in exactly one piece. Groups of
    documents are packed where they are read: there is no shuffle, each task holds GROUP_TOKENS tokens
    or one longer document at a time, and a task that runs again makes the same rows.

    Null and empty texts are documents of ``end_id`` alone. A null id stays null. Repeated rows are packed
    each by itself. Columns but the two named are ignored, so that no name can clash. No rows give no rows.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path or default_path())  # looked up where it is read
        next_id = TaskContext.get().partitionId() << 40
        names, parts, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            ids, n = np.concatenate(parts), np.concatenate(lengths)
            begins = np.cumsum(n) - n
            rows: list[list] = [[] for _ in range(7)]
            spans = []
            for seq in plan(n, capacity, linear, quadratic):
                offset = 0
                for d, start, length in seq:
                    at = int(begins[d]) + start
                    for col, v in zip(rows, (d, start, length, zlib.crc32(ids[at : at + length]), int(n[d]), next_id, offset), strict=True):
                        col.append(v)
                    spans.append((at, length))
                    offset += length
                next_id += 1
            keys = pa.chunked_array(names).combine_chunks().take(pa.array(rows[0], pa.int64()))
            cols = [keys, *(pa.array(c, pa.int64()) for c in rows[1:])]
            if with_ids:
                ends = np.cumsum([0, *(length for _, length in spans)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([ids[a : a + k] for a, k in spans]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, at = t.ids(part.column(1))
                n = np.diff(at) + 1
                own = np.full(len(ids) + len(n), end_id, dtype="<u4")
                mask = np.ones(len(own), dtype=bool)
                mask[np.cumsum(n) - 1] = False
                own[mask] = ids
                names.append(part.column(0))
                parts.append(own)
                lengths.append(n)
                held += len(own)
                if held >= GROUP_TOKENS:
                    yield flush()
                    names, parts, lengths, held = [], [], [], 0
        if held:
            yield flush()

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return text_batches(source).mapInArrow(pack, T.StructType(fields))
