"""Token counts kept as rollups: signed deltas add to totals, and each batch is applied once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import shared_dir, text_batches
from ledgerloom.llm.tokens import default_path, tokenizer
from ledgerloom.llm.words import slices

DIMENSIONS = ("source", "lang", "tokenizer_version")
MEASURES = ("n_docs", "n_tokens")


def count_tokens(docs: DataFrame, version: str, *, path: str | None = None, extra: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, n_tokens), a row for each document, counted in place.

    ``extra`` tokens a document are added for ids that a tokenizer version appends. A null text counts as
    empty; null sources and languages are values of their own; other columns are ignored.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("source", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or default_path())  # looked up where it is read
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(t.counts(part.column(3)) + extra, pa.int64())], names=schema.names)

    named = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    return text_batches(named).mapInArrow(run, schema).withColumn("tokenizer_version", F.lit(version))


OLD = tuple(f"old_{d}" for d in DIMENSIONS)


def deltas(changes: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Signed (source, lang, tokenizer_version, n_docs, n_tokens) sums of one batch of changes.

    ``changes`` has op, source, lang, tokenizer_version, n_tokens and old_tokens, and old_source, old_lang and
    old_tokenizer_version where documents move between groups (without these columns, none moves). An insert adds a
    document and its count to its group, a delete takes document and old count out of the old group, a revision does
    both. Null dimensions are a group like any other. Another op, or a null one, is an error, as is a count that an op
    needs and lacks. Sums form before the shuffle.

    Rows that repeat are changes of their own, unless ``key`` names columns that tell changes apart: then of the rows
    of one key only the least counts (in the order of the other columns); rows with a null in the key all count.
    """
    if key:
        rest = [c for c in changes.columns if c not in key]
        whole = F.lit(True)
        for c in key:
            whole &= F.col(c).isNotNull()
        once = changes.where(whole).groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*")
        changes = once.unionByName(changes.where(~whole))
    op = F.lower("op")
    bad = F.raise_error(F.concat(F.lit("no such operation, or no count, in a change: "), F.coalesce("op", F.lit("null"))))
    known = F.when(op.isin("insert", "delete", "revise"), True).otherwise(bad.cast("boolean"))
    moves = all(c in changes.columns for c in OLD)
    side = lambda dims, sign, count: F.struct(*(F.col(c).alias(d) for c, d in zip(dims, DIMENSIONS, strict=True)), F.lit(sign).cast("long").alias("n_docs"), (sign * F.coalesce(count, bad)).cast("long").alias("n_tokens"))
    new, old = side(DIMENSIONS, 1, F.col("n_tokens")), side(OLD if moves else DIMENSIONS, -1, F.col("old_tokens"))
    signed = F.when(op == "insert", F.array(new)).when(op == "delete", F.array(old)).otherwise(F.array(old, new))
    rows = changes.where(known).select(F.inline(signed))
    return rows.groupBy(*DIMENSIONS).agg(*(F.sum(m).alias(m) for m in MEASURES))


class Rollup:
    """A folder of maintained totals and of the batches that they do not hold yet.

    A batch is committed by one rename of a finished folder to the batch's name. Committing an id again
    changes nothing, also while another writer commits the same batch: the first rename stays. A
    writer that dies leaves a folder that readers don't see. Every ``compact_every`` batches are added to the totals,
    in a new numbered snapshot that is also committed by one rename and that names the batches it holds; reading takes
    the newest snapshot and the few batches after it, however many there have been.
    """

    SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str | None = None, compact_every: int = 16):
        self.spark, self.compact_every = spark, compact_every
        self.path = path or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(self.path))

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path))]

    def _state(self) -> tuple[int, set[str], set[str]]:
        """Number of the newest snapshot (0: none), ids of the batches it holds, ids of those committed since."""
        names = self._names()
        newest = max((int(n.removeprefix("snapshot=")) for n in names if n.startswith("snapshot=")), default=0)
        held = {r.batch_id for r in self.spark.read.schema("batch_id string").parquet(f"{self.path}/snapshot={newest}/batches").collect()} if newest else set()
        return newest, held, {n.removeprefix("batch=") for n in names if n.startswith("batch=")} - held

    def batches(self) -> set[str]:
        """Ids of the batches that are committed."""
        _, held, fresh = self._state()
        return held | fresh

    def _rename(self, draft: str, name: str) -> bool:
        """Gives a finished folder its name, if no other has it."""
        final = self._hadoop(f"{self.path}/{name}")
        if not self._fs.exists(final) and self._fs.rename(self._hadoop(draft), final):
            # a rename onto a folder that has just appeared would move into it; then ours is not the one
            inner = self._hadoop(final, self._hadoop(draft).getName())
            if not self._fs.exists(inner):
                return True
            self._fs.delete(inner, True)
            return False
        self._fs.delete(self._hadoop(draft), True)
        return False

    def commit(self, batch_id: str, changes: DataFrame, key: tuple[str, ...] = ()) -> bool:
        """Applies a batch; false if its id was applied before, in which case nothing is computed."""
        if not batch_id or any(not (c.isalnum() or c in "-_.") for c in batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        _, held, fresh = self._state()
        if batch_id in held | fresh:
            return False
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        deltas(changes, key).write.parquet(draft)
        applied = self._rename(draft, f"batch={batch_id}")
        if applied and len(fresh) + 1 >= self.compact_every:
            self.compact()
        return applied

    def compact(self) -> bool:
        """Adds the batches since the newest snapshot to its totals, as the next snapshot; then removes what the
        snapshot before already held, which no reader needs. False if there was nothing to add, or another was first."""
        newest, held, fresh = self._state()
        if not fresh:
            return False
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        self._sum(newest, fresh).write.parquet(f"{draft}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(held | fresh)], "batch_id string").write.parquet(f"{draft}/batches")
        if not self._rename(draft, f"snapshot={newest + 1}"):
            return False
        for name in [*(f"batch={b}" for b in held), *([f"snapshot={newest - 1}"] if newest > 1 else [])]:
            self._fs.delete(self._hadoop(f"{self.path}/{name}"), True)
        return True

    def _sum(self, snapshot: int, fresh: set[str]) -> DataFrame:
        paths = [*([f"{self.path}/snapshot={snapshot}/totals"] if snapshot else []), *(f"{self.path}/batch={b}" for b in sorted(fresh))]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        # folder names are no partitions here: each path is read as a table of its own
        parts = [self.spark.read.schema(self.SCHEMA).parquet(p) for p in paths]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.groupBy(*DIMENSIONS).agg(*(F.sum(m).alias(m) for m in MEASURES))

    def totals(self) -> DataFrame:
        """Current totals of every group that has documents or tokens."""
        newest, _, fresh = self._state()
        return self._sum(newest, fresh).where("n_docs <> 0 OR n_tokens <> 0")
