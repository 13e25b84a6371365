"""Durable tables that are written epoch by epoch, each made visible by one rename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows are dealt out over so many partitions of an epoch by their keys, so that a lookup reads those of its own keys only
BUCKETS = 32
#: rows of a bucket that are written together; a task writes few buckets' files, and no bucket lies in one task
SLOTS = 16


class EpochStore:
    """Tables (``kind``) under one path, partitioned by epoch and bucket of the keys.

    A writer replaces what one that died has left of the same epoch, and commits at the end; readers see committed epochs
    only. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def epochs(self) -> list[int]:
        """The committed epochs."""
        return sorted(int(n) for n in self._names("commits") if n.isdigit())

    def commit(self, epoch: int) -> None:
        """The one step that makes an epoch visible."""
        fs, made = self._fs(f"{self.path}/commits/_{epoch}")
        fs.create(made, True).close()
        _, done = self._fs(f"{self.path}/commits/{epoch}")
        if not fs.rename(made, done) and not fs.exists(done):
            raise OSError(f"epoch {epoch} could not be committed")

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def slot(self, keys: list[str]) -> Column:
        """Of rows with the same bucket and keys the same; rows that are dealt out by it lie together by key and bucket."""
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets * SLOTS)).cast("int")

    def write(self, kind: str, df: DataFrame, epoch: int) -> None:
        """``df`` (with ``bucket``) as the epoch's rows, in place of any that are there."""
        # the epoch's whole folder is replaced, with buckets that a writer that died had filled from other rows
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{kind}/epoch={epoch}")

    def read(self, kind: str, epochs: list[int], touched: DataFrame | None = None) -> DataFrame | None:
        """The rows of these epochs, of the buckets that ``touched`` names only if it is given; None if there are none."""
        names = set(self._names(kind)) if epochs else set()
        paths = [f"{self.path}/{kind}/epoch={e}" for e in epochs if f"epoch={e}" in names and any(n.startswith("bucket=") for n in self._names(f"{kind}/epoch={e}"))]
        if not paths:
            return None
        found = self.spark.read.parquet(paths[0]).schema
        schema = T.StructType([f for f in found if f.name not in ("epoch", "bucket")] + [T.StructField("epoch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").schema(schema).parquet(*paths)
        if touched is None:
            return rows
        buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets)) if buckets else rows.limit(0)
