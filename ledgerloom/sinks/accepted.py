"""A durable table of accepted results: each unit is accepted once, whatever is delivered again or dies in between.

An epoch (a micro-batch of a stream, or any number that the caller gives) is written in two steps: its rows, as partitions
that replace what a writer that died has left there, then its commit, by one rename. Readers see committed epochs only. An
epoch that is committed is not written again; a unit that a committed epoch holds is not accepted again.

    store = AcceptedStore(spark, path, unit=["batch_id"], attempt="attempt_id")
    results.writeStream.foreachBatch(store.accept).option("checkpointLocation", ...).start()
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.tables import written
from ledgerloom.sinks.epochs import BUCKETS, EpochStore


class AcceptedStore(EpochStore):
    """``rows`` by epoch and bucket; ``outcomes`` (unit, attempt, outcome) by epoch.

    With ``attempt``, all rows of a unit's attempt are accepted together, and take the place of nothing: of several
    attempts in one epoch that with the smallest value wins, the others are replays, as is every attempt at a unit that
    is accepted. Without it each row is a unit of its own: an equal row that comes again is the same, and a different
    row of the same key a conflict, which is kept out. Null keys and attempts are values like others; in one epoch, equal
    rows are one, and of different rows of one key the first in the order of their values is accepted.
    """

    def __init__(self, spark: SparkSession, path: str, unit: list[str], attempt: str | None = None, buckets: int = BUCKETS):
        super().__init__(spark, path, buckets)
        self.unit, self.attempt = unit, attempt

    def rows(self) -> DataFrame | None:
        """All accepted rows with their epoch; None before anything is accepted."""
        found = self.read("rows", self.epochs())
        return None if found is None else found.drop("bucket")

    def outcomes(self) -> DataFrame | None:
        """What became of every unit that was delivered, with its epoch."""
        found = self.read("outcomes", self.epochs())
        return None if found is None else found.drop("bucket")

    def accept(self, incoming: DataFrame, epoch: int) -> None:
        """Writes and commits an epoch; does nothing if it is committed. Fit for ``foreachBatch``."""
        committed = self.epochs()
        if epoch in committed:
            return
        incoming = incoming.withColumn("bucket", self.bucket(self.unit))
        stored = self.read("rows", committed, incoming if committed else None)
        marked = written((self._by_attempt if self.attempt else self._by_row)(incoming, stored), "marked")
        accepted = "accepted" if self.attempt else "insert"
        self.write("rows", marked.where(F.col("outcome") == accepted).drop("outcome"), epoch)
        told = marked.select(*self.unit, self.attempt, "outcome", "bucket").distinct() if self.attempt else marked.select(*self.unit, "outcome", "bucket")
        self.write("outcomes", told, epoch)
        self.commit(epoch)

    def _together(self, incoming: DataFrame, stored: DataFrame | None, values: list[str]) -> DataFrame:
        """The distinct rows of both, dealt out once by unit: _came says whether it is of this epoch, _was of one before."""
        rows = incoming.select(*self.unit, *values, "bucket", F.lit(True).alias("_came"), F.lit(False).alias("_was"))
        if stored is not None:
            held = stored.select(*self.unit, *(F.col(x) if x in stored.columns else F.lit(None).alias(x) for x in values), "bucket", F.lit(False).alias("_came"), F.lit(True).alias("_was"))
            rows = rows.unionByName(held)
        rows = rows.withColumn("_slot", self.slot(self.unit)).repartition("_slot")
        return rows.groupBy("_slot", *self.unit, "bucket", *values).agg(F.max("_came").alias("_came"), F.max("_was").alias("_was"))

    def _by_attempt(self, incoming: DataFrame, stored: DataFrame | None) -> DataFrame:
        values = [x for x in incoming.columns if x not in (*self.unit, "bucket")]
        # of what is stored, that a unit is there
        known = None if stored is None else stored.select(*self.unit, "bucket").distinct()
        rows = self._together(incoming, known, values)
        unit = Window.partitionBy("_slot", *self.unit)
        attempt = F.struct(F.col(self.attempt).isNull(), F.col(self.attempt).alias("a"))
        rows = rows.withColumns({"_known": F.max("_was").over(unit), "_winner": F.min(F.when(F.col("_came"), attempt)).over(unit)})
        outcome = F.when(~F.col("_known") & attempt.eqNullSafe(F.col("_winner")), "accepted").otherwise("replay")
        return rows.where("_came").select(*incoming.columns, outcome.alias("outcome"))

    def _by_row(self, incoming: DataFrame, stored: DataFrame | None) -> DataFrame:
        values = [x for x in incoming.columns if x not in (*self.unit, "bucket")]
        row = F.struct(*(v for x in values for v in (F.col(x).isNull().alias(f"_n_{x}"), F.col(x)))) if values else F.struct(F.lit(True))
        unit = Window.partitionBy("_slot", *self.unit)
        rows = self._together(incoming, stored, values)
        rows = rows.withColumns({"_held": F.max("_was").over(unit), "_first": F.min(F.when(F.col("_came"), row)).over(unit)})
        outcome = F.when(F.col("_was"), "same").when(F.col("_held") | ~row.eqNullSafe(F.col("_first")), "conflict").otherwise("insert")
        return rows.where("_came").select(*incoming.columns, outcome.alias("outcome"))
