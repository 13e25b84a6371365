"""Progress that is kept up to date from signed changes, with retractions.

What ``progress`` counts is linear in the rows, or a function of a few sums by unit of work, by conclusion and by batch.
The sums are kept by these keys and by task; a batch of changes reads the keys that it touches, moves the tasks' counts by
the difference of the function before and after, and writes them as one epoch. No table of the ledger is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.tables import written
from ledgerloom.plans.progress import CONCLUSIONS, derived
from ledgerloom.sinks.epochs import BUCKETS, EpochStore

c = F.col
_open = lambda: c("status") != "COMPLETED"
#: counts that are sums over the rows of one table
LINEAR: dict[str, dict[str, Callable[[], Column]]] = {
    "documents": {"complete_documents": lambda: c("complete")},
    "units": {"total_units": lambda: F.lit(True)},
    "work": {
        "total_work": lambda: F.lit(True),
        "completed_work": lambda: ~_open(),
        "failed_work": lambda: c("status") == "FAILED",
        "pending_function_list": lambda: _open() & (c("audit_stage") == "FEATURE_LIST_SCAN"),
        "pending_requirement_first_pass": lambda: _open() & (c("audit_stage") == "REQUIREMENT_SCAN") & (c("audit_pass") == 1),
        "pending_requirement_second_pass": lambda: _open() & (c("audit_stage") == "REQUIREMENT_SCAN") & (c("audit_pass") == 2),
    },
    "candidates": {"candidates": lambda: F.lit(True)},
    "frozen": {"_frozen": lambda: F.lit(True), "_eligible": lambda: c("generation_eligible"), "_ineligible": lambda: ~c("generation_eligible")},
}
_TYPES = {**CONCLUSIONS, None: "_other"}
#: of each kind of state: keys, sums, and the counts of a task that follow from one key's sums
KINDS: dict[str, tuple[list[str], list[str], dict[str, str]]] = {
    "unit": (["task_id", "document_id", "unit_id"], ["n", "done"], {"processed_units": "CASE WHEN n > 0 AND n = done THEN 1 ELSE 0 END"}),
    "conclusion": (
        ["task_id", "conclusion_id"],
        ["links", *(f"of_{v}" for v in _TYPES.values())],
        {"covered_candidates": f"links * ({' + '.join(f'of_{v}' for v in _TYPES.values())})", **{v: f"CASE WHEN links > 0 AND of_{v} > 0 THEN 1 ELSE 0 END" for v in CONCLUSIONS.values()}},
    ),
    "batch": (["batch_id"], ["accepted", "cases"], {"accepted_cases": "accepted * cases"}),
}
COUNTS = [*(n for t in LINEAR.values() for n in t), *(n for _, _, m in KINDS.values() for n in m)]


def _signed(condition: Column) -> Column:
    return F.sum(F.when(condition, c("sign")).otherwise(0))


class LiveProgress:
    """``apply`` takes signed changes of any of the tables documents, units, work, candidates, links, conclusions, frozen,
    batches and cases: their rows with ``sign``, 1 for a row that comes and -1 for one that goes; a change of a row is both.
    ``progress`` gives what ``progress.progress`` gives for the tables that the changes add up to.

    A batch number that is applied is not applied again. Changes may come in any order between tables, as sums commute;
    rows without a task count nowhere. A batch moves its cases with it: its task is that of its latest row.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.store = EpochStore(spark, path, buckets)

    def _state(self, kind: str, keys: list[str], columns: list[str], touched: DataFrame | None = None) -> DataFrame | None:
        """The latest sums of every key, or of those in the buckets that are touched."""
        rows = self.store.read(kind, self.store.epochs(), touched)
        return None if rows is None else rows.groupBy(*keys, "bucket").agg(F.max_by(F.struct(*columns), "epoch").alias("s")).select(*keys, "bucket", "s.*")

    def _changed(self, kind: str, keys: list[str], sums: list[str], delta: DataFrame, extra: list[str]) -> DataFrame:
        """Of the keys in ``delta`` the sums before (``old_``) and after; ``extra`` columns are kept where not null."""
        delta = written(delta.withColumn("bucket", self.store.bucket(keys)), "delta")
        rows = delta.select(*keys, "bucket", *(F.lit(0).cast("long").alias(f"old_{s}") for s in sums), *(c(s).cast("long") for s in sums), *(F.lit(None).cast("string").alias(f"old_{e}") for e in extra), *extra, F.lit(True).alias("_hit"))
        held = self._state(kind, keys, [*sums, *extra], delta)
        if held is not None:
            rows = rows.unionByName(held.select(*keys, "bucket", *(c(s).alias(f"old_{s}") for s in sums), *sums, *(c(e).alias(f"old_{e}") for e in extra), *(F.lit(None).cast("string").alias(e) for e in extra), F.lit(False).alias("_hit")))
        out = rows.groupBy(*keys, "bucket").agg(*(F.sum(s).alias(s) for x in sums for s in (f"old_{x}", x)), *(F.max(f"old_{e}").alias(f"old_{e}") for e in extra), *(F.max(e).alias(f"_new_{e}") for e in extra), F.max("_hit").alias("_hit"))
        return written(out.where("_hit").withColumns({e: F.coalesce(f"_new_{e}", f"old_{e}") for e in extra}).drop("_hit", *(f"_new_{e}" for e in extra)), kind)

    def apply(self, changes: dict[str, DataFrame], batch: int) -> None:
        if batch in self.store.epochs():
            return
        moved: list[DataFrame] = []
        for table, counts in LINEAR.items():
            if table in changes:
                moved.append(changes[table].groupBy("task_id").agg(*(_signed(f()).alias(n) for n, f in counts.items())))
        deltas = {kind: [] for kind in KINDS}
        if "work" in changes:
            deltas["unit"].append(changes["work"].groupBy("task_id", "document_id", "unit_id").agg(F.sum("sign").alias("n"), _signed(~_open()).alias("done")))
        if "links" in changes:
            deltas["conclusion"].append(changes["links"].groupBy("task_id", "conclusion_id").agg(F.sum("sign").alias("links")))
        if "conclusions" in changes:
            known = c("conclusion_type").isin(*CONCLUSIONS)
            of = [_signed(~F.coalesce(known, F.lit(False)) if k is None else c("conclusion_type") == k).alias(f"of_{v}") for k, v in _TYPES.items()]
            deltas["conclusion"].append(changes["conclusions"].groupBy("task_id", c("id").alias("conclusion_id")).agg(*of))
        if "batches" in changes:
            deltas["batch"].append(changes["batches"].groupBy(c("id").alias("batch_id")).agg(_signed(c("status") == "ACCEPTED").alias("accepted"), F.max(F.when(c("sign") > 0, c("task_id"))).alias("task_id")))
        if "cases" in changes:
            deltas["batch"].append(changes["cases"].groupBy("batch_id").agg(F.sum("sign").alias("cases")))
        for kind, (keys, sums, measures) in KINDS.items():
            if not deltas[kind]:
                continue
            extra = [] if "task_id" in keys else ["task_id"]
            delta = deltas[kind][0]
            for d in deltas[kind][1:]:
                delta = delta.unionByName(d, allowMissingColumns=True)
            for column in (*sums, *extra):
                if column not in delta.columns:
                    delta = delta.withColumn(column, F.lit(None).cast("string" if column in extra else "long"))
            delta = delta.groupBy(*keys).agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums), *(F.max(e).alias(e) for e in extra))
            now = self._changed(kind, keys, sums, delta, extra)
            before = {n: self._renamed(m, sums) for n, m in measures.items()}
            if extra:  # the counts leave the task that the key was of, and go to the one that it is of
                moved.append(now.select(c("old_task_id").alias("task_id"), *(F.expr(f"-({before[n]})").cast("long").alias(n) for n in measures)))
                moved.append(now.select("task_id", *(F.expr(m).cast("long").alias(n) for n, m in measures.items())))
            else:
                moved.append(now.select("task_id", *(F.expr(f"({m}) - ({before[n]})").cast("long").alias(n) for n, m in measures.items())))
            self.store.write(kind, now.select(*keys, *sums, *extra, "bucket"), batch)
        if moved:
            total = moved[0]
            for m in moved[1:]:
                total = total.unionByName(m, allowMissingColumns=True)
            for n in COUNTS:
                if n not in total.columns:
                    total = total.withColumn(n, F.lit(0).cast("long"))
            total = total.where("task_id IS NOT NULL").groupBy("task_id").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTS))
            now = self._changed("task", ["task_id"], COUNTS, total, [])
            self.store.write("task", now.select("task_id", *COUNTS, "bucket"), batch)
        self.store.commit(batch)

    @staticmethod
    def _renamed(measure: str, sums: list[str]) -> str:
        """The measure over the sums before."""
        import re

        return re.sub(r"\b(" + "|".join(map(re.escape, sorted(sums, key=len, reverse=True))) + r")\b", r"old_\1", measure)

    def progress(self, tasks: DataFrame) -> DataFrame:
        """``tasks`` (task_id, mode, status, material_documents) with all that ``progress.progress`` gives."""
        state = self._state("task", ["task_id"], COUNTS)
        out = tasks.withColumns({n: F.lit(0).cast("long") for n in COUNTS}) if state is None else tasks.join(state.drop("bucket"), "task_id", "left").fillna(0, COUNTS)
        return derived(out)
