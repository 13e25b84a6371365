"""Relational operators of the ledger: integrity, coverage, sequences, merges, paging and queues.

All are plain DataFrame compositions. Rule failures come back as rows (rule, key, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.tables import written

# Allowed changes of status.
TASK_TRANSITIONS = {
    "QUEUED": ["AUDITING", "CANCELLED"],
    "AUDITING": ["GENERATING", "PARTIAL", "FAILED", "CANCELLED"],
    "GENERATING": ["VALIDATING", "FAILED", "CANCELLED"],
    "VALIDATING": ["COMPLETED", "PARTIAL", "FAILED", "CANCELLED"],
    "PARTIAL": ["QUEUED"],
    "FAILED": ["QUEUED"],
    "COMPLETED": [],
    "CANCELLED": [],
}
BATCH_TRANSITIONS = {"QUEUED": ["RUNNING", "CANCELLED"], "RUNNING": ["ACCEPTED", "FAILED", "CANCELLED"], "ACCEPTED": [], "FAILED": [], "CANCELLED": []}


def _violations(df: DataFrame, rule: str, keys: list[str], detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)).alias("key"), detail.cast("string").alias("detail"))


def check_unique(df: DataFrame, keys: list[str], rule: str = "unique") -> DataFrame:
    return _violations(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), rule, keys, F.col("n"))


def check_rows(df: DataFrame, keys: list[str], condition: Column, rule: str = "check") -> DataFrame:
    """Rows for which the condition is false; as in SQL, an unknown condition passes."""
    return _violations(df.where(~condition), rule, keys, F.lit("false"))


def check_foreign(child: DataFrame, parent: DataFrame, keys: list[str], rule: str = "foreign") -> DataFrame:
    known = child.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return _violations(known.join(parent.select(*keys), keys, "left_anti"), rule, keys, F.lit("no parent"))


def require_none(violations: DataFrame) -> DataFrame:
    """The same (empty) rows; fails, when run, at the first violation."""
    return violations.where(F.raise_error(F.concat_ws(": ", "rule", "key", "detail")).isNotNull())


def coverage(expected: DataFrame, covering: DataFrame, key: str) -> DataFrame:
    """Exactly-once cover: keys that are missing, unknown or covered more than once, with their number."""
    have = covering.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key, F.lit(True).alias("e")).distinct().join(have, key, "full")
    state = F.when(F.col("e").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select(key, state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("state IS NOT NULL")


def merge_replay(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent: the incoming rows with an outcome: insert, same, or conflict if a stored row differs."""
    values = [c for c in incoming.columns if c not in keys]
    old = stored.select(*keys, *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_stored"))
    equal = F.lit(True)
    for c in values:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = F.when(F.col("_stored").isNull(), "insert").when(equal, "same").otherwise("conflict")
    return incoming.join(old, keys, "left").select(*incoming.columns, outcome.alias("outcome"))


def numbered(df: DataFrame, partition: list[str], order: list[Column], name: str = "sequence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def numbered_in_ranges(df: DataFrame, partition: list[str], order: list[str], name: str = "sequence") -> DataFrame:
    """As ``numbered``, for groups of which one may hold much of the table: rows are dealt out by ranges of (partition,
    order), numbered within each range, and the ranges before add their counts, of which there are few."""
    # written once: both what is numbered and what is counted read the same ranges
    ranged = written(df.repartitionByRange(*partition, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range", *partition).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *partition, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_range", *partition).orderBy(*order)))
    same = F.lit(True)
    offsets = offsets.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_g{k}") for k, c in enumerate(partition)), "_before")
    for k, c in enumerate(partition):
        same &= local[c].eqNullSafe(F.col(f"_g{k}"))
    return local.join(offsets, (F.col("_range") == F.col("_r")) & same).select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))


def latest(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return numbered(df, partition, order, "_n").where("_n = 1").drop("_n")


def previous(df: DataFrame, partition: list[str], order: list[Column], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*partition).orderBy(*order)))


def contiguous(df: DataFrame, partition: list[str], ordinal: str, start: int | None = 1) -> DataFrame:
    """Groups whose ordinals are not start, start + 1, ...; with no start, from wherever they begin. Aggregates only."""
    g = df.groupBy(*partition).agg(F.count("*").alias("n"), F.countDistinct(ordinal).alias("d"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    good = (F.col("d") == F.col("n")) & (F.col("hi") - F.col("lo") + 1 == F.col("n"))
    return _violations(g.where(~(good if start is None else good & (F.col("lo") == start))), "contiguous", partition, F.concat_ws("..", "lo", "hi"))


def page(df: DataFrame, order: list[Column], page_number: int, size: int) -> DataFrame:
    if page_number < 0 or not 1 <= size <= 100:
        raise ValueError("a page is 0 or more, and has 1 to 100 rows")
    return df.orderBy(*order).offset(page_number * size).limit(size)


def illegal_transitions(changes: DataFrame, transitions: dict[str, list[str]], source: str = "source", target: str = "target") -> DataFrame:
    """Changes that the table does not allow; the table is a constant array, so there is no join."""
    pairs = [f"{a}>{b}" for a, bs in transitions.items() for b in bs]
    return changes.where(~F.coalesce(F.concat_ws(">", source, target).isin(pairs), F.lit(False)))


def compare_and_set(df: DataFrame, condition: Column, **updates: Column) -> DataFrame:
    """Rows with the updates where the condition holds, and changed saying where it did."""
    changed = F.coalesce(condition, F.lit(False))
    return df.select(*(F.when(changed, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in df.columns), changed.alias("changed"))


def claim(tasks: DataFrame, running: DataFrame, slots: int, order: list[Column]) -> DataFrame:
    """The queued tasks that free slots take, first come first served. A top-k: no sort of the whole queue, and nothing
    is run while the plan is built; the number of running ones is one row that is joined."""
    heads = tasks.where("status = 'QUEUED'").orderBy(*order).limit(slots).withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    used = F.broadcast(running.agg(F.count("*").alias("_used")))
    return heads.crossJoin(used).where(F.col("_place") <= slots - F.col("_used")).select(tasks.columns)


def after_lease(work: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """RUNNING rows whose lease is over go back to the queue, or fail at their last attempt or if not retryable."""
    over = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") < now)
    status = F.when(over & ((F.col("attempts") >= max_attempts) | ~F.coalesce("retryable", F.lit(True))), "FAILED").when(over, "QUEUED").otherwise(F.col("status"))
    return work.withColumns({"status": status, "lease_expires_at": F.when(~over, F.col("lease_expires_at"))})


def change_violations(changed: DataFrame, expected: DataFrame, keys: list[str], rule: str = "one row changed") -> DataFrame:
    """(rule, key, detail) for keys of ``expected`` of which not exactly one row of ``changed`` (as ``compare_and_set`` gives
    it) has changed, and for changed keys that were not expected. Null keys are keys."""
    did = changed.where("changed").groupBy(*keys).agg(F.count("*").alias("_n"), F.lit(0).alias("_asked"))
    asked = expected.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_asked"))
    both = did.unionByName(asked).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    return _violations(both.where("_n <> 1 OR _asked = 0"), rule, keys, F.when(F.col("_asked") == 0, "not asked for").otherwise(F.col("_n").cast("string")))


def overlay(upper: DataFrame, lower: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, of which those of ``upper`` hide those of ``lower`` with the same keys, nulls among them. Columns
    are those of ``upper``; a null value of it hides as well."""
    hidden = upper.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return upper.unionByName(lower.select(upper.columns).join(hidden, same, "left_anti"))


def accumulated(pages: list[DataFrame]) -> DataFrame:
    """All rows of all pages, with the number of the page, from 1."""
    out = None
    for k, p in enumerate(pages, 1):
        rows = p.withColumn("page", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def distinct_in_order(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """(group, values): each group's distinct values in the order of their first occurrence; ties by value. Null values
    and rows without an order are left out. Values are made distinct before they meet in one row."""
    first = df.where(F.col(value).isNotNull() & F.col(order).isNotNull()).groupBy(*group, value).agg(F.min(order).alias("_first"))
    return first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("values"))
