"""Work that is asked for in rounds: pages of candidates until every path is settled, and scans until nothing is new.

A round asks only for what the rounds before have left open, for all tasks at once. What it accepts is a committed epoch of
a durable store before the next one begins; a loop that starts again goes on from there and asks nothing twice. The number
of rounds is that of the answers in a row that settle nothing, not that of the pages. The driver sees counts only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.tables import shared_dir, written
from ledgerloom.plans.reconcile import failure_category, groups, may_recheck_alone
from ledgerloom.sinks.accepted import AcceptedStore

MAX_ATTEMPTS = 3
ANSWERS = "task_id string, page int, occurrence_id string, type string, explanation string, evidence string"
#: asks for the targets of requests (task_id, page, attempt, alone, feedback, targets) and returns rows of ANSWERS
Ask = Callable[[DataFrame], DataFrame]
REQUEST = ["task_id", "page", "alone"]
#: what stands in ``Reconciled.calls`` for requests of one target
ALONE = "alone"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A null-safe equi-join on the keys, which the left side keeps."""
    named = right.select(*(F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns))
    condition = F.lit(True)
    for k in keys:
        condition &= left[k].eqNullSafe(named[f"_{k}"])
    joined = left.join(named, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_{k}" for k in keys))


# ---- pages of candidates ---------------------------------------------------------------------------------------------


def answer_failures(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(task_id, page, alone, message): the first rule, in the order of their texts, that the answers to a request break.
    Each target has exactly one conclusion, no other candidate has one, only a split has several paths, and no path is
    blank or has markup."""
    targets = requests.select(*REQUEST, F.explode("targets").alias("t")).select(*REQUEST, F.col("t.occurrence_id").alias("occurrence_id"), F.lit(1).alias("asked"))
    given = answers.select("task_id", "page", "alone", "occurrence_id", "type", "explanation")
    counts = given.groupBy(*REQUEST, "occurrence_id").agg(F.count("*").alias("n"))
    both = targets.join(counts, [*REQUEST, "occurrence_id"], "full")
    missing = both.where("asked IS NULL OR n IS NULL OR n > 1").select(*REQUEST, F.lit("Each page representative candidateId must have exactly one conclusion").alias("message"))
    parts = F.when(F.col("type") == "SPLIT", F.split("explanation", "<br>", -1)).otherwise(F.array("explanation"))
    several = F.contains("explanation", F.lit("<br>"))
    broken = (
        F.when((F.col("type") == "SPLIT") & ~several, "SPLIT conclusions require explicit <br> separated business paths")
        .when((F.col("type") != "SPLIT") & several, "Only SPLIT conclusions may contain multiple business paths")
        .when(F.exists(parts, lambda p: F.coalesce(X.is_blank(p), F.lit(True))), "Business path must not be blank")
        .when(F.exists(parts, lambda p: F.contains(p, F.lit("<"))), "Business paths must be plain text")
    )
    paths = given.select(*REQUEST, broken.alias("message")).where("message IS NOT NULL")
    split = given.where("type = 'SPLIT'").select(*REQUEST, "occurrence_id", F.explode(F.split("explanation", "<br>", -1)).alias("part"))
    split = X.with_normal_path(split, "part", "normal").groupBy(*REQUEST, "occurrence_id").agg(F.count("*").alias("n"), F.countDistinct("normal").alias("d"))
    repeated = split.where("d < n").select(*REQUEST, F.lit("SPLIT conclusions require distinct business paths").alias("message"))
    return missing.unionByName(paths).unionByName(repeated).groupBy(*REQUEST).agg(F.min("message").alias("message"))


@dataclass
class Reconciled:
    """``conclusions`` as ``reconcile.settled`` gives them; ``failures`` (task_id, page, message) of requests that failed to
    the end; ``calls`` [(round, attempt, alone, number of requests)], alone empty for pages and ALONE for all single rechecks
    of an attempt."""

    conclusions: DataFrame
    failures: DataFrame
    calls: list[tuple[int, int, bool, int]] = field(default_factory=list)


def _asked(requests: DataFrame, ask: Ask, feedback: Callable[[Column], Column], max_attempts: int, calls: list, number: int) -> tuple[list[DataFrame], DataFrame]:
    """Answers of requests that hold, attempt by attempt, and (request, message) of those that never do."""
    good: list[DataFrame] = []
    pending = requests.withColumn("feedback", F.lit(None).cast("string"))
    for attempt in range(1, max_attempts + 1):
        pending = written(pending.withColumn("attempt", F.lit(attempt)), "requests")
        # two rows at most: single rechecks may be very many, and are counted together
        for row in pending.groupBy(F.when(F.col("alone") != "", ALONE).otherwise("").alias("alone")).count().orderBy("alone").collect():
            calls.append((number, attempt, row.alone, row["count"]))
        answers = written(ask(pending), "answers")
        failed = written(answer_failures(pending, answers), "failed")
        good.append(answers.join(failed, REQUEST, "left_anti"))
        pending = pending.join(failed, REQUEST).withColumn("feedback", feedback(F.col("message")))
        if failed.isEmpty():
            break
        if attempt < max_attempts:
            pending = pending.drop("message")
    return good, pending.select(*REQUEST, "targets", "message") if "message" in pending.columns else pending.select(*REQUEST, "targets", F.lit("").alias("message")).limit(0)


def reconcile_in_rounds(paged: DataFrame, ask: Ask, *, store: AcceptedStore | None = None, feedback: Callable[[Column], Column] = lambda m: m, max_attempts: int = MAX_ATTEMPTS, max_rounds: int = 10_000) -> Reconciled:
    """Asks for the conclusions of ``paged`` candidates (as ``reconcile.pages`` gives them), each path at its first page,
    and at later pages only while no page before has kept the path.

    A request is a page's open representatives, at most a page full; one whose answers break a rule is repeated with
    ``feedback`` on the rule's text. If it fails to the end with a failure that allows it, its targets are asked for one by
    one; what fails then is in ``failures``, and its path is asked for at no later page. Null task ids are not asked for;
    repeated candidates count once; no candidates give no rows. With ``store`` (unit task_id, page, path) answers last:
    the same call again asks for open paths only.
    """
    spark = paged.sparkSession
    store = store or AcceptedStore(spark, f"{shared_dir(spark)}/reconciled-{uuid.uuid4().hex}", ["task_id", "page", "path"])
    own = written(groups(paged.where("task_id IS NOT NULL")).select("task_id", "page", "path", "representative"), "groups")
    key, path = ["task_id", "page", "path"], ["task_id", "path"]
    calls: list[tuple[int, int, bool, int]] = []
    failures: list[DataFrame] = []
    epoch = max(store.epochs(), default=-1) + 1
    known = store.rows()
    if known is None:
        open_ = own
    else:
        # of a path, what comes after the last page that was asked, unless one has kept it
        told = known.groupBy(*path).agg(F.max("page").alias("_last"), F.max("keeps").alias("_kept"))
        open_ = own.join(told, path, "left").where("_last IS NULL OR (NOT _kept AND page > _last)").select(own.columns)
    frontier = written(open_.groupBy(*path).agg(F.min(F.struct("page", "representative")).alias("f")).select(*path, "f.*"), "frontier")
    number = 0
    while number < max_rounds and not frontier.isEmpty():
        number += 1
        target = F.struct(F.col("representative").alias("occurrence_id"), "path")
        requests = frontier.groupBy("task_id", "page").agg(F.array_sort(F.collect_list(target)).alias("targets")).withColumn("alone", F.lit(""))
        good, bad = _asked(requests, ask, feedback, max_attempts, calls, number)
        bad = written(bad, "refused")
        alone = bad.where(may_recheck_alone(failure_category(F.col("message"))))
        lost = bad.where(~F.coalesce(may_recheck_alone(failure_category(F.col("message"))), F.lit(False)))
        if not alone.isEmpty():
            single = alone.select("task_id", "page", F.explode("targets").alias("t")).select("task_id", "page", F.array("t").alias("targets"), F.col("t.occurrence_id").alias("alone"))
            more, still = _asked(single, ask, feedback, max_attempts, calls, number)
            good, lost = [*good, *more], lost.unionByName(written(still, "refused"))
        failures.append(lost.select("task_id", "page", "message"))
        answers = _union([g.select("task_id", "page", F.col("occurrence_id").alias("representative"), "type", "explanation", "evidence") for g in good])
        said = X.with_normal_path(frontier.join(answers, ["task_id", "page", "representative"]), "explanation", "_said")
        settled = written(said.withColumn("keeps", F.coalesce((F.col("type") != "SPLIT") & (F.col("_said") == F.col("path")), F.lit(False))).drop("_said"), "settled")
        store.accept(settled.select(*key, "representative", "type", "explanation", "evidence", "keeps"), epoch)
        epoch += 1
        # only paths whose answer has not kept them go on, with their next page
        again = settled.where("NOT keeps").select(*path, F.col("page").alias("_last"))
        frontier = written(own.join(again, path).where("page > _last").groupBy(*path).agg(F.min(F.struct("page", "representative")).alias("f")).select(*path, "f.*"), "frontier")
    answers = store.rows()
    if answers is None:
        empty = own.select(*key, F.col("representative").alias("source_id"), *(F.lit("").alias(x) for x in ("type", "explanation", "evidence")), F.lit(False).alias("reused")).limit(0)
        return Reconciled(empty, own.select("task_id", "page", F.lit("").alias("message")).limit(0), calls)
    answers = answers.drop("epoch")
    first = answers.where("keeps").groupBy(*path).agg(F.min(F.struct("page", F.col("representative").alias("source_id"), "type", "explanation", "evidence")).alias("f"))
    mine = answers.select(*key, F.struct(F.col("representative").alias("source_id"), "type", "explanation", "evidence").alias("m"))
    both = own.join(mine, key, "left").join(first, path, "left").withColumn("reused", F.coalesce(F.col("f.page") < F.col("page"), F.lit(False)))
    pick = [F.when(F.col("reused"), F.col(f"f.{x}")).otherwise(F.col(f"m.{x}")).alias(x) for x in ("source_id", "type", "explanation", "evidence")]
    told = both.where("reused OR m IS NOT NULL").select(*key, *pick, "reused")
    return Reconciled(told, _union(failures) if failures else told.select("task_id", "page", F.lit("").alias("message")).limit(0), calls)


# ---- scans -----------------------------------------------------------------------------------------------------------


@dataclass
class Scanned:
    """``accepted`` rows and ``duplicates``, each with its ``scan_pass``; ``units`` with passes, converged, failed; ``rounds``
    [(pass, units asked, rows accepted)]."""

    accepted: DataFrame
    duplicates: DataFrame
    units: DataFrame
    rounds: list[tuple[int, int, int]]


def scan_in_rounds(units: DataFrame, scan: Callable[[DataFrame, DataFrame | None, int], tuple[DataFrame, DataFrame]], *, unit: list[str], content: list[str], max_passes: int | None = 2) -> Scanned:
    """Scans units pass by pass until a pass adds nothing, or ``max_passes`` are done.

    ``scan`` gets the units of a pass, what the pass before has added to them (None in the first), and the pass, and returns
    rows (unit and content) and the units that it has failed for. A pass opens for the units only that the pass before has
    completed and added rows to; a unit that fails stays as it is. Rows of a content that a unit has are duplicates, as
    are repeats within a pass. With two passes at most, a completed second pass is convergence. Nulls are values like
    others. Each pass reads what the last one has added and the accepted rows of its own units, no others.
    """
    spark = units.sparkSession
    every = written(units.select(*unit).distinct(), "units")
    open_, added, number = every, None, 0
    accepted: list[DataFrame] = []
    duplicates: list[DataFrame] = []
    done: list[DataFrame] = []
    rounds: list[tuple[int, int, int]] = []
    while not open_.isEmpty() and (max_passes is None or number < max_passes):
        number += 1
        found, failed = scan(open_, added, number)
        failed = written(_same(open_, failed.select(*unit).distinct(), unit, "left_semi"), "failed")
        asked = _same(open_, failed, unit, "left_anti")
        found = _same(found.select(*unit, *content), asked, unit, "left_semi")
        marked = found.groupBy(*unit, *content).agg(F.count("*").alias("_n"), F.lit(0).alias("_old"))
        if accepted:
            held = _same(_union(accepted).select(*unit, *content), asked, unit, "left_semi").select("*", F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_old"))
            marked = marked.unionByName(held).groupBy(*unit, *content).agg(F.sum("_n").alias("_n"), F.max("_old").alias("_old")).where("_n > 0")
        marked = written(marked, "pass")
        new = marked.where("_old = 0").select(*unit, *content, F.lit(number).alias("scan_pass"))
        accepted.append(new)
        duplicates.append(marked.select(*unit, *content, F.lit(number).alias("scan_pass"), (F.col("_n") - 1 + F.col("_old")).alias("times")).where("times > 0"))
        going = written(_same(asked, new, unit, "left_semi"), "open")
        last = max_passes is not None and number == max_passes
        ended = asked if last else _same(asked, going, unit, "left_anti")
        done.append(_union([ended.select(*unit, F.lit(number).alias("passes"), F.lit(True).alias("converged"), F.lit(False).alias("failed")), failed.select(*unit, F.lit(number).alias("passes"), F.lit(False).alias("converged"), F.lit(True).alias("failed"))]))
        rounds.append((number, open_.count(), new.count()))
        open_, added = going, new
    if not accepted:
        none = spark.createDataFrame([], every.schema)
        rows = none.select(*unit, *(F.lit(None).cast("string").alias(x) for x in content), F.lit(1).alias("scan_pass"))
        return Scanned(rows, rows.withColumn("times", F.lit(1).cast("long")), none.select(*unit, F.lit(1).alias("passes"), F.lit(True).alias("converged"), F.lit(False).alias("failed")), rounds)
    return Scanned(_union(accepted), _union(duplicates), _union(done), rounds)
