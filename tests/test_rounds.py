"""Rounds of reconciliation against the one-pass aggregate, with retries, single rechecks and restarts; scans to convergence."""

from pyspark.sql import functions as F

from ledgerloom.plans import reconcile as R
from ledgerloom.plans import rounds as N
from ledgerloom.sinks.accepted import AcceptedStore


def candidates(spark, n=60):
    """Two tasks; paths that repeat over pages, one that is never kept, one that its third page keeps."""
    rows = []
    for task in ("t1", "t2"):
        for k in range(n):
            rows.append((task, f"{task}-c{k:03d}", k, ["Kept / A", "Kept / B", "never / x", "third / y", f"own / {k}"][k % 5 if k % 10 < 5 else k % 4], "d", "u", "e"))
    return spark.createDataFrame(rows, "task_id string, occurrence_id string, position int, feature_text string, document_id string, unit_id string, evidence_text string")


def judged(paged):
    path = F.col("path")
    third = F.row_number().over(N_window())
    kept = F.when(path.startswith("never"), "Other / path").when(path.startswith("third") & (third < 20), "Wrong / path").otherwise(F.col("feature_text"))
    return paged.select("task_id", "occurrence_id", F.when(path == "kept / b", "MERGE").otherwise("MATCHED").alias("type"), kept.alias("explanation"), F.concat(F.lit("groupAnchorId="), "occurrence_id").alias("evidence"))


def N_window():
    from pyspark.sql import Window

    return Window.partitionBy("task_id", "path").orderBy("position")


class Model:
    """Answers from a table; may leave a target out until an attempt, or always while asked with others, or for good."""

    def __init__(self, table, until=None, together=(), never=()):
        self.table, self.until, self.together, self.never, self.feedback = table, until or {}, list(together), list(never), []

    def __call__(self, requests):
        self.feedback += [r.feedback for r in requests.select("feedback").collect() if r.feedback]
        each = requests.select("task_id", "page", "alone", "attempt", F.explode("targets").alias("t")).select("task_id", "page", "alone", "attempt", "t.occurrence_id")
        out = each.join(self.table, ["task_id", "occurrence_id"])
        for occurrence, attempt in self.until.items():
            out = out.where((F.col("occurrence_id") != occurrence) | (F.col("attempt") >= attempt))
        if self.together:
            out = out.where(~F.col("occurrence_id").isin(self.together) | (F.col("alone") != ""))
        if self.never:
            out = out.where(~F.col("occurrence_id").isin(self.never))
        return out.drop("attempt")


COLUMNS = ["task_id", "page", "path", "source_id", "type", "explanation", "evidence", "reused"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_rounds_equal_the_aggregate(spark):
    paged = R.pages(candidates(spark))
    table = judged(paged)
    got = N.reconcile_in_rounds(paged, Model(table))
    assert rows(got.conclusions) == rows(R.settled(paged, table))
    assert got.failures.count() == 0
    # the first round asks every page that has a new path; later ones only for paths that were not kept
    asked = {n: c for n, _, _, c in got.calls}
    own = R.groups(paged)
    first = own.groupBy("task_id", "path").agg(F.min("page").alias("page")).select("task_id", "page").distinct().count()
    assert asked[1] == first and asked[2] == 2 and sum(asked.values()) < own.select("task_id", "page").distinct().count() + 2 * 8
    last = own.where("path = 'never / x'").groupBy("task_id").count().agg(F.max("count")).first()[0]
    assert max(asked) == last


def test_retries_and_single_rechecks(spark):
    paged = R.pages(candidates(spark, 20))
    table = judged(paged)
    model = Model(table, until={"t1-c000": 3}, together=["t2-c001"])
    got = N.reconcile_in_rounds(paged, model, feedback=lambda m: F.concat(F.lit("again: "), m))
    assert rows(got.conclusions) == rows(R.settled(paged, table))
    assert set(model.feedback) == {"again: Each page representative candidateId must have exactly one conclusion"}
    first = [c for c in got.calls if c[0] == 1]
    assert [(a, alone != "", n) for _, a, alone, n in first][:3] == [(1, False, first[0][3]), (2, False, 2), (3, False, 2)]
    assert sum(n for _, _, alone, n in first if alone) >= 2
    lost = N.reconcile_in_rounds(paged, Model(table, never=["t1-c001"]))
    assert {(r.task_id, r.page) for r in lost.failures.collect()} == {("t1", 1)}
    assert all(not (r[0] == "t1" and r[2] == "kept / b") for r in rows(lost.conclusions))
    assert N.reconcile_in_rounds(paged.limit(0), model).conclusions.count() == 0


def test_the_log_of_calls_does_not_grow_with_single_rechecks(spark):
    """The driver keeps a row for all single rechecks of an attempt, whatever their number."""
    paged = R.pages(candidates(spark, 40))
    table = judged(paged)
    got = N.reconcile_in_rounds(paged, Model(table, together=[f"t{t}-c{k:03d}" for t in (1, 2) for k in range(40)]))
    assert rows(got.conclusions) == rows(R.settled(paged, table))
    single = [c for c in got.calls if c[2]]
    assert len({(c[0], c[1]) for c in single}) == len(single) and sum(c[3] for c in single) > 20


def test_a_loop_goes_on_from_its_store(spark, tmp_path):
    paged = R.pages(candidates(spark, 30))
    table = judged(paged)
    store = AcceptedStore(spark, f"{tmp_path}/s", ["task_id", "page", "path"], buckets=4)
    N.reconcile_in_rounds(paged, Model(table), store=store, max_rounds=2)
    again = N.reconcile_in_rounds(paged, Model(table), store=store)
    assert rows(again.conclusions) == rows(R.settled(paged, table))
    assert again.calls[0][3] <= 2
    once_more = N.reconcile_in_rounds(paged, Model(table), store=store)
    assert once_more.calls == [] and rows(once_more.conclusions) == rows(again.conclusions)


def test_scans(spark):
    units = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "unit string")
    found = {1: [("a", "x"), ("a", "x"), ("b", None), ("c", "x"), (None, "n"), ("zz", "?")], 2: [("a", "x"), ("a", "y"), ("b", None), (None, "n"), (None, "m")], 3: [("a", "y"), ("a", "z"), (None, "m")], 4: []}
    seen = []

    def scan(asked, added, number):
        seen.append((sorted(str(r.unit) for r in asked.collect()), None if added is None else added.count()))
        failed = ["c"] if number == 2 else []
        return spark.createDataFrame(found[number], "unit string, text string"), spark.createDataFrame([(f,) for f in failed], "unit string")

    got = N.scan_in_rounds(units, scan, unit=["unit"], content=["text"], max_passes=None)
    assert seen == [(["None", "a", "b", "c"], None), (["None", "a", "b", "c"], 4), (["None", "a"], 2), (["a"], 1)]
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(got.accepted) == sorted([("a", "x", 1), ("b", None, 1), ("c", "x", 1), (None, "n", 1), ("a", "y", 2), (None, "m", 2), ("a", "z", 3)], key=str)
    assert key(got.duplicates) == sorted([("a", "x", 1, 1), ("a", "x", 2, 1), ("b", None, 2, 1), (None, "n", 2, 1), ("a", "y", 3, 1), (None, "m", 3, 1)], key=str)
    assert key(got.units) == sorted([("a", 4, True, False), ("b", 2, True, False), ("c", 2, False, True), (None, 3, True, False)], key=str)
    assert got.rounds == [(1, 4, 4), (2, 4, 2), (3, 2, 1), (4, 1, 0)]
    seen.clear()
    two = N.scan_in_rounds(units, scan, unit=["unit"], content=["text"])
    assert len(seen) == 2 and key(two.units.where("converged")) == sorted([("a", 2, True, False), ("b", 2, True, False), (None, 2, True, False)], key=str)
    assert N.scan_in_rounds(units.limit(0), scan, unit=["unit"], content=["text"]).accepted.count() == 0
