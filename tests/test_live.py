"""Progress kept from changes against progress counted anew, after each of several batches."""

import random

from pyspark.sql import functions as F

from ledgerloom.plans.live import LiveProgress
from ledgerloom.plans.progress import progress

SCHEMAS = {
    "documents": "task_id string, document_id string, complete boolean",
    "units": "task_id string, document_id string, unit_id string",
    "work": "task_id string, document_id string, unit_id string, audit_stage string, audit_pass int, status string",
    "candidates": "task_id string, occurrence_id string",
    "links": "task_id string, conclusion_id string, candidate_id string",
    "conclusions": "task_id string, id string, conclusion_type string",
    "frozen": "task_id string, stable_feature_id string, generation_eligible boolean",
    "batches": "id string, task_id string, status string",
    "cases": "batch_id string, row_sequence int",
}
KINDS = ["MATCHED", "CONFLICT", "SPLIT", "MERGE", "FUNCTION_LIST_MISSING", None]


def random_row(r, table):
    task, k = r.choice(["t1", "t2", "t3"]), r.randrange(6)
    return {
        "documents": lambda: (task, f"d{k}", r.random() < 0.7),
        "units": lambda: (task, f"d{k % 2}", f"u{k}"),
        "work": lambda: (task, f"d{k % 2}", r.choice([f"u{k}", None]), r.choice(["FEATURE_LIST_SCAN", "REQUIREMENT_SCAN"]), r.choice([1, 2]), r.choice(["COMPLETED", "COMPLETED", "FAILED", "QUEUED"])),
        "candidates": lambda: (task, f"c{k}"),
        "links": lambda: (task, f"k{k}", f"c{r.randrange(9)}"),
        "conclusions": lambda: (task, f"{task}k{k}", r.choice(KINDS)),
        "frozen": lambda: (task, f"f{k}", r.random() < 0.5),
        "batches": lambda: (f"b{r.randrange(9)}", task, r.choice(["ACCEPTED", "FAILED"])),
        "cases": lambda: (f"b{r.randrange(9)}", k),
    }[table]()


def test_equals_progress_after_each_batch(spark, tmp_path):
    r = random.Random(4)
    tasks = spark.createDataFrame([(t, "ALL", s, 2) for t, s in (("t1", "AUDITING"), ("t2", "COMPLETED"), ("t3", "FAILED"), ("t4", "QUEUED"))], "task_id string, mode string, status string, material_documents int")
    live = LiveProgress(spark, f"{tmp_path}/live", buckets=4)
    held = {t: [] for t in SCHEMAS}
    order = lambda df: sorted((tuple(x) for x in df.select(sorted(df.columns)).collect()), key=str)
    assert order(live.progress(tasks))[0] is not None
    for batch in range(4):
        changes = {}
        for table, schema in SCHEMAS.items():
            if batch == 2 and table in ("batches", "units", "links"):
                continue
            rows = []
            for old in r.sample(held[table], min(len(held[table]), 4 * bool(batch))):
                held[table].remove(old)
                rows.append((*old, -1))
            for _ in range(8):
                new = random_row(r, table)
                if table == "conclusions":
                    new = (new[0], new[1].removeprefix(new[0]), new[2])
                    if any(x[:2] == new[:2] for x in held[table]):
                        continue
                if table == "batches" and any(x[0] == new[0] for x in held[table]):
                    continue
                held[table].append(new)
                rows.append((*new, 1))
            changes[table] = spark.createDataFrame(rows, f"{schema}, sign int").repartition(2)
        live.apply(changes, batch)
        live.apply(changes, batch)  # delivered again
        now = {t: spark.createDataFrame(rows, SCHEMAS[t]) for t, rows in held.items()}
        want = progress(tasks, now["documents"], now["units"], now["work"], now["candidates"], now["links"], now["conclusions"], now["frozen"], now["batches"], now["cases"])
        got = live.progress(tasks)
        assert sorted(got.columns) == sorted(want.columns)
        assert order(got) == order(want), batch


def test_a_batch_reads_its_own_keys_only(spark, tmp_path):
    live = LiveProgress(spark, f"{tmp_path}/live", buckets=16)
    many = spark.createDataFrame([("t", "d", f"u{k}", "REQUIREMENT_SCAN", 1, "QUEUED", 1) for k in range(200)], f"{SCHEMAS['work']}, sign int")
    live.apply({"work": many}, 0)
    one = spark.createDataFrame([("t", "d", "u7", "REQUIREMENT_SCAN", 1, "QUEUED", -1), ("t", "d", "u7", "REQUIREMENT_SCAN", 1, "COMPLETED", 1)], f"{SCHEMAS['work']}, sign int")
    key = ["task_id", "document_id", "unit_id"]
    read = live._state("unit", key, ["n", "done"], one.withColumn("bucket", live.store.bucket(key)))
    assert 0 < read.count() < 60
    live.apply({"work": one}, 1)
    assert live.store.read("unit", [1]).count() == 1
    tasks = spark.createDataFrame([("t", "ALL", "AUDITING", 1)], "task_id string, mode string, status string, material_documents int")
    row = live.progress(tasks).first()
    assert (row.total_work, row.completed_work, row.processed_units, row.pending_requirement_first_pass) == (200, 1, 1, 199)
    assert live.progress(tasks.withColumn("x", F.lit(1))).count() == 1
