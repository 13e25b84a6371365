"""The book of slots and leases by hand, batch against a plain simulation, and a stream that is stopped and started again."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L
from ledgerloom.streaming import leases as S
from ledgerloom.streaming.calls import use_state_store

EVENT = "pool string, task_id string, kind string, ms long"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT).select("pool", "task_id", "kind", F.timestamp_millis("ms").alias("at"))


def log(df):
    return sorted(tuple(r) for r in df.select("pool", "task_id", "change", "slot", "attempt", F.unix_millis("at")).collect())


def test_by_hand(spark):
    rows = [("p", "b", "queued", 1), ("p", "a", "queued", 1), ("p", "c", "queued", 2), ("p", "a", "done", 5), ("p", "x", "done", 5), ("p", "b", "beat", 8), ("p", "c", "failed", 9), ("p", "b", "broken", 10)]
    got = log(S.lease_log(events(spark, rows), slots=1, lease_ms=10, max_attempts=2))
    assert got == sorted([
        ("p", "a", "claimed", 1, 1, 1), ("p", "a", "completed", 1, 1, 5), ("p", "x", "ignored", None, None, 5), ("p", "b", "claimed", 1, 1, 5), ("p", "c", "ignored", None, None, 9),
        ("p", "b", "failed", 1, 1, 10), ("p", "c", "claimed", 1, 1, 10), ("p", "c", "requeued", 1, 1, 21), ("p", "c", "claimed", 1, 2, 21), ("p", "c", "failed", 1, 2, 32)])
    assert S.lease_log(events(spark, rows).limit(0)).count() == 0


def simulate(rows, slots, lease, most, until):
    """Moment by moment, every millisecond."""
    out = []
    for pool in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == pool]
        queue, held = [], {}
        for now in range(until + 1):
            for s in sorted(held):
                task, created, n, end = held[s]
                if end < now:
                    del held[s]
                    out.append((pool, task, "requeued" if n < most else "failed", s, n, now))
                    queue += [(created, task, n)] if n < most else []
            for _, task, kind, _ in sorted((r for r in own if r[3] == now), key=lambda r: (S.KINDS.index(r[2]), r[1])):
                s = next((s for s in held if held[s][0] == task), None)
                if kind == "queued":
                    queue.append((now, task, 0))
                elif s is None:
                    out.append((pool, task, "ignored", None, None, now))
                elif kind == "beat":
                    held[s] = (*held[s][:3], now + lease)
                else:
                    _, created, n, _ = held.pop(s)
                    again = kind == "failed" and n < most
                    out.append((pool, task, "completed" if kind == "done" else "requeued" if again else "failed", s, n, now))
                    queue += [(created, task, n)] if again else []
            for s in range(1, slots + 1):
                if s not in held and queue:
                    queue.sort()
                    created, task, n = queue.pop(0)
                    held[s] = (task, created, n + 1, now + lease)
                    out.append((pool, task, "claimed", s, n + 1, now))
    return sorted(out, key=str)


def random_rows(seed, pools=6, n=60, span=300):
    r = random.Random(seed)
    rows = []
    for p in range(pools):
        for k in range(n):
            rows.append((f"p{p}", f"t{k}", "queued", r.randrange(span)))
            rows += [(f"p{p}", f"t{r.randrange(n)}", r.choice(["done", "failed", "beat", "broken"]), r.randrange(span)) for _ in range(6)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("slots", "lease"), [(1, 7), (5, 20)])
def test_batch_equals_simulation(spark, slots, lease):
    rows = random_rows(slots)
    got = log(S.lease_log(events(spark, rows), until=400, slots=slots, lease_ms=lease))
    assert sorted(got, key=str) == simulate(rows, slots, lease, 3, 400)


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    """Stopped in mid-stream and started again from the checkpoint, the stream tells what an undisturbed one and the batch
    form tell; what is left running is recovered as by the batch rule for leases."""
    use_state_store(spark)
    rows = random_rows(3, pools=3, n=12, span=200)
    for k in range(4):
        events(spark, rows[k::4]).coalesce(1).write.parquet(f"{tmp_path}/all/{k}")
    for k in (5, 6):  # later moments, which move the watermark on
        events(spark, [(f"end{k}", "t", "queued", k * 3_600_000)]).coalesce(1).write.parquet(f"{tmp_path}/all/{k}")
    (tmp_path / "in").mkdir()

    def run(part):
        for k in part:
            (tmp_path / "all" / str(k)).rename(tmp_path / "in" / str(k))
        stream = spark.readStream.schema("pool string, task_id string, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = S.lease_stream(stream, late="1 hour", slots=2, lease_ms=15).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    run([0, 1])
    run([2, 3, 5, 6])
    got = log(spark.read.parquet(f"{tmp_path}/out").where("NOT startswith(pool, 'end')"))
    assert got == log(S.lease_log(events(spark, rows), slots=2, lease_ms=15))
    # the state at one moment, from the log: leases that are over then go back or fail, as the batch rule says
    moment = 150
    before = [x for x in log(S.lease_log(events(spark, rows), until=moment, slots=2, lease_ms=10_000))]
    running = {}
    for pool, task, change, slot, attempt, at in sorted(before, key=lambda x: (x[5], x[2] == "claimed")):
        if change == "claimed":
            running[pool, slot] = (pool, task, attempt)
        elif slot is not None:
            running.pop((pool, slot), None)
    work = spark.createDataFrame([(p, t, "RUNNING", a, 1, True) for p, t, a in running.values()], "pool string, task_id string, status string, attempts int, lease_expires_at long, retryable boolean")
    after = {(r.pool, r.task_id): r.status for r in L.after_lease(work, F.lit(2)).collect()}
    for pool, task, attempt in running.values():
        book = S.Book(2, 10, 3, held={1: (task, 0, attempt, 1)})
        book.slots = 0  # nothing is claimed again
        book.step(2, [])
        assert book.drain()[0][1] == {"QUEUED": "requeued", "FAILED": "failed"}[after[pool, task]]
