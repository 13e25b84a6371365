"""Durable acceptance: replays, conflicts, writers that die before their commit, and a stream that starts again."""

import pytest

from ledgerloom.sinks.accepted import AcceptedStore

ROWS = "batch_id string, attempt_id string, row_sequence int, title string"


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_units_are_accepted_once(spark, tmp_path):
    store = AcceptedStore(spark, f"{tmp_path}/t", ["batch_id"], "attempt_id", buckets=4)
    assert store.rows() is None and store.outcomes() is None
    first = spark.createDataFrame([("b1", "a2", 1, "x"), ("b1", "a1", 1, "y"), ("b1", "a1", 2, "z"), ("b1", "a1", 2, "z"), (None, "a9", 1, "n")], ROWS)
    store.accept(first, 0)
    want = [("b1", "a1", 1, "y", 0), ("b1", "a1", 2, "z", 0), (None, "a9", 1, "n", 0)]
    assert told(store.rows()) == sorted(want, key=str)
    store.accept(first, 0)  # the epoch again
    store.accept(first, 1)  # its rows again
    store.accept(spark.createDataFrame([("b1", "a3", 1, "late"), ("b2", None, 1, "new"), (None, "a0", 1, "n")], ROWS), 2)
    store.accept(first.limit(0), 3)
    assert told(store.rows()) == sorted([*want, ("b2", None, 1, "new", 2)], key=str)
    assert told(store.outcomes().where("epoch = 2")) == sorted([("b1", "a3", "replay", 2), ("b2", None, "accepted", 2), (None, "a0", "replay", 2)], key=str)
    assert store.epochs() == [0, 1, 2, 3]


def test_rows_are_replayed_or_refused(spark, tmp_path):
    store = AcceptedStore(spark, f"{tmp_path}/t", ["batch_id", "row_sequence"], buckets=4)
    store.accept(spark.createDataFrame([("b", None, 1, "x"), ("b", None, 1, "w"), ("b", "a", 2, None)], ROWS), 0)
    store.accept(spark.createDataFrame([("b", None, 1, "w"), ("b", "a", 2, "now"), ("b", "a", 3, "new")], ROWS), 1)
    assert told(store.rows()) == sorted([("b", None, 1, "w", 0), ("b", "a", 2, None, 0), ("b", "a", 3, "new", 1)], key=str)
    assert told(store.outcomes()) == sorted([("b", 1, "insert", 0), ("b", 1, "conflict", 0), ("b", 2, "insert", 0), ("b", 1, "same", 1), ("b", 2, "conflict", 1), ("b", 3, "insert", 1)], key=str)


class Dies(AcceptedStore):
    """Dies at its first commit of each epoch, after the rows are written."""

    seen: set = set()

    def commit(self, epoch):
        if epoch not in self.seen:
            self.seen.add(epoch)
            raise RuntimeError("the writer is gone")
        super().commit(epoch)


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    store = Dies(spark, f"{tmp_path}/t", ["batch_id"], "attempt_id", buckets=16)
    Dies.seen = set()
    with pytest.raises(RuntimeError):
        store.accept(spark.createDataFrame([(f"lost{k}", "a", 1, "x") for k in range(20)], ROWS), 0)
    assert store.rows() is None
    store.accept(spark.createDataFrame([("kept", "a", 1, "x")], ROWS), 0)
    assert [r.batch_id for r in store.rows().collect()] == ["kept"]


def test_a_stream_that_starts_again(spark, tmp_path):
    """Each micro-batch's first writer dies; the query is started again until it ends."""
    Dies.seen = set()
    for k in range(3):
        spark.createDataFrame([(f"b{j}", f"a{k}", 1, f"{k}") for j in range(k, k + 4)], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    store = Dies(spark, f"{tmp_path}/t", ["batch_id"], "attempt_id", buckets=4)
    failures = 0
    for _ in range(6):
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = stream.writeStream.foreachBatch(store.accept).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
            break
        except Exception:  # noqa: BLE001
            failures += 1
    assert failures == 3
    rows = store.rows().collect()
    assert sorted(r.batch_id for r in rows) == [f"b{k}" for k in range(6)]
    assert store.outcomes().count() == 12


def test_an_epoch_is_dealt_out_once(spark, tmp_path):
    """Incoming and stored rows meet by one shuffle, and the epoch's rows are told apart there."""
    store = AcceptedStore(spark, f"{tmp_path}/t", ["batch_id", "row_sequence"], buckets=4)
    rows = spark.createDataFrame([("b", None, 1, "x"), (None, "a", 2, None)], ROWS).withColumn("bucket", store.bucket(store.unit))
    marked = store._by_row(rows, rows.limit(1))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
