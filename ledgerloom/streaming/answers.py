"""Folding event streams to answers: a batch form by ordered aggregation, and a stateful streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_CHARACTERS = 4 << 20
DATA = "response_type string, done boolean, content string, message string"


def classify(events: DataFrame, data_col: str = "data") -> DataFrame:
    """``events`` with kind (answer, complete, error, tool_call, tool_result, other) and content from JSON data."""
    d = F.from_json(data_col, DATA)
    kind = F.when(d["response_type"].isin("answer", "tool_call", "tool_result"), d["response_type"]).when((d["response_type"] == "complete") & d["done"], "complete").when((d["response_type"] == "error") & d["done"], "error").otherwise("other")
    return events.withColumn("kind", F.coalesce(kind, F.lit("other"))).withColumn("content", F.coalesce(F.when(kind == "answer", d["content"]), F.lit("")))


def fold(events: DataFrame, limit: int = MAX_CHARACTERS) -> DataFrame:
    """(stream_id, answer, status): the contents in order of seq up to the first terminal event.

    status is complete, error, unterminated or oversized. An answer is one row; events after a stream's end, and streams
    whose contents are longer than ``limit`` together, are left out before their contents meet in one row.
    """
    ends = events.where(F.col("kind").isin("complete", "error")).groupBy("stream_id").agg(F.min(F.struct("seq", "kind")).alias("end"))
    live = events.join(ends, "stream_id", "left").where("end IS NULL OR seq <= end.seq")
    sizes = live.groupBy("stream_id").agg(F.sum(F.length("content")).alias("size"), F.first("end").alias("ended"))
    small = live.join(sizes.where(F.col("size") <= limit).select("stream_id"), "stream_id", "left_semi")
    texts = small.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda e: e["content"]), "").alias("answer"))
    status = F.when(F.col("size") > limit, "oversized").otherwise(F.coalesce("ended.kind", F.lit("unterminated")))
    return sizes.join(texts, "stream_id", "left").select("stream_id", F.when(status == "complete", F.col("answer")).alias("answer"), status.alias("status"))


def fold_stream(events: DataFrame, limit: int = MAX_CHARACTERS, timeout_ms: int = 300_000) -> DataFrame:
    """The same over a stream of classified events that arrive in order: a row when a stream ends or falls silent.

    The state of a stream is its answer so far, bounded by ``limit``; when the stream ends, only that it has ended is kept,
    until the timeout. Events of a stream are ordered within a micro-batch; across batches they must arrive in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        answer, ended = state.get if state.exists else ("", False)
        if state.hasTimedOut:
            state.remove()
            if not ended:
                yield pd.DataFrame({"stream_id": [key[0]], "answer": [None], "status": ["unterminated"]})
            return
        status = None
        # a stream's events of a micro-batch may come in several Arrow batches, in any order
        for kind, content in pd.concat(batches).sort_values("seq")[["kind", "content"]].itertuples(index=False):
            if ended or status:
                break
            answer += content or ""
            status = kind if kind in ("complete", "error") else "oversized" if len(answer) > limit else None
        if status:
            state.update(("", True))
            state.setTimeoutDuration(timeout_ms)
            yield pd.DataFrame({"stream_id": [key[0]], "answer": [answer if status == "complete" else None], "status": [status]})
        elif not ended:
            state.update((answer, False))
            state.setTimeoutDuration(timeout_ms)

    return events.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, answer string, status string", "answer string, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
