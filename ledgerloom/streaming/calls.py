"""Answers of event streams with their tool calls: raw frames, classification, a batch fold, and a stateful streaming fold.

Events of a stream are numbered from 1. An event counts once all before it are there; a number that is delivered again is
the same event. A stream ends at its first event that is complete or refused, at a second call, or where its contents
outgrow the limit. Batch and streaming forms give the same row for a stream, whatever the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Tools, and the fields that may hold a call's id and a skill's name.
READ_TOOL, ALLOWED_TOOLS = "read_skill", ["read_skill", "execute_skill_script"]
CALL_ID_FIELDS, NESTED_FIELDS = ["tool_call_id", "call_id", "id"], ["arguments", "args", "input"]

#: kinds of events that refuse the stream
REFUSED = ["not a message", "oversized event", "not json", "no type", "error", "forbidden tool", "unidentified call", "other skill", "failed result"]
EVENT = "response_type string, done boolean, content string, message string, data string, _corrupt string"
OUTPUT = "stream_id string, answer string, status string, open_declarations long, open_calls long, unknown_results long"
MAX_CHARACTERS = 4 << 20


def frames(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(stream_id, seq, event, data) of raw server-sent event texts: a blank line ends an event, lines of data are joined
    by a line feed, an event without a name is a message, lines of other fields and comments go. Null bodies have none."""
    text = F.regexp_replace(F.col(body), "\r\n|\r", "\n")
    parts = bodies.select("stream_id", F.filter(F.split(text, "\n\n+"), lambda p: F.regexp_like(p, F.lit(r"(?m)^data:"))).alias("_parts"))
    each = parts.select("stream_id", F.posexplode("_parts").alias("_at", "_part"))
    lines = F.filter(F.split("_part", "\n"), lambda x: x.startswith("data:"))
    name = F.regexp_extract("_part", r"(?m)^event: ?(.*)$", 1)
    return each.select(
        "stream_id",
        (F.col("_at") + 1).cast("long").alias("seq"),
        F.when(name == "", "message").otherwise(name).alias("event"),
        F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n").alias("data"),
    )


def _given(text: Column, fields: list[str], prefix: str = "$") -> Column:
    """The first of the fields that is there and not blank."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in (F.get_json_object(text, f"{prefix}.{f}") for f in fields)))


def classify(events: DataFrame, *, skill: str, max_characters: int = MAX_CHARACTERS, preparation: bool = False, event: str = "event", data: str = "data") -> DataFrame:
    """The events with ``kind``, ``content``, ``call_id`` and ``success`` in place of name and data.

    kind is answer, declared, call, result, complete, other, or one of REFUSED. An event over ``max_characters`` is
    refused by its length and not read. Values that should be texts count as their JSON texts. In a ``preparation`` only
    the read tool and the skill itself are allowed, and any error or failed result refuses.
    """
    d = F.from_json(F.when(F.length(data) <= max_characters, F.col(data)), EVENT, {"columnNameOfCorruptRecord": "_corrupt"})
    inner = d["data"]
    tool, call_id = _given(inner, ["tool_name"]), _given(inner, CALL_ID_FIELDS)
    named = F.coalesce(_given(inner, ["skill_name"]), *(_given(inner, ["skill_name"], f"$.{n}") for n in NESTED_FIELDS))
    success = F.get_json_object(inner, "$.success")
    kind_of, done = d["response_type"], F.coalesce(d["done"], F.lit(False))
    allowed = [READ_TOOL] if preparation else ALLOWED_TOOLS
    call = (
        F.when(~F.coalesce(tool, F.lit("")).isin(allowed), "forbidden tool")
        .when(tool != READ_TOOL, "other")
        .when(named.isNull() & call_id.isNotNull(), "declared")
        .when(named != skill, "other skill")
        .when(call_id.isNull(), "unidentified call")
        .otherwise("call")
    )
    result = F.when(tool.isNotNull() & ~tool.isin(allowed), "forbidden tool")
    if preparation:
        result = result.when(named != skill, "other skill").when(success == "false", "failed result")
    result = result.when(call_id.isNotNull() & F.coalesce(named == skill, F.lit(True)), "result").otherwise("other")
    kind = (
        F.when(~F.col(event).eqNullSafe("message"), "not a message")
        .when(F.coalesce(F.length(data) > max_characters, F.lit(True)), "oversized event")
        .when(d["_corrupt"].isNotNull() | d.isNull(), "not json")
        .when(F.coalesce(F.trim(kind_of), F.lit("")) == "", "no type")
        .when((kind_of == "error") & (done | F.lit(preparation)), "error")
        .when(kind_of == "tool_call", call)
        .when(kind_of == "tool_result", result)
        .when(kind_of == "answer", "answer")
        .when((kind_of == "complete") & done, "complete")
        .otherwise("other")
    )
    kept = [c for c in events.columns if c not in (event, data, "kind", "content", "call_id", "success")]
    return events.select(
        *kept,
        kind.alias("kind"),
        F.coalesce(F.when(kind == "answer", d["content"]), F.lit("")).alias("content"),
        F.when(kind.isin("declared", "call", "result"), call_id).alias("call_id"),
        F.coalesce((kind == "result") & (success == "true"), F.lit(False)).alias("success"),
    )


def _status(evidence: bool, open_declarations, open_calls, succeeded, failed):
    """Status of a complete stream, in Python values."""
    if not evidence:
        return "complete"
    return "open declaration" if open_declarations else "open call" if open_calls else "failed call" if failed else "complete" if succeeded else "no evidence"


def fold(events: DataFrame, *, limit: int = MAX_CHARACTERS, evidence: bool = False) -> DataFrame:
    """One row a stream: its answer if the status is complete, and what is open at its end.

    status is complete; with ``evidence`` otherwise open declaration, open call, failed call or no evidence; the kind of
    the event that refused it; repeated call; oversized answer; torn if events after a missing one are all that is left,
    or unterminated. Results that answer no open call are unknown. Counts are null for streams that are not complete.
    Only answers within ``limit`` meet in one row; all else is counted along the stream or aggregated by parts.
    """
    stream = Window.partitionBy("stream_id")
    order = stream.orderBy("seq", "kind", "content", "call_id", "success")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows are dealt out and sorted once; of equal numbers the least event counts, as long as each number so far is there
    rows = events.select("stream_id", "seq", "kind", "content", "call_id", "success")
    rows = rows.withColumn("_again", (F.row_number().over(order) > 1) & F.lag("seq").over(order).eqNullSafe(F.col("seq")))
    rows = rows.withColumn("_n", F.count_if(~F.col("_again") & (F.col("seq") >= 1)).over(so_far))
    rows = rows.withColumn("_counts", F.coalesce(~F.col("_again") & (F.col("seq") >= 1) & (F.col("_n") == F.col("seq")), F.lit(False)))
    rows = rows.withColumn("_calls", F.count_if(F.col("_counts") & (F.col("kind") == "call")).over(so_far))
    ending = F.when((F.col("kind") == "call") & (F.col("_calls") > 1), "repeated call").when(F.col("kind").isin("complete", *REFUSED), F.col("kind"))
    rows = rows.withColumn("_end", F.when(F.col("_counts"), ending))
    rows = rows.withColumn("_ends", F.count("_end").over(so_far))
    live = F.col("_counts") & (F.col("_ends") == 0)
    rows = rows.withColumns({"_live": live, "_call": F.min(F.when(live & (F.col("kind") == "call"), F.struct("seq", "call_id"))).over(stream), "_size": F.sum(F.when(live, F.length("content"))).over(stream)})
    live, result = F.col("_live"), F.col("kind") == "result"
    own = F.col("call_id") == F.col("_call.call_id")
    ids = rows.groupBy("stream_id", "call_id").agg(
        F.sum(F.when(live, F.length("content"))).alias("size"),
        F.max(F.when(live & (F.col("kind") == "declared"), F.col("seq"))).alias("declared"),
        F.count_if(live & result).alias("results"),
        F.min(F.when(live & result & own & (F.col("seq") > F.col("_call.seq")), F.struct("seq", "success"))).alias("answer"),
        F.max(F.when(live & own, F.col("_call.seq"))).alias("called"),
        F.max(F.when(F.col("_ends") == 1, F.col("_end"))).alias("_end"),
        F.max(F.when(F.col("_counts"), F.col("seq"))).alias("_reach"),
        F.max("seq").alias("_last"),
        F.collect_list(F.when(live & (F.col("content") != "") & (F.col("_size") <= limit), F.struct("seq", "content"))).alias("_parts"),
    )
    whole = ids.groupBy("stream_id").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
        F.count_if(F.expr("declared IS NOT NULL AND (called IS NULL OR declared > called)")).alias("open_declarations"),
        F.count_if(F.expr("called IS NOT NULL AND answer IS NULL")).alias("open_calls"),
        (F.sum("results") - F.count_if(F.col("answer").isNotNull())).alias("unknown_results"),
        F.coalesce(F.bool_or(F.col("answer.success")), F.lit(False)).alias("succeeded"),
        F.coalesce(F.bool_or(~F.col("answer.success")), F.lit(False)).alias("failed"),
        F.max("_end").alias("_end"),
        F.coalesce(F.max("_reach"), F.lit(0)).alias("_reach"),
        F.max("_last").alias("_last"),
        F.flatten(F.collect_list("_parts")).alias("_parts"),
    )
    complete = F.lit("complete")
    if evidence:
        complete = F.when(F.col("open_declarations") > 0, "open declaration").when(F.col("open_calls") > 0, "open call").when(F.col("failed"), "failed call").when(F.col("succeeded"), "complete").otherwise("no evidence")
    status = (
        F.when(F.col("size") > limit, "oversized answer")
        .when(F.col("_end") == "complete", complete)
        .when(F.col("_end").isNotNull(), F.col("_end"))
        .when(F.col("_last") > F.col("_reach"), "torn")
        .otherwise("unterminated")
    )
    text = F.array_join(F.transform(F.array_sort("_parts"), lambda e: e["content"]), "")
    told = (F.col("_end") == "complete") & (F.col("size") <= limit)
    counts = [F.when(told, F.col(n)).alias(n) for n in ("open_declarations", "open_calls", "unknown_results")]
    return whole.withColumn("status", status).select("stream_id", F.when(F.col("status") == "complete", text).alias("answer"), "status", *counts)


class CallFold(StatefulProcessor):
    """State of a stream: the number that comes next, size, call and its results; the parts of the answer; open
    declarations; and events that wait for earlier ones. All but the head are read by key only. A stream that falls
    silent for ``silence_ms`` of event time is told as it is; one that has ended is forgotten then."""

    def __init__(self, limit: int, evidence: bool, silence_ms: int):
        self.limit, self.evidence, self.silence_ms = limit, evidence, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next long, size long, ended boolean, call_id string, answered boolean, succeeded boolean, failed boolean, unknown long, timer long")
        self.parts = handle.getListState("parts", "content string")
        self.declared = handle.getMapState("declared", "call_id string", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "kind string, content string, call_id string, success boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        h = list(self.head.get()) if self.head.exists() else [1, 0, False, None, False, False, False, 0, 0]
        came: dict[int, tuple] = {}
        last = 0
        for r in rows:
            event = (r.kind, r.content, r.call_id, r.success)
            last = max(last, int(r.at.timestamp() * 1000))
            if not h[2] and r.seq >= h[0] and (r.seq not in came or event < came[r.seq]):
                came[r.seq] = event
        out = None
        had = not h[2] and self.waiting.exists()
        while not h[2]:
            number = h[0]
            if had and self.waiting.containsKey((number,)):
                event = self.waiting.getValue((number,))
                self.waiting.removeKey((number,))
                came.pop(number, None)
            elif number in came:
                event = came.pop(number)
            else:
                break
            h[0] = number + 1
            out = self._step(key, h, number, *event)
        if h[2]:
            for state in (self.parts, self.declared, self.waiting):
                state.clear()
        else:
            for number, event in came.items():
                if not (had and self.waiting.containsKey((number,))):
                    self.waiting.updateValue((number,), event)
        timer = max(h[8], last + self.silence_ms)
        if timer != h[8]:
            if h[8]:
                self.handle.deleteTimer(h[8])
            self.handle.registerTimer(timer)
            h[8] = timer
        self.head.update(tuple(h))
        if out is not None:
            yield out

    def _step(self, key: tuple, h: list, seq: int, kind: str, content: str, call_id: str | None, success: bool) -> Row | None:
        """Takes in one event; the stream's row if it ends."""
        if kind == "complete":
            opened = sum(1 for _ in self.declared.keys()) if self.declared.exists() else 0
            calls = int(h[3] is not None and not h[4])
            status = _status(self.evidence, opened, calls, h[5], h[6])
            answer = "".join(p[0] for p in self.parts.get()) if self.parts.exists() else ""
            h[2] = True
            return self._row(key, answer if status == "complete" else None, status, opened, calls, h[7])
        if kind in REFUSED or kind == "call" and h[3] is not None:
            h[2] = True
            return self._row(key, None, "repeated call" if kind == "call" else kind)
        if kind == "answer" and content:
            h[1] += len(content)
            if h[1] > self.limit:
                h[2] = True
                return self._row(key, None, "oversized answer")
            self.parts.appendValue((content,))
        elif kind == "declared":
            self.declared.updateValue((call_id,), (seq,))
        elif kind == "call":
            h[3] = call_id
            if self.declared.exists() and self.declared.containsKey((call_id,)):
                self.declared.removeKey((call_id,))
        elif kind == "result":
            if call_id == h[3] and not h[4]:
                h[4], h[5], h[6] = True, success, not success
            else:
                h[7] += 1
        return None

    @staticmethod
    def _row(key: tuple, answer: str | None, status: str, *counts: int) -> Row:
        declarations, calls, unknown = counts or (None, None, None)
        return Row(stream_id=key[0], answer=answer, status=status, open_declarations=declarations, open_calls=calls, unknown_results=unknown)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.head.exists():
            return
        h = self.head.get()
        torn = not h[2] and self.waiting.exists()
        for state in (self.head, self.parts, self.declared, self.waiting):
            state.clear()
        if not h[2]:
            yield self._row(key, None, "torn" if torn else "unterminated")

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, *, limit: int = MAX_CHARACTERS, evidence: bool = False, silence_ms: int = 300_000, late: str = "1 minute") -> DataFrame:
    """``fold`` over a stream of classified events with their time ``at``: a row when a stream ends, or falls silent for
    ``silence_ms`` of event time. Events later than ``late`` are dropped, as are those of a stream that was told. Needs the
    RocksDB state store (``use_state_store``)."""
    return events.withWatermark("at", late).groupBy("stream_id").transformWithState(CallFold(limit, evidence, silence_ms), OUTPUT, "Append", "EventTime")


def use_state_store(spark) -> None:
    """Sets the state store that keyed state and timers need, for streams that start afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
