"""Slots and leases as state: tasks wait in a queue, take free slots first come first served, and lose them when their
lease is over.

Pools are independent. Time is the events' own: everything that happens at a moment happens in the order leases, events,
claims, whatever the order in which events arrive. The batch form and the streaming form keep the same book.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: kinds of events in the order in which they count at one moment
KINDS = ["done", "failed", "broken", "beat", "queued"]
OUTPUT = "pool string, task_id string, change string, slot int, attempt int, at timestamp"
SLOTS, LEASE_MS, MAX_ATTEMPTS = 5, 300_000, 3


@dataclass
class Book:
    """One pool: what is in its slots, {slot: (task, created, attempt, lease's end)}; tasks that came back; the queue."""

    slots: int = SLOTS
    lease_ms: int = LEASE_MS
    max_attempts: int = MAX_ATTEMPTS
    held: dict[int, tuple[str, int, int, int]] = field(default_factory=dict)
    returned: list[tuple[int, str, int]] = field(default_factory=list)
    queue: deque = field(default_factory=deque)
    log: list[tuple] = field(default_factory=list)

    def first(self) -> tuple[int, str] | None:
        return self.queue[0] if self.queue else None

    def pop(self) -> None:
        self.queue.popleft()

    def push(self, created: int, task: str) -> None:
        self.queue.append((created, task))

    def next_end(self) -> int | None:
        """When the next lease is over: the first moment after its end."""
        return min((end + 1 for *_, end in self.held.values()), default=None)

    def _leave(self, slot: int, change: str, at: int, again: bool) -> None:
        task, created, attempt, _ = self.held.pop(slot)
        if again and attempt < self.max_attempts:
            self.returned.append((created, task, attempt))
            self.returned.sort()
            change = "requeued"
        elif again:
            change = "failed"
        self.log.append((task, change, slot, attempt, at))

    def step(self, at: int, events: list[tuple[str, str]]) -> None:
        """What happens at a moment: leases that are over, (kind, task) events, and claims of free slots."""
        for slot in sorted(s for s, (*_, end) in self.held.items() if end < at):
            self._leave(slot, "requeued", at, True)
        for kind, task in sorted(events, key=lambda e: (KINDS.index(e[0]) if e[0] in KINDS else -1, e[1])):
            slot = next((s for s, (t, *_) in self.held.items() if t == task), None)
            if kind == "queued":
                self.push(at, task)
            elif slot is None:
                self.log.append((task, "ignored", None, None, at))
            elif kind == "beat":
                t, created, attempt, _ = self.held[slot]
                self.held[slot] = (t, created, attempt, at + self.lease_ms)
            else:  # an attempt that failed comes back, a broken one does not
                self._leave(slot, {"done": "completed"}.get(kind, "failed"), at, kind == "failed")
        for slot in range(1, self.slots + 1):
            if slot in self.held:
                continue
            head, back = self.first(), self.returned[0] if self.returned else None
            if head is None and back is None:
                break
            if head is None or back is not None and back[:2] < tuple(head):
                created, task, attempt = self.returned.pop(0)
            else:
                (created, task), attempt = head, 0
                self.pop()
            self.held[slot] = (task, created, attempt + 1, at + self.lease_ms)
            self.log.append((task, "claimed", slot, attempt + 1, at))

    def advance(self, to: int | None) -> None:
        """Leases that are over before the moment ``to``."""
        while (end := self.next_end()) is not None and (to is None or end < to):
            self.step(end, [])

    def drain(self) -> list[tuple]:
        out, self.log = self.log, []
        return out


def lease_log(events: DataFrame, *, until: int | None = None, slots: int = SLOTS, lease_ms: int = LEASE_MS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(pool, task_id, change, slot, attempt, at): all changes that ``events`` (pool, task_id, kind, at) and the leases bring,
    up to the moment ``until`` in epoch milliseconds, by default till nothing is left to happen.

    Pools are dealt out and their events sorted on disk; one pool is one sequence, of which a task holds the slots and the
    queue only. Events for tasks that hold no slot, and of unknown kinds, are ignored, and said to be. Rows with a null
    pool are one pool, null times come first. Repeated events count as often as they come.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, book, moment, waiting = object(), None, None, []

        def told(rows: list[tuple]) -> pd.DataFrame:
            frame = pd.DataFrame([(pool, *r) for r in rows], columns=["pool", "task_id", "change", "slot", "attempt", "at"])
            return frame.astype({"slot": "Int32", "attempt": "Int32"}).assign(at=pd.to_datetime(frame["at"], unit="ms"))

        def close() -> list[tuple]:
            if book is None:
                return []
            if waiting:
                book.advance(moment)
                book.step(moment, waiting)
            book.advance(None if until is None else until + 1)
            return book.drain()

        for batch in batches:
            for p, task, kind, at in zip(batch["pool"], batch["task_id"], batch["kind"], batch["ms"], strict=True):
                p = None if pd.isna(p) else p
                if book is None or p != pool:
                    if rows := close():
                        yield told(rows)
                    pool, book, moment, waiting = p, Book(slots, lease_ms, max_attempts), at, []
                if at != moment:
                    book.advance(moment)
                    book.step(moment, waiting)
                    moment, waiting = at, []
                waiting.append((kind, task))
            if book is not None and (rows := book.drain()):
                yield told(rows)
        if rows := close():
            yield told(rows)

    known = events.select("pool", "task_id", "kind", F.coalesce(F.unix_millis(F.col("at").cast("timestamp")), F.lit(0)).alias("ms"))
    if until is not None:
        known = known.where(F.col("ms") <= until)
    return known.repartition("pool").sortWithinPartitions("pool", "ms").mapInPandas(run, OUTPUT)


class LeaseState(StatefulProcessor):
    """The book of a pool in keyed state. Events wait for the watermark and count at their own moments, by timers."""

    def __init__(self, slots: int, lease_ms: int, max_attempts: int):
        self.rules = (slots, lease_ms, max_attempts)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.inbox = handle.getMapState("inbox", "ms long, n long", "kind string, task_id string")
        self.counts = handle.getMapState("counts", "ms long", "n long")
        self.ends = handle.getValueState("ends", "first long, next long, clock long")
        self.waiting = handle.getMapState("waiting", "n long", "created long, task_id string")
        self.held = handle.getMapState("held", "slot int", "task_id string, created long, attempt int, lease long")
        self.returned = handle.getMapState("returned", "created long, task_id string", "attempt int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            ms = int(r.at.timestamp() * 1000)
            n = self.counts.getValue((ms,))[0] if self.counts.containsKey((ms,)) else 0
            self.inbox.updateValue((ms, n), (r.kind, r.task_id))
            self.counts.updateValue((ms,), (n + 1,))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        book = _Stored(*self.rules)
        book.waiting = self.waiting
        *book.bounds, clock = self.ends.get() if self.ends.exists() else (0, 0, -1)
        if expiredTimerInfo.getExpiryTimeInMs() <= clock:
            return
        book.held = {k[0]: tuple(v) for k, v in self.held.iterator()} if self.held.exists() else {}
        book.returned = sorted((k[0], k[1], v[0]) for k, v in self.returned.iterator()) if self.returned.exists() else []
        held, returned = dict(book.held), list(book.returned)
        # the first timer of a pool that is due takes in all moments up to the watermark: leases that begin meanwhile may
        # end before it as well, and their timers would come too late
        clock = timerValues.getCurrentWatermarkInMs()
        moments = sorted(k[0] for k in self.counts.keys() if k[0] <= clock) if self.counts.exists() else []
        for at in moments:
            events = []
            for n in range(self.counts.getValue((at,))[0]):
                events.append(tuple(self.inbox.getValue((at, n))))
                self.inbox.removeKey((at, n))
            self.counts.removeKey((at,))
            book.advance(at)
            book.step(at, events)
        book.advance(clock + 1)
        for slot in held.keys() - book.held.keys():
            self.held.removeKey((slot,))
        for slot, row in book.held.items():
            if held.get(slot) != row:
                self.held.updateValue((slot,), row)
                self.handle.registerTimer(row[3] + 1)
        for created, task, _ in set(returned) - set(book.returned):
            self.returned.removeKey((created, task))
        for created, task, attempt in set(book.returned) - set(returned):
            self.returned.updateValue((created, task), (attempt,))
        self.ends.update((*book.bounds, clock))
        for task, change, slot, attempt, when in book.drain():
            yield Row(pool=key[0], task_id=task, change=change, slot=slot, attempt=attempt, at=pd.Timestamp(when, unit="ms").to_pydatetime())

    def close(self) -> None:
        pass


class _Stored(Book):
    """A book whose queue is in keyed state, by number: only its head is read."""

    def first(self) -> tuple[int, str] | None:
        return tuple(self.waiting.getValue((self.bounds[0],))) if self.bounds[0] < self.bounds[1] else None

    def pop(self) -> None:
        self.waiting.removeKey((self.bounds[0],))
        self.bounds[0] += 1

    def push(self, created: int, task: str) -> None:
        self.waiting.updateValue((self.bounds[1],), (created, task))
        self.bounds[1] += 1


def lease_stream(events: DataFrame, *, late: str = "1 minute", slots: int = SLOTS, lease_ms: int = LEASE_MS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """``lease_log`` over a stream: a change comes out when the watermark has passed its moment. Slots, queue and leases are
    restored from the checkpoint when the query starts again. Events that are later than ``late`` are dropped."""
    return events.withWatermark("at", late).groupBy("pool").transformWithState(LeaseState(slots, lease_ms, max_attempts), OUTPUT, "Append", "EventTime")
