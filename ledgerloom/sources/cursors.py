"""Paged remote sources as Spark data sources and as a column of ids: rules are checked while reading, and a source that
breaks one fails the read with the rule's name.

Documents are read page by page along their cursors, one document after another within a task and many tasks at once. In a
stream the offset holds all that the rules need, so that a query goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ledgerloom.sources.paging import PAGE_DEFAULT, PAGE_MAX, TRANSIENT, PageError, RemoteError

UNITS = "document_id string, unit_id string, chunk_index int, ordinal int, content string, start_at long, end_at long"
FIELDS = ["unit_id", "chunk_index", "ordinal", "content", "start_at", "end_at"]
#: pages of one document or list at most
MAX_PAGES = 100_000


class RuleError(PageError):
    """A broken rule; ``rule`` names it."""

    def __init__(self, rule: str, detail: object = ""):
        super().__init__(f"{rule}: {detail}" if detail != "" else rule)
        self.rule = rule


class Caller:
    """Repeats calls that fail in passing, with growing pauses, within a deadline for one call's all attempts."""

    def __init__(self, call: Callable, *, attempts: int = 3, pause: float = 0.1, most: float = 5.0, deadline: float = 300.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.call, self.attempts, self.pause, self.most, self.deadline, self.sleep, self.clock = call, attempts, pause, most, deadline, sleep, clock

    def __call__(self, *args: object) -> dict:
        began = self.clock()
        for n in range(1, self.attempts + 1):
            try:
                return self.call(*args)
            except (TimeoutError, ConnectionError, RemoteError) as e:
                if isinstance(e, RemoteError) and e.status not in TRANSIENT:
                    raise
                if n == self.attempts:
                    raise RuleError("attempts", f"{n}, then {e!r}") from e
                wait = min(self.pause * 2 ** (n - 1), self.most) * (0.5 + random.random() / 2)
                if self.clock() - began + wait > self.deadline:
                    raise RuleError("deadline", f"{self.deadline} s, then {e!r}") from e
                self.sleep(wait)
        raise AssertionError


def _caller(options: dict) -> Caller:
    module, _, function = options["fetch"].partition(":")
    call = getattr(importlib.import_module(module), function)
    return Caller(call, attempts=int(options.get("attempts", 3)), pause=float(options.get("pause", 0.1)), deadline=float(options.get("deadline", 300)))


# ---- units of documents ----------------------------------------------------------------------------------------------


class UnitRules:
    """The rules for one document's pages {knowledge_id, total_units, units, next_cursor, complete}. All that has to be
    known from page to page is in ``state``, which JSON can hold; ids and cursors that were seen are in two sets besides."""

    def __init__(self, document: str, state: dict | None = None):
        self.document = document
        self.state = state or {"cursor": None, "ordinal": 1, "total": None, "last": None, "pages": 0, "done": False}
        self.units: set[bytes] = set()
        self.cursors: set[str] = set()

    def page(self, page: dict, max_pages: int = MAX_PAGES) -> list[tuple]:
        """The rows of the next page; the state after it."""
        s = dict(self.state)
        s["pages"] += 1
        if s["pages"] > max_pages:
            raise RuleError("page cap", max_pages)
        if page.get("knowledge_id") != self.document:
            raise RuleError("same id", page.get("knowledge_id"))
        total, units, cursor, complete = page.get("total_units"), page.get("units"), page.get("next_cursor"), bool(page.get("complete"))
        if not isinstance(total, int) or total < 0:
            raise RuleError("total", total)
        if s["total"] is not None and total != s["total"]:
            raise RuleError("same total", f"{s['total']}, then {total}")
        if units is None:
            raise RuleError("units")
        if cursor is not None and not cursor.strip():
            raise RuleError("blank cursor")
        if complete and cursor is not None:
            raise RuleError("end", "a complete page has a cursor")
        if not complete and cursor is None:
            raise RuleError("missing cursor")
        if not units and cursor is not None:
            raise RuleError("no progress")
        rows = []
        for u in units:
            if not u or not (u.get("unit_id") or "").strip() or u.get("content") is None:
                raise RuleError("whole units", u)
            key = hashlib.blake2b(u["unit_id"].encode(), digest_size=16).digest()
            if key in self.units:
                raise RuleError("unique units", u["unit_id"])
            self.units.add(key)
            if u.get("ordinal") != s["ordinal"]:
                raise RuleError("ordinals", f"{u.get('ordinal')} in place of {s['ordinal']}")
            place = [u.get("chunk_index"), u["unit_id"]]
            if s["last"] is not None and place <= s["last"]:
                raise RuleError("order", place)
            s["last"], s["ordinal"] = place, s["ordinal"] + 1
            rows.append((self.document, *(u.get(f) for f in FIELDS)))
        if cursor is None and s["ordinal"] - 1 != total:
            raise RuleError("count", f"{s['ordinal'] - 1} of {total}")
        if cursor is not None and cursor in self.cursors:
            raise RuleError("cursor loop", cursor)
        self.cursors.add(cursor)
        s.update(cursor=cursor, total=total, done=cursor is None)
        self.state = s
        return rows


def _fetch(call: Caller, *args: object) -> dict | None:
    """One answer; None where the remote says that there is no such thing."""
    try:
        page = call(*args)
    except RemoteError as e:
        if e.status == 404:
            return None
        raise
    if page.get("success") is False:
        raise RuleError("success")
    return page


def scan(document: str, call: Caller, size: int = PAGE_DEFAULT, max_pages: int = MAX_PAGES) -> Iterator[tuple]:
    """All units of a document, in order; none for a document that is not there."""
    rules = UnitRules(document)
    while not rules.state["done"]:
        page = _fetch(call, document, rules.state["cursor"], size)
        if page is None:
            if rules.state["pages"]:
                raise RuleError("vanished", document)
            return
        yield from rules.page(page, max_pages)


def units_of(documents: DataFrame, fetch: str, *, document_id: str = "document_id", size: int = PAGE_DEFAULT, **options: object) -> DataFrame:
    """The units of every document of a table, whose ids are dealt out over tasks: for more documents than an option can
    name. Null ids and documents that are not there (404) have no units; ids that repeat are read once. Any broken rule
    fails the job with its name; a task that runs again reads its documents again."""
    settings = {"fetch": fetch, **{k: str(v) for k, v in options.items()}}
    limit, most = min(size, PAGE_MAX), int(settings.get("max_pages", MAX_PAGES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _caller(settings)
        names = ["document_id", *FIELDS]
        for batch in batches:
            for document in batch["document_id"]:
                rows = []
                for row in scan(document, call, limit, most):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    ids = documents.selectExpr(f"CAST(`{document_id}` AS STRING) AS document_id").where("document_id IS NOT NULL").distinct()
    return ids.mapInPandas(run, UNITS)


# ---- lists -----------------------------------------------------------------------------------------------------------


def listed(call: Caller, size: int = PAGE_DEFAULT, max_pages: int = MAX_PAGES) -> Iterator[dict]:
    """Items of a list that a cursor leads through, {data, has_more, next_cursor}."""
    cursor, seen, pages = None, set(), 0
    while True:
        page, pages = _fetch(call, cursor, size), pages + 1
        if page is None:
            return
        if pages > max_pages:
            raise RuleError("page cap", max_pages)
        if not isinstance(page.get("data"), list):
            raise RuleError("array")
        yield from page["data"]
        if not page.get("has_more"):
            return
        cursor = page.get("next_cursor")
        if not page["data"]:
            raise RuleError("no progress")
        if not cursor:
            raise RuleError("missing cursor")
        if cursor in seen:
            raise RuleError("cursor loop", cursor)
        seen.add(cursor)


def single(call: Caller, *args: object) -> Iterator[dict]:
    """The one object of an answer {data}; none where it is not there."""
    page = _fetch(call, *args)
    if page is not None:
        if not isinstance(page.get("data"), dict):
            raise RuleError("object")
        yield page["data"]


def unpaged(call: Caller, *args: object) -> Iterator[dict]:
    """All items of an answer {data} without pages."""
    page = _fetch(call, *args)
    if page is not None:
        if not isinstance(page.get("data"), list):
            raise RuleError("array")
        yield from page["data"]


# ---- data sources ----------------------------------------------------------------------------------------------------


class _Part(InputPartition):
    pass


class CursorPages(DataSource):
    """Format ``cursor_pages``. Options: ``fetch`` (module:function), ``kind``, ``size`` (50, at most 100), ``max_pages``,
    ``attempts``, ``pause`` and ``deadline`` (seconds).

    kind ``units`` reads the units of ``documents`` (a JSON list of ids), a partition for each; fetch takes (document,
    cursor, size). kind ``list`` reads a list along its cursor; fetch takes (cursor, size). kinds ``object`` and ``array``
    read one answer for each of ``keys`` (a JSON list), fetch takes the key. Where there is nothing (404) there is no row.
    As a stream, kind ``units`` reads a page of each unfinished document at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        if self.options.get("kind", "units") != "units":
            raise ValueError("lists and objects need a schema")
        return UNITS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.columns = dict(options), schema.names
        self.kind, self.size = options.get("kind", "units"), min(int(options.get("size", PAGE_DEFAULT)), PAGE_MAX)

    def partitions(self) -> list[InputPartition]:
        if self.kind == "list":
            return [_Part(None)]
        return [_Part(k) for k in json.loads(self.options["documents" if self.kind == "units" else "keys"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        call, most = _caller(self.options), int(self.options.get("max_pages", MAX_PAGES))
        if self.kind == "units":
            yield from scan(partition.value, call, self.size, most)
            return
        items = listed(call, self.size, most) if self.kind == "list" else {"object": single, "array": unpaged}[self.kind](call, partition.value)
        for item in items:
            yield tuple(item.get(x) for x in self.columns)


class _StreamReader(SimpleDataSourceStreamReader):
    """Offsets are the documents' states. A page is fetched once in the run of things, and again when a batch is repeated;
    ids and cursors of earlier runs are not held, but ordinals and the order of units still have to go on."""

    def __init__(self, options: dict):
        self.options, self.documents = dict(options), json.loads(options["documents"])
        self.size, self.most = min(int(options.get("size", PAGE_DEFAULT)), PAGE_MAX), int(options.get("max_pages", MAX_PAGES))
        self.rules: dict[str, UnitRules] = {}

    def initialOffset(self) -> dict:
        return {}

    def _next(self, document: str, state: dict | None) -> tuple[list[tuple], dict]:
        rules = self.rules.get(document)
        if rules is None or rules.state != (state or UnitRules(document).state):
            rules = self.rules[document] = UnitRules(document, dict(state) if state else None)
        page = _fetch(_caller(self.options), document, rules.state["cursor"], self.size)
        if page is None:
            if rules.state["pages"]:
                raise RuleError("vanished", document)
            rules.state = {**rules.state, "done": True}
            return [], rules.state
        return rules.page(page, self.most), rules.state

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for document in self.documents:
            if not (state := start.get(document)) or not state["done"]:
                more, end[document] = self._next(document, state)
                rows += more
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = []
        for document in self.documents:
            state = start.get(document)
            while document in end and (state or {}).get("pages", 0) < end[document]["pages"]:
                more, state = self._next(document, state)
                rows += more
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass
