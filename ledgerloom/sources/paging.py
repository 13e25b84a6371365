"""Paged sources: a pager with cursor checks on the driver, integrity checks as data, and a Spark data source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRANSIENT = (408, 429, 502, 503, 504)
PAGE_DEFAULT, PAGE_MAX = 50, 100


class PageError(ValueError):
    """A page that breaks the contract; the whole read is void."""


class RemoteError(RuntimeError):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def with_retry(call: Callable[[], dict], attempts: int = 3, pause: float = 0.0) -> dict:
    """Repeats a call after a timeout, a lost connection or a passing status; other errors go through."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except (TimeoutError, ConnectionError, RemoteError) as e:
            if n == attempts or isinstance(e, RemoteError) and e.status not in TRANSIENT:
                raise
            time.sleep(pause)
    raise AssertionError


def by_cursor(fetch: Callable[[str | None], dict]) -> Iterator[dict]:
    """Items of all pages {data, has_more, next_cursor}; an empty page with more, or a cursor missing or seen, is an error."""
    cursor, seen = None, set()
    while True:
        page = fetch(cursor)
        if page.get("success") is False:
            raise PageError("the page reports failure")
        yield from page["data"]
        if not page.get("has_more"):
            return
        cursor = page.get("next_cursor")
        if not page["data"] or not cursor or cursor in seen:
            raise PageError("more is announced without rows, or without a new cursor")
        seen.add(cursor)


def by_number(fetch: Callable[[int], dict]) -> Iterator[dict]:
    """Items of pages 1, 2, ... {data, total} up to the total; an empty page before it is an error."""
    n, number = 0, 1
    while True:
        page = fetch(number)
        if n < page["total"] and not page["data"]:
            raise PageError("an empty page before the total")
        yield from page["data"]
        n, number = n + len(page["data"]), number + 1
        if n >= page["total"]:
            return


def unit_violations(pages: DataFrame) -> DataFrame:
    """(rule, key, detail) for documents read as pages (document_id, page, knowledge_id, total_units, complete, units).

    The id and total are the same on every page, unit ids are unique, ordinals run from 1 to the total in
    the order of (chunk_index, unit_id), and only the last page is complete.
    """
    head = pages.groupBy("document_id").agg(
        F.countDistinct("knowledge_id").alias("ids"),
        F.min("knowledge_id").alias("id"),
        F.countDistinct("total_units").alias("totals"),
        F.max("total_units").alias("total"),
        F.count_if("complete").alias("ends"),
        F.max_by("complete", "page").alias("last"),
    )
    units = pages.select("document_id", "page", F.posexplode("units").alias("at", "u")).select("document_id", "page", "at", "u.*")
    order = Window.partitionBy("document_id").orderBy("page", "at")
    seen = units.withColumns({"place": F.row_number().over(order), "before": F.lag(F.struct("chunk_index", "unit_id")).over(order)})
    per = seen.groupBy("document_id").agg(
        F.count("*").alias("n"),
        F.countDistinct("unit_id").alias("distinct"),
        F.count_if(F.col("ordinal") != F.col("place")).alias("gaps"),
        F.count_if(F.col("before") >= F.struct("chunk_index", "unit_id")).alias("disorder"),
    )
    both = head.join(per, "document_id", "left").fillna(0, ["n", "distinct", "gaps", "disorder"])
    rules = {
        "same id": (F.col("ids") != 1) | (F.col("id") != F.col("document_id")),
        "same total": F.col("totals") != 1,
        "unique units": F.col("n") != F.col("distinct"),
        "ordinals": F.col("gaps") > 0,
        "order": F.col("disorder") > 0,
        "count": F.col("n") != F.col("total"),
        "end": (F.col("ends") != 1) | ~F.col("last"),
    }
    failed = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))
    return both.select(F.explode(failed).alias("rule"), F.col("document_id").alias("key"), F.concat(F.col("n"), F.lit(" of "), F.col("total")).alias("detail"))


class _Page(InputPartition):
    pass


class NumberedPages(DataSource):
    """Format ``numbered_pages``: a partition for each page of a source whose total is known after its first page.

    Options: ``fetch`` (module:function of (page, size)), ``size``, and the schema of the items. A task that
    runs again fetches its page again.
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_pages"

    def reader(self, schema) -> DataSourceReader:
        return _NumberedReader(self.options, schema)


class _NumberedReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.target, self.size, self.columns = options["fetch"], min(int(options.get("size", PAGE_DEFAULT)), PAGE_MAX), schema.names

    def _fetch(self, page: int) -> dict:
        import importlib

        module, _, function = self.target.partition(":")
        return with_retry(lambda: getattr(importlib.import_module(module), function)(page, self.size))

    def partitions(self) -> list[InputPartition]:
        total = self._fetch(1)["total"]
        return [_Page(n) for n in range(1, max(1, -(-total // self.size)) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = self._fetch(partition.value)
        if not page["data"] and page["total"] > (partition.value - 1) * self.size:
            raise PageError("an empty page before the total")
        for item in page["data"]:
            yield tuple(item.get(c) for c in self.columns)
