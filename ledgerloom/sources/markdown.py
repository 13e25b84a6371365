"""The strict two-table Markdown inputs. One grammar, three modes; a document is accepted whole or not at all."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Headings, headers, categories and the patterns of what a payload must not hold.
FIRST_HEADING, SECOND_HEADING = "## 需求与功能清单审查发现", "## 测试用例"
FIRST_HEADER = ["序号", "对象/功能点", "问题分类", "证据对照"]
SECOND_HEADER = ["用例名称", "功能模块", "前提约束", "执行步骤", "预期结果", "对应需求内容"]
CATEGORIES = {
    "未发现问题": "MATCHED",
    "匹配": "MATCHED",
    "功能清单遗漏": "FUNCTION_LIST_MISSING",
    "需求未覆盖该功能点": "REQUIREMENT_MISSING",
    "冲突": "CONFLICT",
    "拆分": "SPLIT",
    "合并": "MERGE",
    "重复": "DUPLICATE",
    "证据不足": "INSUFFICIENT_EVIDENCE",
}
JSON_OBJECT = re.compile(r'\{\s*(?:}|"(?:\\.|[^"\\])*"\s*:)')
JSON_ARRAY = re.compile(r'\[\s*(?:]|\{|"(?:\\.|[^"\\])*"\s*(?:,|])|(?:true|false|null|-?\d+)\s*(?:,|]))')
RAW_TAG = re.compile(r"(?i)<(?!br\s*/?>)[a-z/][^>]*>")
PIPE = re.compile(r"(?<!\\)\|")
BREAK = re.compile(r"(?i)<br\s*/?>")
SEPARATOR = re.compile(r":?-{3,}:?")
IDS = re.compile(r"(?:^|;)\s*candidateIds=([^;\s]+)")

ROW_FIELDS = {"row_position": "int", "sequence": "int", "subject": "string", "category": "string", "evidence": "string"}
CASE_FIELDS = {"row_position": "int"} | dict.fromkeys(["case_name", "feature_module", "preconditions", "execution_steps", "expected_result", "requirement_content"], "string")


class Rejected(ValueError):
    """A document that breaks the contract."""


class _Table:
    """A cursor over lines. ``lenient`` mode strips lines, unescapes pipes and reads breaks as line ends."""

    def __init__(self, text: str | None, lenient: bool):
        if text is None or not text.strip():
            raise Rejected("no text")
        head = text.strip()
        if "```" in text or head[0] in "{[":
            raise Rejected("JSON or a fence instead of tables")
        if RAW_TAG.search(text):
            raise Rejected("markup other than br")
        if lenient and ("![" in text or JSON_OBJECT.search(text) or JSON_ARRAY.search(text)):
            raise Rejected("an image or JSON")
        lines = re.split(r"\r\n|\r|\n", text)
        self.lenient = lenient
        self.lines, self.at = [x.strip() for x in lines] if lenient else lines, 0

    def blank(self) -> bool:
        return self.at < len(self.lines) and not self.lines[self.at].strip()

    def skip(self) -> None:
        while self.blank():
            self.at += 1

    def cells(self) -> list[str]:
        line = self.lines[self.at] if self.at < len(self.lines) else ""
        if len(line) < 2 or not (line.startswith("|") and line.endswith("|")):
            raise Rejected(f"line {self.at + 1} is no table row")
        parts = PIPE.split(line[1:-1]) if self.lenient and "\\" in line else line[1:-1].split("|")
        return [(BREAK.sub("\n", p.replace("\\|", "|")) if "<" in p or "\\" in p else p).strip() for p in parts] if self.lenient else [p.strip() for p in parts]

    def open(self, heading: str, header: list[str]) -> None:
        if self.at >= len(self.lines) or self.lines[self.at] != heading:
            raise Rejected(f"no heading {heading}")
        self.at += 1
        self.skip()
        if self.cells() != header:
            raise Rejected(f"another header under {heading}")
        self.at += 1
        self.skip()
        separator = self.cells()
        if len(separator) != len(header) or not all(SEPARATOR.fullmatch(c) for c in separator):
            raise Rejected("no separator row")
        self.at += 1

    def rows(self, width: int, stop: str | None = None) -> Iterator[list[str]]:
        while self.at < len(self.lines) and not self.blank() and self.lines[self.at] != stop:
            cells = self.cells()
            if len(cells) != width or self.lenient and all(SEPARATOR.fullmatch(c) for c in cells):
                raise Rejected(f"line {self.at + 1} has not {width} cells")
            if not all(cells):
                raise Rejected(f"line {self.at + 1} has an empty cell")
            self.at += 1
            yield cells


def _positive(cell: str) -> int:
    if not re.fullmatch(r"\+?\d+", cell) or not 0 < int(cell) < 2**31:
        raise Rejected(f"not a positive number: {cell}")
    return int(cell)


def parse(text: str | None, mode: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of both tables. ``generation`` needs a test case; ``scan`` and ``conclusion`` must have none."""
    t = _Table(text, mode == "generation")
    t.open(FIRST_HEADING, FIRST_HEADER)
    first = [(k, _positive(c[0]), *c[1:]) for k, c in enumerate(t.rows(4, SECOND_HEADING), 1)]
    t.skip()
    t.open(SECOND_HEADING, SECOND_HEADER)
    second = [] if mode != "generation" else [(k, *c) for k, c in enumerate(t.rows(6), 1)]
    t.skip()
    if t.at != len(t.lines):
        raise Rejected("content after the second table")
    if mode == "generation" and not second:
        raise Rejected("no test case")
    if mode == "conclusion":
        _check_conclusions(first)
    return first, second


def _check_conclusions(rows: list[tuple]) -> None:
    if len({r[1] for r in rows}) != len(rows):
        raise Rejected("a sequence given twice")
    seen: set[str] = set()
    for r in rows:
        if r[3] not in CATEGORIES:
            raise Rejected(f"unknown category {r[3]}")
        for i in ids_of(r[4]):
            if i in seen:
                raise Rejected(f"candidate {i} given twice")
            seen.add(i)


def ids_of(evidence: str) -> list[str]:
    found = IDS.findall(evidence)
    ids = found[0].split(",") if len(found) == 1 else []
    if not ids or not all(i.strip() for i in ids) or len(set(ids)) != len(ids):
        raise Rejected("not one token of distinct candidateIds")
    return ids


def conclusion_id(sequence: int, kind: str, explanation: str, evidence: str) -> str:
    parts = [str(sequence), kind, explanation, evidence, ",".join(ids_of(evidence))]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def read(df: DataFrame, mode: str, text_col: str = "markdown") -> DataFrame:
    """``df`` with audit (rows of the first table), cases (of the second) and error, null where accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audit, cases, errors = [], [], []
            for text in batch.column(text_col).to_pylist():
                try:
                    first, second = parse(text, mode)
                    error = None
                except Rejected as e:
                    first, second, error = [], [], str(e)
                audit.append(first), cases.append(second), errors.append(error)
            columns = [*batch.columns, _lists(audit, ROW_FIELDS), _lists(cases, CASE_FIELDS), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "audit", "cases", "error"])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, audit {_ddl(ROW_FIELDS)}, cases {_ddl(CASE_FIELDS)}, error string")


def _lists(tables: list[list[tuple]], fields: dict[str, str]) -> pa.ListArray:
    """Rows of each table as a list of structs, made column by column; no row becomes an object of its own."""
    ends = np.cumsum([0, *map(len, tables)], dtype=np.int32)
    columns = list(zip(*chain.from_iterable(tables), strict=True)) or [()] * len(fields)
    kinds = [pa.int32() if kind == "int" else pa.string() for kind in fields.values()]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(fields)))


def _ddl(fields: dict[str, str]) -> str:
    return f"array<struct<{','.join(f'{name}:{kind}' for name, kind in fields.items())}>>"
