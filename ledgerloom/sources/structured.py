"""Strict JSON answers, and example documents with front matter."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSE_BYTES = 4 << 20
ENVELOPE = ["schema_version", "skill_name", "repair_attempted", "result"]


def envelope_error(text: str | None, fields: list[str], limit: int = RESPONSE_BYTES) -> str | None:
    """Why an answer {success, data: {...}} is refused, or None. ``fields`` are those of data.result, exactly."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        keys = [k for k, _ in pairs]
        if len(set(keys)) != len(keys):
            raise ValueError("a field given twice")
        return dict(pairs)

    if text is None or len(text.encode()) > limit:
        return "no answer, or one over the limit"
    try:
        answer = json.loads(text, object_pairs_hook=once)
    except (ValueError, RecursionError) as e:
        return f"not strict JSON: {e}"
    if not isinstance(answer, dict) or answer.get("success") is not True or not isinstance(answer.get("data"), dict):
        return "no success"
    data = answer["data"]
    if sorted(data) != sorted(ENVELOPE):
        return "other fields in data"
    if not isinstance(data["result"], dict) or sorted(data["result"]) != sorted(fields):
        return "other fields in result"
    return None


def checked(df: DataFrame, fields: list[str], text_col: str = "answer") -> DataFrame:
    """``df`` with result (JSON text of data.result, null if refused) and error. Repeated fields need a parser of our own."""

    @F.pandas_udf(T.StringType())
    def error(s: pd.Series) -> pd.Series:
        return s.map(lambda x: envelope_error(x, fields))

    out = df.withColumn("error", error(text_col))
    return out.withColumn("result", F.when(F.col("error").isNull(), F.get_json_object(text_col, "$.data.result")))


def front_matter(text: Column) -> Column:
    """The ``key: value`` lines between the first two lines of three hyphens, as a map; null without them."""
    block = F.regexp_extract(text, r"(?s)^---\R(.*?)\R---(?:\R|$)", 1)
    lines = F.filter(F.split(block, r"\R"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    return F.when(block != "", F.map_from_entries(pairs))


def section(text: Column, heading: str) -> Column:
    """What stands below ``## heading`` up to the next heading of that level; null without it."""
    found = F.regexp_extract_all(text, F.lit(rf"(?ms)^## {heading}[ \t]*$\R?(.*?)(?=^## |\z)"), F.lit(1))
    return F.trim(F.get(found, F.lit(0)))
