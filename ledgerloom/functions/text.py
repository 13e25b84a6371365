"""Scalar text expressions: normalisation, tokens, redaction, bounds and cells. Built-in functions but for NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and their replacements, in the order in which they apply.
REDACTIONS = [
    (r"sk-[A-Za-z0-9_-]{8,}", "<redacted>"),
    (r"(?i)(api[_-]?key|token|secret|password)\s*([=:])\s*[^\s,;]+", "$1$2<redacted>"),
    (r"(?i)https?://[^\s,;]+", "<external-url>"),
    (r"[A-Za-z]:\\[^\s,;]+", "<internal-path>"),
    (r"(?<![A-Za-z0-9])/(?:[^\s,;]+/)++[^\s,;]+", "<internal-path>"),
]
REDACTED_BLANK = "External operation failed"
BREAK = r"(?i)<br\s*/?>"
MACHINE_TOKENS = [(r"(?i)(?:candidateIds|groupAnchorId|documentId|unitId)\s*=\s*[^;\r\n<]*(?:;\s*)?", ""), (r"(?:<br>|\R)\s*(?=<br>|\R|$)", "")]
_SECRET = r"(?:authorization|proxy-authorization|x-api-key|api[ _-]?key|token|secret|password)"
DIAGNOSTICS = [
    (rf"""(?i)((?:\\)?"{_SECRET}(?:\\)?"\s*:\s*(?:\\)?")(?:\\.|[^"\\])*((?:\\)?")""", "$1<credential-redacted>$2"),
    (rf"""(?i)\b({_SECRET}\s*[:=]\s*)(?:bearer\s+)?(?:"[^"]*"|'[^']*'|[^\s,;\r\n}}]+)""", "$1<credential-redacted>"),
    (r"\bsk-[A-Za-z0-9_-]{8,}", "<credential-redacted>"),
]
NUMBERED = r"^(\d+)\.\s+\S.*$"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for white space alone."""
    return c.isNull() | (strip(c) == "")


def default_if_blank(c: Column, other: Column) -> Column:
    return F.when(is_blank(c), other).otherwise(c)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, in Arrow batches; no built-in function has it. Pure ASCII passes unchanged."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normal_path(c: Column) -> Column:
    """The identity of a business path: NFKC, stripped, runs of white space as one space, lower case."""
    return _folded(nfkc(c))


def _folded(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def with_normal_path(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``normal_path`` of a column. Python sees each distinct value that is not ASCII once, and no others; its
    normal form is joined back, so that rows stay in built-in functions. Nulls stay null; a column of that name is
    replaced."""
    raw = F.col(column)
    other = F.octet_length(raw) != F.length(raw)
    known = df.where(other).select(raw.alias("_raw")).distinct().select("_raw", nfkc("_raw").alias("_nfkc"))
    joined = df.join(known, raw == F.col("_raw"), "left")
    return joined.withColumn(name, _folded(F.coalesce("_nfkc", column))).drop("_raw", "_nfkc")


def normal_path_in_rows(c: Column) -> Column:
    """``normal_path`` where the rows lie: Python sees values that are not ASCII, and nulls in place of others. A join with
    the values' forms, as in ``with_normal_path``, would deal all rows out by text."""
    return _folded(F.coalesce(nfkc(F.when(F.octet_length(c) != F.length(c), c)), c))


def contains_ignoring_case(c: Column, query: str) -> Column:
    """LIKE %query% without case; % and _ in the query stay wildcards, a blank query matches all."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.lower(c).like(f"%{q}%")


def redact(c: Column) -> Column:
    """Keys, named secrets, URLs and paths replaced; a blank message becomes a fixed one."""
    out = c
    for pattern, to in REDACTIONS:
        out = F.regexp_replace(out, pattern, to)
    return F.when(is_blank(c), F.lit(REDACTED_BLANK)).otherwise(out)


def token(c: Column, name: str, separator: str = ";") -> Column:
    """The value of ``name=value`` among separated tokens; null if it is missing, given twice or blank."""
    found = F.filter(F.transform(F.split(c, separator, -1), lambda t: strip(t)), lambda t: t.startswith(f"{name}="))
    value = F.substring(F.get(found, F.lit(0)), len(name) + 2, 1 << 30)
    return F.when((F.size(found) == 1) & (strip(value) != "") & ~value.contains("="), value)


def without_tokens(c: Column, names: list[str], separator: str = ";") -> Column:
    """The text without tokens of these names, joined again with '; '."""
    kept = F.filter(F.transform(F.split(c, separator, -1), lambda t: strip(t)), lambda t: (t != "") & ~t.rlike(f"^({'|'.join(names)})="))
    return F.array_join(kept, "; ")


def rebind(c: Column, document_id: Column, unit_id: Column) -> Column:
    """Evidence with its coordinate tokens replaced by those given, which come first."""
    rest = without_tokens(c, ["documentId", "unitId"])
    return F.concat_ws("; ", F.concat(F.lit("documentId="), document_id), F.concat(F.lit("unitId="), unit_id), F.when(rest != "", rest))


def coordinates_are(c: Column, document_id: Column, unit_id: Column) -> Column:
    """Whether both coordinate tokens are given exactly once, well formed, with these values."""
    tokens = F.filter(F.transform(F.split(c, ";", -1), lambda t: F.trim(t)), lambda t: t.contains("documentId") | t.contains("unitId"))
    exact = lambda n, v: F.size(F.filter(tokens, lambda t: t == F.concat(F.lit(f"{n}="), v))) == 1
    well_formed = F.forall(tokens, lambda t: t.rlike(r"^(documentId|unitId)=[^;\s=]+$"))
    return well_formed & (F.size(tokens) == 2) & exact("documentId", document_id) & exact("unitId", unit_id)


def candidate_ids(c: Column) -> Column:
    """Ids of the one ``candidateIds=a,b`` token; null unless they are given once, nonblank and distinct."""
    found = F.regexp_extract_all(c, F.lit(r"(?:^|;)\s*candidateIds=([^;\s]+)"), F.lit(1))
    ids = F.split(F.get(found, F.lit(0)), ",", -1)
    good = (F.size(found) == 1) & F.forall(ids, lambda x: strip(x) != "") & (F.size(F.array_distinct(ids)) == F.size(ids))
    return F.when(good, ids)


def one_line(c: Column) -> Column:
    return F.translate(c, "\r\n|", "  ¦")


def breaks_to_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, BREAK, "\n"))


def leaf(c: Column) -> Column:
    """What follows the last slash of a path, stripped."""
    return strip(F.substring_index(c, "/", -1))


def guard_formula(c: Column) -> Column:
    """A spreadsheet cell that would start a formula, with an apostrophe before it."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def numbers_of(c: Column) -> Column:
    """The numbers of lines ``1. text``; null where a line is blank or has none."""
    lines = F.transform(F.split(strip(c), r"\r\n|\r|\n", -1), lambda x: strip(x))
    return F.when(F.forall(lines, lambda x: x.rlike(NUMBERED)), F.transform(lines, lambda x: F.regexp_extract(x, NUMBERED, 1).cast("int")))


def numbered_from_one(c: Column) -> Column:
    n = numbers_of(c)
    return F.coalesce(n == F.sequence(F.lit(1), F.size(n)), F.lit(False))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def length_prefixed(c: Column) -> Column:
    """``length:text``, or ``-1:`` for null."""
    return F.coalesce(F.concat(utf16_length(c).cast("string"), F.lit(":"), c), F.lit("-1:"))


def within_bounds(c: Column, points: int = 128, octets: int = 16_384) -> Column:
    return (F.length(c) <= points) & (F.octet_length(c) <= octets)


def markdown_cells(row: Column) -> Column:
    """Cells of a table row, escaped pipes unescaped and breaks as line ends; null if it is no row."""
    inner = F.regexp_replace(strip(row), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda x: breaks_to_lines(F.replace(x, F.lit("\\|"), F.lit("|"))))
    return F.when(strip(row).rlike(r"(?s)^\|.*\|$") & (F.length(strip(row)) > 1), cells)


def is_separator(cell: Column) -> Column:
    return cell.rlike("^:?-{3,}:?$")


def _each(c: Column, patterns: list[tuple[str, str]]) -> Column:
    for pattern, to in patterns:
        c = F.regexp_replace(c, pattern, to)
    return c


def without_machine_tokens(c: Column) -> Column:
    """What readers see of evidence: binding tokens and the empty lines that they leave are gone; null is empty."""
    return F.coalesce(strip(_each(c, MACHINE_TOKENS)), F.lit(""))


def sanitize(c: Column) -> Column:
    """Credentials in diagnostics replaced, quoted in JSON, inline and raw ones; null is empty."""
    return F.coalesce(_each(c, DIAGNOSTICS), F.lit(""))


def has_coordinate_pair(c: Column, document_id: Column, unit_id: Column) -> Column:
    """Whether some documentId token with this value is followed at once by the unitId token with this value."""
    tokens = F.transform(F.split(c, ";", -1), lambda t: F.regexp_replace(t, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    pair = F.zip_with(tokens, F.slice(tokens, 2, F.size(tokens)), lambda a, b: (a == F.concat(F.lit("documentId="), document_id)) & (b == F.concat(F.lit("unitId="), unit_id)))
    return F.array_contains(pair, True)


def first_text(json: Column, *paths: str) -> Column:
    """The first of the fields that is a string with more than white space; numbers and objects are no strings."""
    v = F.try_parse_json(json)
    each = [F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string")) for p in paths]
    return F.coalesce(*(F.when(~is_blank(x), x) for x in each))


def one_or_many(json: Column, *names: str) -> Column:
    """An array field of a JSON object that older texts give as a single value, or under another name; the first name counts."""
    each = [F.get_json_object(json, f"$.{n}") for n in names]
    return F.coalesce(*(F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.isNotNull(), F.array(x)) for x in each))


def left_utf16(c: Column, units: int) -> Column:
    """The longest beginning of whole characters of at most so many UTF-16 units."""
    step = lambda a, x: F.struct((a["n"] + F.when(F.octet_length(x) > 3, 2).otherwise(1)).alias("n"), F.when(a["n"] + F.when(F.octet_length(x) > 3, 2).otherwise(1) <= units, a["k"] + 1).otherwise(a["k"]).alias("k"))
    k = F.aggregate(F.split(F.left(c, F.lit(units)), ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), step)["k"]
    return F.when(utf16_length(c) <= units, c).otherwise(F.left(c, k))


def template(text: str, **values: Column) -> Column:
    """The text with each {name} replaced by its value; a null value is empty."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def notes_only(lines: Column) -> Column:
    """Whether lines after a table are plain notes: no heading, table or JSON among them."""
    return ~F.exists(lines, lambda x: (strip(x) != "") & (x.startswith("#") | x.startswith("|") | x.endswith("|") | x.startswith("{") | x.startswith("[")))


def positive_integer(c: Column) -> Column:
    """The number that the text states; null unless it is digits alone and 1 or more."""
    n = F.when(c.rlike("^[0-9]{1,10}$"), c.cast("bigint"))
    return F.when((n > 0) & (n <= 2147483647), n.cast("int"))
