"""Queries of contracts: readers of Markdown and pages, cells and tokens, and the validators of structured results, each
over texts and rows made from the driver's tables, with DuckDB SQL that tells the outcome from the tables alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import ledger_queries as Q
from ledgerloom.functions import text as X
from ledgerloom.operators import ledger as L
from ledgerloom.plans import review as R
from ledgerloom.plans import scope as S
from ledgerloom.plans import validators as V
from ledgerloom.sources import markdown as M
from ledgerloom.sources import paging as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
big = lambda x: x.cast("bigint")
WITH_LINES = "WITH lines AS (" + Q.FRAMES["lines"].format_map(Q.DRIVER) + "), x AS (SELECT l_orderkey AS k, l_linenumber AS n, part, supp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lines)"


def query(sql: str, parts: bool = False) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a query over ``x``: lines (k, n, part, supp) with their number i of m in their order. With ``parts`` it
    is also told into how many parts to deal out as many rows by another key."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = Q.Tables(spark, sf_dir)
            x = spark.sql("SELECT l_orderkey AS k, l_linenumber AS n, part, supp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM {lines}", lines=t("lines"))
            return f(x, t.parts) if parts else f(x)

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f"{WITH_LINES}{', ' if sql.lstrip().startswith(',') else ' '}{sql.lstrip().removeprefix(',')}"
        return f

    return add


# ---- tokens, cells and lines -----------------------------------------------------------------------------------------


@query(""", e AS (SELECT *, 'D' || k AS d, 'U' || n AS u, CASE part % 5 WHEN 0 THEN 'documentId=D' || k || '; unitId=U' || n || '; x' WHEN 1 THEN 'documentId=D' || k || '; x' WHEN 2 THEN 'documentId=D' || k || '; documentId=D' || k || '; unitId=U' || n
    WHEN 3 THEN 'documentId=D' || k || '; unitId=Other' ELSE 'note; unitId=U' || n || ';documentId=D' || k END AS t FROM x), s AS (SELECT *, list_transform(string_split(t, ';'), lambda y: trim(y)) AS tokens FROM e)
  SELECT k, n, len(list_filter(tokens, lambda y: y = 'documentId=' || d)) = 1 AND len(list_filter(tokens, lambda y: y = 'unitId=' || u)) = 1 AND len(list_filter(tokens, lambda y: contains(y, 'documentId') OR contains(y, 'unitId'))) = 2 AS bound FROM s""")
def bound_coordinates(x: DataFrame) -> DataFrame:
    d, u = F.concat(F.lit("D"), "k"), F.concat(F.lit("U"), "n")
    pair = F.concat(F.lit("documentId="), d)
    text = (
        F.when(c("part") % 5 == 0, F.concat(pair, F.lit("; unitId="), u, F.lit("; x")))
        .when(c("part") % 5 == 1, F.concat(pair, F.lit("; x")))
        .when(c("part") % 5 == 2, F.concat(pair, F.lit("; "), pair, F.lit("; unitId="), u))
        .when(c("part") % 5 == 3, F.concat(pair, F.lit("; unitId=Other")))
        .otherwise(F.concat(F.lit("note; unitId="), u, F.lit(";"), pair))
    )
    return x.select("k", "n", X.coordinates_are(text, d, u).alias("bound"))


@query(r""", e AS (SELECT *, 'p' || part || '|' || chr(13) || chr(10) || 's' || supp || CASE part % 3 WHEN 0 THEN ' <BR/> ' WHEN 1 THEN '<br>tail' ELSE '<bro>' END AS t FROM x)
  SELECT k, n, translate(t, chr(13) || chr(10) || '|', '  ¦') AS flat, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cell, CASE WHEN trim(CASE WHEN supp % 4 = 0 THEN ' ' WHEN supp % 4 = 1 THEN NULL ELSE 's' || supp END) <> '' THEN 's' || supp ELSE 'none' END AS label FROM e""")
def cells_and_labels(x: DataFrame) -> DataFrame:
    tail = F.when(c("part") % 3 == 0, " <BR/> ").when(c("part") % 3 == 1, "<br>tail").otherwise("<bro>")
    text = F.concat(F.lit("p"), "part", F.lit("|\r\ns"), "supp", tail)
    label = F.when(c("supp") % 4 == 0, " ").when(c("supp") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), "supp"))
    return x.select("k", "n", X.one_line(text).alias("flat"), X.breaks_to_lines(text).alias("cell"), X.default_if_blank(label, F.lit("none")).alias("label"))


@query(r""", e AS (SELECT *, CASE part % 6 WHEN 0 THEN 'no row ' || part WHEN 1 THEN '|' ELSE ' | a\|' || part || ' |' || CASE WHEN part % 6 = 2 THEN ':---:' WHEN part % 6 = 3 THEN '--' ELSE ' x<br>y ' END || '|' || supp || '| ' END AS t FROM x),
  s AS (SELECT *, list_transform(string_split(replace(regexp_replace(trim(t), '^\||\|$', '', 'g'), '\|', chr(1)), '|'), lambda y: trim(replace(replace(y, '<br>', chr(10)), chr(1), '|'))) AS cells FROM e)
  SELECT k, n, CASE WHEN part % 6 > 1 THEN array_to_string(cells, '~') END AS cells, CASE WHEN part % 6 > 1 THEN len(list_filter(cells, lambda y: regexp_full_match(y, ':?-{3,}:?'))) END AS separators FROM s""")
def markdown_rows(x: DataFrame) -> DataFrame:
    middle = F.when(c("part") % 6 == 2, ":---:").when(c("part") % 6 == 3, "--").otherwise(" x<br>y ")
    row = F.when(c("part") % 6 == 0, F.concat(F.lit("no row "), "part")).when(c("part") % 6 == 1, "|").otherwise(F.concat(F.lit(" | a\\|"), "part", F.lit(" |"), middle, F.lit("|"), "supp", F.lit("| ")))
    cells = X.markdown_cells(row)
    return x.select("k", "n", F.array_join(cells, "~").alias("cells"), F.when(cells.isNotNull(), big(F.size(F.filter(cells, X.is_separator)))).alias("separators"))


_NOTE = "CASE part % 7 WHEN 0 THEN '# head' WHEN 1 THEN ' ' WHEN 2 THEN 'a | b' WHEN 3 THEN '| a' WHEN 4 THEN 'b |' WHEN 5 THEN '[1]' ELSE 'note ' || supp END"


@query(f""" SELECT k, bool_and(trim(t) = '' OR NOT (left(t, 1) IN ('#', '|', '{{', '[') OR right(t, 1) = '|')) AS notes FROM (SELECT k, {_NOTE} AS t FROM x WHERE part % 7 IN (1, 2, 6) OR supp % 3 = 0) GROUP BY k""")
def trailing_notes(x: DataFrame) -> DataFrame:
    lines = x.where("part % 7 IN (1, 2, 6) OR supp % 3 = 0").groupBy("k").agg(F.collect_list(F.expr(_NOTE)).alias("lines"))
    return lines.select("k", X.notes_only(c("lines")).alias("notes"))


@query(""" SELECT 'contiguous' AS rule, CAST(k AS VARCHAR) AS key, min(n) || '..' || max(n) AS detail FROM x GROUP BY k HAVING max(n) - min(n) + 1 <> count(*)""")
def continuous_ordinals(x: DataFrame) -> DataFrame:
    return L.contiguous(x, ["k"], "n", None)


# ---- scope -----------------------------------------------------------------------------------------------------------


@query(""" SELECT k, n, CASE WHEN CASE WHEN part % 3 > 0 THEN part % 3 WHEN supp % 2 = 0 THEN 1 ELSE 2 END = 1 THEN 'FUNCTION_LIST' ELSE 'REQUIREMENT' END AS role FROM x""")
def material_roles(x: DataFrame) -> DataFrame:
    kinds = {v: k for k, v in S.ROLES.items()}
    functions, requirements = F.lit(kinds["FUNCTION_LIST"]), F.lit(kinds["REQUIREMENT"])
    own = F.when(c("part") % 3 == 1, functions).when(c("part") % 3 == 2, requirements)
    only = F.array(F.when(c("supp") % 2 == 0, functions).otherwise(requirements))
    return x.select("k", "n", S.role(own, only).alias("role"))


@query(""" SELECT 'dispatch' AS rule, k || '|' || n AS key, s || '|' || p || '|' || r AS detail FROM (SELECT k, n, CASE WHEN part % 2 = 0 THEN 'FEATURE_LIST_SCAN' WHEN part % 11 = 0 THEN 'OTHER' ELSE 'REQUIREMENT_SCAN' END AS s, 1 + supp % 3 AS p, CASE (part + supp) % 5 WHEN 2 THEN 'WORK_ORDER_PLAN' WHEN 3 THEN 'REQUIREMENT' WHEN 4 THEN 'OTHER' ELSE 'FUNCTION_LIST' END AS r FROM x)
  WHERE NOT (s = 'FEATURE_LIST_SCAN' AND p = 1 AND r = 'FUNCTION_LIST' OR s = 'REQUIREMENT_SCAN' AND p <= 2 AND r IN ('REQUIREMENT', 'WORK_ORDER_PLAN'))""")
def dispatch_guard(x: DataFrame) -> DataFrame:
    stage = F.when(c("part") % 2 == 0, "FEATURE_LIST_SCAN").when(c("part") % 11 == 0, "OTHER").otherwise("REQUIREMENT_SCAN")
    number = (c("part") + c("supp")) % 5
    role = F.when(number == 2, "WORK_ORDER_PLAN").when(number == 3, "REQUIREMENT").when(number == 4, "OTHER").otherwise("FUNCTION_LIST")
    return S.dispatch_violations(x.select("k", "n", stage.alias("audit_stage"), (1 + c("supp") % 3).alias("audit_pass"), role.alias("role")), ["k", "n"])


@query(""", h AS (SELECT k, 'F' || (part % 40) AS hash, 'D' || n AS d, i, m, n, part, supp, CASE WHEN i = 1 AND k % 3 > 0 THEN 'function_list' ELSE 'requirements_spec' END AS type FROM x)
  SELECT 'one coordinate' AS rule, CAST(k AS VARCHAR) AS key, '2' AS detail FROM h WHERE k % 5 = 0 GROUP BY k HAVING count(DISTINCT i % 2) = 2
  UNION ALL SELECT 'function list', CAST(k AS VARCHAR), 'missing' FROM h GROUP BY k HAVING NOT bool_or(type = 'function_list') UNION ALL SELECT 'formal requirement', CAST(k AS VARCHAR), 'missing' FROM h GROUP BY k HAVING NOT bool_or(type = 'requirements_spec')
  UNION ALL SELECT 'distinct hashes', CAST(k AS VARCHAR), hash FROM h GROUP BY k, hash HAVING count(*) > 1 UNION ALL SELECT 'hashes of documents', CAST(k AS VARCHAR), type FROM h WHERE supp % 9 = 0""")
def selection_rules(x: DataFrame) -> DataFrame:
    kind = F.when((c("i") == 1) & (c("k") % 3 > 0), "function_list").otherwise("requirements_spec")
    place = {name: F.lit("a") for name in S.COORDINATE}
    place[next(iter(S.COORDINATE))] = F.when((c("k") % 5 == 0) & (c("i") % 2 == 0), "b").otherwise("a")
    own = F.concat(F.lit("D"), "n")
    documents = F.when(c("supp") % 9 == 0, F.array(F.lit("other"), own)).otherwise(F.array(own))
    hashes = F.array(F.struct(own.alias("document_id"), F.concat(F.lit("F"), c("part") % 40).alias("file_hash")))
    return S.selection_violations(x.select(c("k").alias("task_id"), kind.alias("type_key"), documents.alias("document_ids"), hashes.alias("hashes"), *(v.alias(k) for k, v in place.items())))


# ---- pages and Markdown ----------------------------------------------------------------------------------------------


@query(""", u AS (SELECT k, (i - 1) // 2 + 1 AS page, i, m, part, supp, n FROM x), d AS (SELECT k, max(m) AS m, count(*) AS n, count(DISTINCT CASE WHEN k % 11 = 1 THEN 0 ELSE i END) AS ids, max(page) AS pages FROM u GROUP BY k)
  SELECT r.rule, 'K' || k AS key, n || ' of ' || CASE WHEN k % 11 = 2 THEN m + 1 ELSE m END AS detail FROM d, (VALUES ('unique units'), ('count'), ('end'), ('same id'), ('ordinals'), ('order'), ('same total')) AS r(rule)
  WHERE r.rule = 'unique units' AND k % 11 = 1 AND m > 1 OR r.rule = 'order' AND k % 11 = 1 AND m > 1 OR r.rule = 'count' AND k % 11 = 2 OR r.rule = 'end' AND k % 11 = 3 OR r.rule = 'same id' AND k % 11 = 4 OR r.rule = 'ordinals' AND k % 11 = 5""", parts=True)
def paged_units(x: DataFrame, parts: int) -> DataFrame:
    """Orders are documents of two units a page; of every eleventh one a rule is broken."""
    off = lambda n: c("k") % 11 == n
    unit = F.struct(
        F.when(off(1), F.lit("U0")).otherwise(F.concat(F.lit("U"), F.lpad(c("i").cast("string"), 3, "0"))).alias("unit_id"),
        F.lit(0).alias("chunk_index"),
        F.when(off(5), c("i") + 1).otherwise(c("i")).cast("int").alias("ordinal"),
    )
    page = F.floor((c("i") - 1) / 2) + 1
    rows = x.select("k", page.cast("int").alias("page"), "i", "m", unit.alias("u"))
    pages = rows.groupBy("k", "page", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda y: y["u"]).alias("units"), F.max(c("i") == c("m")).alias("last"))
    return P.unit_violations(
        pages.select(
            F.concat(F.lit("K"), "k").alias("document_id"),
            "page",
            F.concat(F.when(off(4), F.lit("X")).otherwise(F.lit("K")), "k").alias("knowledge_id"),
            F.when(off(2), c("m") + 1).otherwise(c("m")).cast("int").alias("total_units"),
            (c("last") & ~off(3)).alias("complete"),
            "units",
        ).repartition(parts, "document_id")
    )


_CATEGORIES = list(M.CATEGORIES)


def _markdown(x: DataFrame, cases: bool, evidence: F.Column | None = None) -> DataFrame:
    """A two-table text for each order: its lines are rows of the first table, and of the second where it has any."""
    category = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (c("part") % len(_CATEGORIES) + 1).cast("int"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    first = row(c("i"), F.concat(F.lit("Area "), c("supp")), F.when((c("k") % 7 == 1) & (c("i") == 2), F.lit("")).otherwise(category), F.concat(F.lit("line "), "n") if evidence is None else evidence)
    second = row(F.concat(F.lit("case "), "part"), F.lit("m\\|n"), F.lit("none"), F.lit("1. a<br>2. b"), F.lit("c"), F.concat(F.lit("D"), "k"))
    per = x.groupBy("k").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", r.alias("t")))), lambda y: y["t"]), "\n").alias(a) for a, r in (("a", first), ("b", second))))
    rule = lambda n: "|" + " --- |" * n
    head = lambda names: "| " + " | ".join(names) + " |"
    text = F.concat(
        F.when(c("k") % 7 == 2, F.lit("## Other")).otherwise(F.lit(M.FIRST_HEADING)),
        F.lit(f"\n\n{head(M.FIRST_HEADER)}\n{rule(4)}\n"),
        c("a"),
        F.lit(f"\n\n{M.SECOND_HEADING}\n\n{head(M.SECOND_HEADER)}\n{rule(6)}\n"),
        F.concat(c("b"), F.lit("\n")) if cases else F.lit(""),
        F.when(c("k") % 7 == 3, F.lit("\nmore")).otherwise(F.lit("")),
    )
    return per.select("k", text.alias("markdown"))


_BAD = "k % 7 = 2 OR k % 7 = 3 OR k % 7 = 1 AND m > 1"


@query(f""" SELECT k, i AS row_position, 'case ' || part AS case_name, 'm|n' AS feature_module, '1. a' || chr(10) || '2. b' AS execution_steps, 'D' || k AS requirement_content, CAST(i AS BIGINT) AS sequence, 'Area ' || supp AS subject, 'line ' || n AS evidence FROM x WHERE NOT ({_BAD})""")
def generation_tables(x: DataFrame) -> DataFrame:
    read = M.read(_markdown(x, True), "generation").where("error IS NULL")
    both = read.select("k", F.explode(F.arrays_zip("audit", "cases")).alias("r"))
    return both.select("k", big(c("r.cases.row_position")).alias("row_position"), "r.cases.case_name", "r.cases.feature_module", "r.cases.execution_steps", "r.cases.requirement_content", big(c("r.audit.sequence")).alias("sequence"), "r.audit.subject", "r.audit.evidence")


@query(f""" SELECT k, i AS row_position, 'Area ' || supp AS subject FROM x WHERE NOT ({_BAD}) UNION ALL SELECT DISTINCT k, NULL, NULL FROM x WHERE {_BAD}""")
def scan_tables(x: DataFrame) -> DataFrame:
    read = M.read(_markdown(x, False), "scan")
    return read.select("k", F.explode_outer("audit").alias("r")).select("k", big(c("r.row_position")).alias("row_position"), "r.subject")


@query(f""", y AS (SELECT *, CASE WHEN k % 7 = 4 THEN 'C0' ELSE 'C' || n END AS id FROM x), b AS (SELECT k, {_BAD.replace("m > 1", "max(m) > 1").replace(" AND max", " AND max")} OR count(DISTINCT id) < count(*) AS bad FROM y GROUP BY k)
  SELECT k, i AS row_position, id AS candidate FROM y JOIN b USING (k) WHERE NOT bad""")
def conclusion_tables(x: DataFrame) -> DataFrame:
    ids = F.when(c("k") % 7 == 4, F.lit("C0")).otherwise(F.concat(F.lit("C"), "n"))
    read = M.read(_markdown(x, False, F.concat(F.lit("text; candidateIds="), ids)), "conclusion").where("error IS NULL")
    rows = read.select("k", F.explode("audit").alias("r"))
    return rows.select("k", big(c("r.row_position")).alias("row_position"), F.array_join(X.candidate_ids(c("r.evidence")), ",").alias("candidate"))


# ---- validators ------------------------------------------------------------------------------------------------------


def _evidence(x: DataFrame) -> DataFrame:
    """Two pieces for each order: E0 can be cited unless it is retired, E1 is an example's in every fourth."""
    keys = x.select("k").distinct().select("k", F.explode(F.array(F.lit(0), F.lit(1))).alias("e"))
    return keys.select(c("k").alias("task_id"), F.concat(F.lit("E"), "e").alias("evidence_key"), F.lit("M").alias("material_key"), ((c("e") == 1) & (c("k") % 4 == 0)).alias("example_scope"), ((c("e") == 0) & (c("k") % 6 == 0)).alias("retired"), F.lit(True).alias("fully_traversed"))


_CITABLE = "(e = 'E0' AND k % 6 > 0 OR e = 'E1' AND k % 4 > 0)"


@query(f""", f AS (SELECT k, n, part, 'K' || CASE WHEN part % 13 = 0 THEN '' ELSE CAST(n % 5 AS VARCHAR) END AS key, 'E' || (part % 3) AS e FROM x WHERE i % 2 = 1), g AS (SELECT k, 'G' || n AS key, 'E' || (part % 2) AS e, supp FROM x WHERE i % 2 = 0)
  SELECT 'fact_key unique' AS rule, CAST(k AS VARCHAR) AS key, key AS detail FROM f GROUP BY k, key HAVING count(*) > 1 UNION ALL SELECT 'function nonblank', CAST(k AS VARCHAR), key FROM f WHERE part % 8 = 0 UNION ALL SELECT 'supplementary material', CAST(k AS VARCHAR), key FROM f WHERE k % 9 = 0
  UNION ALL SELECT 'evidence', CAST(k AS VARCHAR), key FROM f WHERE part % 10 = 0 UNION ALL SELECT 'handling level', CAST(k AS VARCHAR), key FROM g WHERE supp % 7 = 0
  UNION ALL SELECT 'fact evidence', CAST(k AS VARCHAR), e FROM f WHERE part % 10 > 0 AND NOT {_CITABLE} UNION ALL SELECT 'finding evidence', CAST(k AS VARCHAR), e FROM g WHERE NOT {_CITABLE}""")
def material_review_rules(x: DataFrame) -> DataFrame:
    work = x.select("k").distinct().select(c("k").alias("work_id"), c("k").alias("task_id"), F.lit("M").alias("material_key"), (c("k") % 9 == 0).alias("supplementary"))
    key = F.concat(F.lit("K"), F.when(c("part") % 13 == 0, F.lit("")).otherwise((c("n") % 5).cast("string")))
    cited = F.array(F.concat(F.lit("E"), c("part") % 3))
    facts = x.where("i % 2 = 1").select(c("k").alias("work_id"), key.alias("fact_key"), F.when(c("part") % 8 > 0, "f").alias("function"), F.when(c("part") % 10 == 0, F.slice(cited, 1, 0)).otherwise(cited).alias("evidence_keys"))
    findings = x.where("i % 2 = 0").select(c("k").alias("work_id"), F.concat(F.lit("G"), "n").alias("finding_key"), F.when(c("supp") % 7 > 0, "HIGH").alias("handling_level"), F.array(F.concat(F.lit("E"), c("part") % 2)).alias("evidence_keys"))
    return V.material_review(work, facts, findings, _evidence(x))


@query(""", v AS (SELECT k, n, i, part, supp, 'case ' || (n % 4) AS key FROM x WHERE i > 1 OR part % 3 > 0), w AS (SELECT DISTINCT k FROM x)
  SELECT 'echo' AS rule, CAST(k AS VARCHAR) AS key, 'other,p' AS detail FROM w WHERE k % 8 = 0 UNION ALL SELECT '1 to 50 cases', CAST(k AS VARCHAR), '0' FROM w WHERE k NOT IN (SELECT k FROM v)
  UNION ALL SELECT 'case_key unique', CAST(k AS VARCHAR), key FROM v GROUP BY k, key HAVING count(*) > 1 UNION ALL SELECT 'general experience', CAST(k AS VARCHAR), key FROM v WHERE k % 5 = 0 AND supp % 3 > 0
  UNION ALL SELECT 'a formal case', CAST(k AS VARCHAR), 'missing' FROM w WHERE k % 5 > 0 AND k NOT IN (SELECT k FROM v WHERE supp % 3 > 0) UNION ALL SELECT 'steps', CAST(k AS VARCHAR), key FROM v WHERE part % 6 = 0
  UNION ALL SELECT 'fact', CAST(k AS VARCHAR), 'F' || (part % 4) FROM v WHERE part % 4 = 3""")
def testcase_rules(x: DataFrame) -> DataFrame:
    orders = x.select("k").distinct()
    work = orders.select(c("k").alias("work_id"), c("k").alias("task_id"), F.lit("f").alias("function_key"), F.lit("p").alias("test_point_key"), F.when(c("k") % 5 == 0, "GENERAL_EXPERIENCE").otherwise("FORMAL_REQUIREMENT").alias("basis"))
    results = orders.select(c("k").alias("work_id"), F.when(c("k") % 8 == 0, "other").otherwise("f").alias("function_key"), F.lit("p").alias("test_point_key"))
    steps = F.when(c("part") % 6 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))
    status = F.when(c("supp") % 3 > 0, "FORMAL").otherwise("PENDING_CONFIRMATION")
    cases = x.where("i > 1 OR part % 3 > 0").select(c("k").alias("work_id"), F.concat(F.lit("case "), c("n") % 4).alias("case_key"), status.alias("case_status"), steps.alias("step_numbers"), F.array(F.concat(F.lit("F"), c("part") % 4)).alias("fact_keys"), F.slice(F.array(F.lit("E")), 1, 0).alias("evidence_keys"))
    facts = orders.select(c("k").alias("work_id"), F.explode(F.array(F.lit("F0"), F.lit("F1"), F.lit("F2"))).alias("key"))
    return V.testcases(work, results, cases, facts, orders.select(c("k").alias("work_id"), F.lit("E0").alias("key")), _evidence(x))


@query(""", r AS (SELECT k, n, part, CASE WHEN part % 12 = 0 THEN ' ' ELSE 'K' || (n % 5) END AS key FROM x)
  SELECT 'key nonblank' AS rule, CAST(k AS VARCHAR) AS key, 'blank' AS detail FROM r WHERE key = ' ' UNION ALL SELECT 'key unique', CAST(k AS VARCHAR), key FROM r GROUP BY k, key HAVING count(*) > 1
  UNION ALL SELECT 'evidence_key unique', CAST(k AS VARCHAR), 'E' || (part % 2) FROM x GROUP BY k, part % 2 HAVING count(*) > 1""")
def registry_rules(x: DataFrame) -> DataFrame:
    key = F.when(c("part") % 12 == 0, " ").otherwise(F.concat(F.lit("K"), c("n") % 5))
    return V.registry_violations(x.select(c("k").alias("task_id"), key.alias("key")), x.select(c("k").alias("task_id"), F.concat(F.lit("E"), c("part") % 2).alias("evidence_key")))


# ---- overlays, order, changes and replays ----------------------------------------------------------------------------


@query(""" SELECT k, n, CASE WHEN part % 3 = 0 THEN 'page' ELSE 'accepted' END AS source, CASE WHEN part % 3 = 0 THEN CASE WHEN part % 2 = 0 THEN part END ELSE part + 1 END AS value FROM x WHERE part % 3 = 0 OR part % 5 > 0""")
def overlaid_pages(x: DataFrame) -> DataFrame:
    """Every third line is on the page, four of five are accepted: many are both, and the page hides those, by nulls too."""
    page = x.where("part % 3 = 0").select("k", "n", F.lit("page").alias("source"), F.when(c("part") % 2 == 0, c("part")).alias("value"))
    accepted = x.where("part % 5 > 0").select("k", "n", F.lit("accepted").alias("source"), (c("part") + 1).alias("value"))
    return L.overlay(page, accepted, ["k", "n"])


@query(""" SELECT k, string_agg(v, ',' ORDER BY first, v) AS kinds FROM (SELECT k, 'v' || (part % 3) AS v, min(n) AS first FROM (SELECT k, part, n FROM x WHERE supp % 2 = 0 UNION ALL SELECT k, part, n FROM x WHERE supp % 3 = 0) GROUP BY 1, 2) GROUP BY k""")
def accumulated_kinds(x: DataFrame) -> DataFrame:
    pages = L.accumulated([x.where("supp % 2 = 0").select("k", "part", "n"), x.where("supp % 3 = 0").select("k", "part", "n")])
    kinds = L.distinct_in_order(pages.withColumn("v", F.concat(F.lit("v"), c("part") % 3)), ["k"], "v", "n")
    return kinds.select("k", F.array_join("values", ",").alias("kinds"))


@query(""" SELECT 'one row changed' AS rule, CAST(k AS VARCHAR) AS key, CASE WHEN k % 4 > 0 THEN CAST(d AS VARCHAR) ELSE 'not asked for' END AS detail FROM (SELECT k, count(*) FILTER (part % 4 = 0) AS d FROM x GROUP BY k) WHERE k % 4 > 0 AND d <> 1 OR k % 4 = 0 AND d > 0""")
def changed_rows(x: DataFrame) -> DataFrame:
    changed = L.compare_and_set(x.select("k", "n", "part"), c("part") % 4 == 0, n=c("n") + 1)
    return L.change_violations(changed, x.where("k % 4 > 0").select("k"), ["k"])


@query(""" SELECT 'T' || k AS task_id, CASE WHEN k % 5 = 0 THEN 'insert' WHEN k % 5 = 1 AND m > 1 OR k % 5 = 2 OR k % 5 = 4 THEN 'conflict' ELSE 'same' END AS outcome FROM (SELECT k, max(m) AS m FROM x GROUP BY k)""", parts=True)
def replayed_batch_plans(x: DataFrame, parts: int) -> DataFrame:
    """Stored plans lack a batch, name another feature, are whole, or have one more."""
    row = lambda df, name: df.select(F.concat(F.lit("T"), "k").alias("task_id"), c("i").cast("int").alias("batch_sequence"), name.alias("feature_id"), F.lit("f").alias("feature_name"))
    own = F.concat(F.lit("F"), "n")
    kept = x.where("k % 5 > 0 AND NOT (k % 5 = 1 AND i > 1)")
    more = x.where("k % 5 = 4 AND i = 1").withColumn("i", F.lit(99))
    return R.replayed_plans(row(kept, F.when((c("k") % 5 == 2) & (c("i") == 1), "other").otherwise(own)).unionByName(row(more, own)), row(x, own), parts)
