"""Queries over the driver's tables, one or more for each family of operators, with DuckDB SQL for each.

The ledger's tables have no counterpart there, so each operator runs on an analogue: orders are batches,
line items attempts, conversations turns of attempts, documents units, labels conclusions, events a queue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import ids as I
from ledgerloom.functions import text as X
from ledgerloom.operators import ledger as L
from ledgerloom.plans import progress as P
from ledgerloom.streaming import answers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(sql: str | None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of a table getter, with its SQL if it has one."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


c = F.col
n_of = lambda condition: F.count_if(condition)
big = lambda x: x.cast("bigint")


# Progress and aggregates


@query("""
WITH b AS (SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders),
u AS (SELECT count(*) AS units FROM documents),
w AS (SELECT count(*) AS processed FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) = 0)),
k AS (SELECT count(*) AS covered, count(DISTINCT CASE WHEN quality = 0 THEN d.doc_id END) AS low, count(DISTINCT CASE WHEN toxic = 1 THEN d.doc_id END) AS toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
e AS (SELECT count(DISTINCT user_id) AS users, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0) AS errors FROM events)
SELECT b.*, u.*, w.*, k.*, CAST(e.users AS BIGINT) AS users, CAST(e.errors AS BIGINT) AS errors,
  CASE WHEN done < total THEN 'batches' WHEN covered < units THEN 'review' ELSE 'complete' END AS stage, CASE WHEN covered = units THEN covered END AS frozen
FROM b CROSS JOIN u CROSS JOIN w CROSS JOIN k CROSS JOIN e""")
def progress_flagship(t: Tables) -> DataFrame:
    b = t("orders").agg(F.count("*").alias("total"), n_of(c("o_orderstatus") == "F").alias("done"), n_of(c("o_orderstatus") == "P").alias("failed"))
    u = t("documents").agg(F.count("*").alias("units"))
    w = t("lineitem").groupBy("l_orderkey").agg(F.bool_and(c("l_linestatus") == "F").alias("f")).where("f").agg(F.count("*").alias("processed"))
    k = t("labels").join(t("documents").select("doc_id"), "doc_id").agg(
        F.count("*").alias("covered"), F.countDistinct(F.when(c("quality") == 0, c("doc_id"))).alias("low"), F.countDistinct(F.when(c("toxic") == 1, c("doc_id"))).alias("toxic")
    )
    e = t("events").agg(F.countDistinct("user_id").alias("users"), n_of(c("event_type") == "error").alias("errors"))
    out = b.crossJoin(u).crossJoin(w).crossJoin(k).crossJoin(e)  # one row each
    stage = F.when(c("done") < c("total"), "batches").when(c("covered") < c("units"), "review").otherwise("complete")
    return out.withColumns({"stage": stage, "frozen": F.when(c("covered") == c("units"), c("covered"))})


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus IN ('F','P')) AS completed, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1")
def batch_counts(t: Tables) -> DataFrame:
    s = c("o_orderstatus")
    return t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), n_of(s.isin("F", "P")).alias("completed"), n_of(s == "F").alias("accepted"), n_of(s == "P").alias("failed"))


@query("SELECT count(DISTINCT CASE WHEN o_orderstatus='F' THEN o_custkey END) AS f, count(DISTINCT CASE WHEN o_orderstatus='O' THEN o_custkey END) AS o, count(DISTINCT CASE WHEN o_orderstatus='P' THEN o_custkey END) AS p FROM orders")
def distinct_conditional(t: Tables) -> DataFrame:
    # one distinct aggregate of (status, customer) instead of an expansion by each measure
    pairs = t("orders").select("o_orderstatus", "o_custkey").distinct().where("o_custkey IS NOT NULL")
    return pairs.agg(*(n_of(c("o_orderstatus") == s).alias(s.lower()) for s in "FOP"))


@query("SELECT count(*) AS n FROM (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY 1, 2 HAVING sum(CASE WHEN l_linestatus='F' THEN 0 ELSE 1 END) = 0)")
def complete_groups(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.bool_and(c("l_linestatus") == "F").alias("all_done")).where("all_done").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 2)")
def exact_two_rows(t: Tables) -> DataFrame:
    lines = t("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    return t("orders").select("o_orderkey").join(lines, "o_orderkey", "left").where(F.coalesce("k", F.lit(0)) != 2).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_distinct, count(*) <> count(DISTINCT doc_id) AS has_duplicates, CAST(2 * count(*) AS BIGINT) AS expected FROM labels")
def duplicate_detection(t: Tables) -> DataFrame:
    out = t("labels").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_distinct"))
    return out.withColumns({"has_duplicates": c("n") != c("n_distinct"), "expected": c("n") * 2})


@query("SELECT source, count(DISTINCT doc_id) AS n_docs, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def option_counts(t: Tables) -> DataFrame:
    return t("documents").groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


# Windows and sequences


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_attempt(t: Tables) -> DataFrame:
    # max_by combines before the shuffle, so a user with very many events is no task's burden
    return t("events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations QUALIFY turn BETWEEN 1 AND 3")
def previous_attempt(t: Tables) -> DataFrame:
    return L.previous(t("conversations").where("turn <= 3"), ["conv_id"], [c("turn")], "role", "previous_role").where(c("turn").between(1, 3)).select("conv_id", "turn", "previous_role")


@query("SELECT o_orderkey, l_partkey, l_suppkey FROM orders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) = 1) ON l_orderkey = o_orderkey")
def failure_summary_top1(t: Tables) -> DataFrame:
    order = F.struct((-c("l_extendedprice")).alias("a"), "l_partkey", "l_suppkey")
    top = t("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.min(order).alias("x"))
    return t("orders").select("o_orderkey").join(top, "o_orderkey", "left").select("o_orderkey", "x.l_partkey", "x.l_suppkey")


@query("SELECT conv_id, coalesce(max(turn), 0) + 1 AS next_sequence FROM conversations GROUP BY 1")
def next_sequence(t: Tables) -> DataFrame:
    return t("conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_sequence"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def sequence_backfill(t: Tables) -> DataFrame:
    return L.numbered(t("events"), ["user_id"], [c("ts"), c("event_id")]).select("event_id", big(c("sequence")).alias("sequence"))


@query("SELECT conv_id, count(*) = max(turn) + 1 AND min(turn) = 0 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY 1")
def contiguous_ordinals(t: Tables) -> DataFrame:
    bad = L.contiguous(t("conversations"), ["conv_id"], "turn", 0).select(c("key").cast("bigint").alias("conv_id"), F.lit(False).alias("ok"))
    return t("conversations").select("conv_id").distinct().join(bad, "conv_id", "left").select("conv_id", F.coalesce("ok", F.lit(True)).alias("contiguous"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS page, CAST(ceil(count(*) OVER (PARTITION BY source) / 8.0) AS BIGINT) AS pages FROM documents")
def pages_of_eight(t: Tables) -> DataFrame:
    numbered = L.numbered_in_ranges(t("documents").select("doc_id", "source"), ["source"], ["doc_id"])  # a source may hold a third of all
    sizes = t("documents").groupBy("source").agg(F.ceil(F.count("*") / 8).alias("pages"))
    return numbered.join(sizes, "source").select("doc_id", big(F.floor((c("sequence") - 1) / 8)).alias("page"), big(c("pages")).alias("pages"))


# Joins and set operations


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def existence_or(t: Tables) -> DataFrame:
    done = t("lineitem").where("l_linestatus = 'F'").select(c("l_orderkey").alias("o_orderkey"), F.lit(True).alias("x")).distinct()
    return t("orders").select("o_orderkey", "o_orderstatus").join(done, "o_orderkey", "left").where((c("o_orderstatus") == "F") | c("x").isNotNull()).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_exists(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey").join(t("lineitem").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN l.n IS NULL THEN 'missing' WHEN l.n > 1 THEN 'repeated' END AS state, CAST(coalesce(l.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL OR l.n IS NULL OR l.n > 1")
def junction_cover(t: Tables) -> DataFrame:
    return L.coverage(t("documents"), t("labels"), "doc_id")


_FIRST = "SELECT doc_id, text, min(doc_id) OVER (PARTITION BY lang, source, text) AS first FROM documents"


@query(f"SELECT doc_id FROM ({_FIRST}) WHERE doc_id > first")
def content_semi(t: Tables) -> DataFrame:
    return _by_content(t).where("doc_id > first").select("doc_id")


@query(f"SELECT doc_id FROM ({_FIRST}) WHERE doc_id = first")
def content_anti(t: Tables) -> DataFrame:
    return _by_content(t).where("doc_id = first").select("doc_id")


def _by_content(t: Tables) -> DataFrame:
    """Documents with the first id of the same content; a digest of the text moves, not the text."""
    rows = t("documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("text"))
    return rows.join(rows.groupBy("lang", "source", "text").agg(F.min("doc_id").alias("first")), ["lang", "source", "text"])


@query("SELECT first AS anchor, string_agg(doc_id, ',' ORDER BY doc_id) AS members, count(*) AS n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) GROUP BY 1 HAVING count(*) > 1")
def anchor_merge(t: Tables) -> DataFrame:
    groups = t("documents").groupBy(F.sha2("text", 256).alias("d")).agg(F.min("doc_id").alias("anchor"), F.array_sort(F.collect_list("doc_id")).alias("m"))
    return groups.where(F.size("m") > 1).select("anchor", F.array_join("m", ",").alias("members"), big(F.size("m")).alias("n"))


@query("SELECT lower(trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g'))) AS path, min(o_orderkey) AS first_key, count(DISTINCT o_orderstatus) AS kinds, count(*) AS members FROM orders GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT o_orderstatus) >= 2")
def normalized_groups(t: Tables) -> DataFrame:
    rows = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.min("o_orderkey").alias("k"), F.count("*").alias("n"))  # few labels reach Python
    out = rows.withColumn("path", X.normal_path(c("o_orderpriority"))).groupBy("path").agg(F.min("k").alias("first_key"), F.countDistinct("o_orderstatus").alias("kinds"), F.sum("n").alias("members"))
    return out.where("members >= 2 AND kinds >= 2")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer WHERE lower(c_name) LIKE '%customer%1%' ORDER BY c_name, c_custkey LIMIT 20 OFFSET 20")
def page_list(t: Tables) -> DataFrame:
    # the page is cut first: orders are counted for its 20 customers only
    rows = L.page(t("customer").where(X.contains_ignoring_case(c("c_name"), " Customer%1 ")), [c("c_name"), c("c_custkey")], 1, 20).select("c_custkey", "c_name")
    orders = t("orders").join(F.broadcast(rows.select(c("c_custkey").alias("o_custkey"))), "o_custkey", "left_semi").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return rows.join(orders, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orders"))


@query("SELECT o_orderkey, string_agg(l_partkey || ':' || l_suppkey, ';' ORDER BY l_partkey, l_suppkey, l_linenumber) AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_children(t: Tables) -> DataFrame:
    lines = t("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber"))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: F.concat(x["l_partkey"].cast("string"), F.lit(":"), x["l_suppkey"].cast("string"))), ";")
    return t("orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", text.alias("children"))


@query("SELECT r_name, n_name, count(s_suppkey) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def catalog_tree(t: Tables) -> DataFrame:
    per = t("supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    out = t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey")).join(per, "n_nationkey", "left")
    return out.select("r_name", "n_name", F.coalesce("s", F.lit(0)).cast("bigint").alias("suppliers"))


@query("SELECT source, count(*) AS documents, count(DISTINCT (lang, quality, toxic)) AS coordinates, count(DISTINCT (lang, quality, toxic)) = 1 AS same_coordinate FROM documents JOIN labels USING (doc_id) GROUP BY source, doc_id % 40")
def same_coordinate(t: Tables) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id").groupBy("source", c("doc_id") % 40)
    return rows.agg(F.count("*").alias("documents"), F.countDistinct(F.struct("lang", "quality", "toxic")).alias("coordinates")).select("source", "documents", "coordinates", (c("coordinates") == 1).alias("same_coordinate"))


@query("SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM customer) AS difference, (SELECT max(o_orderkey) FROM orders) AS top")
def scalar_arithmetic(t: Tables) -> DataFrame:
    a = t("orders").agg(F.count("*").alias("a"), F.max("o_orderkey").alias("top"))
    return a.crossJoin(t("customer").agg(F.count("*").alias("b"))).select((c("a") - c("b")).alias("difference"), "top")


@query("SELECT doc_id, coalesce(l.toxic, -1) AS toxic, coalesce(l.quality, CASE WHEN n_chars < 500 THEN 0 ELSE 1 END) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def overlay(t: Tables) -> DataFrame:
    out = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("quality", F.when(c("n_chars") < 500, 0).otherwise(1)).alias("quality"))


# Changes of state and writes, as result sets


@query("SELECT o_orderkey, CASE WHEN k >= 5 THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE o_orderstatus END AS status, k >= 5 OR o_orderstatus = 'O' AS changed FROM (SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS k FROM orders)")
def update_join(t: Tables) -> DataFrame:
    k = t("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    rows = t("orders").select("o_orderkey", c("o_orderstatus").alias("status")).join(k, "o_orderkey", "left").fillna(0, ["k"])
    return L.compare_and_set(rows, (c("k") >= 5) | (c("status") == "O"), status=F.when(c("k") >= 5, "FAILED").otherwise("QUEUED")).drop("k")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_join(t: Tables) -> DataFrame:
    gone = t("orders").where("o_orderstatus = 'P'").select(c("o_orderkey").alias("l_orderkey"))
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("SELECT event_id, source, target FROM (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source, event_type AS target FROM events) WHERE source IS NOT NULL AND NOT (source || '>' || target IN ('view>click', 'click>purchase', 'click>view', 'purchase>view'))")
def state_transitions(t: Tables) -> DataFrame:
    changes = L.previous(t("events"), ["user_id"], [c("ts"), c("event_id")], "event_type", "source").where("source IS NOT NULL").withColumnRenamed("event_type", "target")
    return L.illegal_transitions(changes, {"view": ["click"], "click": ["purchase", "view"], "purchase": ["view"]}).select("event_id", "source", "target")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 5")
def claim_fifo(t: Tables) -> DataFrame:
    tasks = t("events").withColumn("status", F.lit("QUEUED"))
    return L.claim(tasks, tasks.where("status = 'RUNNING'"), 5, [c("ts"), c("event_id")]).select("event_id")


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-06-01' THEN CASE WHEN event_type = 'error' OR user_id % 7 >= 3 THEN 'FAILED' ELSE 'QUEUED' END ELSE 'RUNNING' END AS status FROM events")
def lease_expiry(t: Tables) -> DataFrame:
    work = t("events").select("event_id", F.lit("RUNNING").alias("status"), c("ts").alias("lease_expires_at"), (c("user_id") % 7).alias("attempts"), (c("event_type") != "error").alias("retryable"))
    return L.after_lease(work, F.lit("2024-06-01").cast("timestamp_ntz"), 3).select("event_id", "status")


@query("SELECT user_id, count(*) AS attempts, count(*) >= 3 OR bool_or(event_type = 'error') AS permanent FROM events GROUP BY 1")
def retry_limit(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.count("*").alias("attempts"), ((F.count("*") >= 3) | F.bool_or(c("event_type") == "error")).alias("permanent"))


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN l.quality = (CASE WHEN d.n_chars < 1000 THEN 0 ELSE 1 END) THEN 'same' ELSE 'conflict' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1")
def replay_merge(t: Tables) -> DataFrame:
    incoming = t("documents").select("doc_id", F.when(c("n_chars") < 1000, 0).otherwise(1).cast("int").alias("quality"))
    return L.merge_replay(t("labels").select("doc_id", c("quality").cast("int").alias("quality")), incoming, ["doc_id"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT 'unique' AS rule, l_orderkey || '|' || l_linenumber AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'check', CAST(o_orderkey AS VARCHAR), 'false' FROM orders WHERE NOT (o_totalprice < 200000) UNION ALL SELECT 'foreign', CAST(o_custkey AS VARCHAR), 'no parent' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def constraint_violations(t: Tables) -> DataFrame:
    customers = t("customer").where("c_mktsegment <> 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    return L.check_unique(t("lineitem"), ["l_orderkey", "l_linenumber"]).unionByName(L.check_rows(t("orders"), ["o_orderkey"], c("o_totalprice") < 200000)).unionByName(L.check_foreign(t("orders"), customers, ["o_custkey"]))


# Scalars


@query("SELECT DISTINCT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'normal' END AS label FROM orders")
def label_map(t: Tables) -> DataFrame:
    return t("orders").select("o_orderpriority").distinct().select("o_orderpriority", F.coalesce(P.label(c("o_orderpriority"), {"1-URGENT": "urgent", "2-HIGH": "high"}), F.lit("normal")).alias("label"))


_US = "chr(31)"


@query(f"SELECT doc_id, sha256(source || {_US} || lang || {_US} || doc_id) AS id, 'doc-' || substr(sha256(source || chr(10) || lang), 1, 24) AS opaque FROM documents")
def sha_ids(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", I.sha_id(c("source"), c("lang"), c("doc_id").cast("string")).alias("id"), I.opaque_id("doc-", c("source"), c("lang")).alias("opaque"))


@query("SELECT conv_id, turn, substr(h,1,8) || '-' || substr(h,9,4) || '-3' || substr(h,14,3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4, 1) || substr(h,18,3) || '-' || substr(h,21,12) AS uuid FROM (SELECT conv_id, turn, md5(conv_id || ':' || turn) AS h FROM conversations)")
def name_uuids(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", I.name_uuid(F.concat_ws(":", c("conv_id").cast("string"), c("turn").cast("string"))).alias("uuid"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', '<redacted>', 'g'), '(?i)(api[_-]?key|token|secret|password)\\s*([=:])\\s*[^\\s,;]+', '\\1\\2<redacted>', 'g')) AS digest FROM documents WHERE regexp_matches(text, 'sk-[A-Za-z0-9_-]{8,}|(?i)(api[_-]?key|token|secret|password)\\s*[=:]')")
def redact_secrets(t: Tables) -> DataFrame:
    out = c("text")
    for pattern, to in X.REDACTIONS[:2]:
        out = F.regexp_replace(out, pattern, to)
    return t("documents").where(c("text").rlike(r"sk-[A-Za-z0-9_-]{8,}|(?i)(api[_-]?key|token|secret|password)\s*[=:]")).select("doc_id", F.md5(out).alias("digest"))


@query(None)
def normalized_lines(t: Tables) -> DataFrame:
    """Lines of documents by their normal form, which no SQL function has, those that several documents hold."""
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(~X.is_blank(c("line")))
    groups = X.with_normal_path(lines, "line", "normal").groupBy("normal").agg(F.countDistinct("doc_id").alias("documents"), F.min("line").alias("first"))
    return groups.where("documents > 1").select(F.md5("normal").alias("normal"), "documents", F.md5("first").alias("first"))


@query(None)
def redact_all(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(X.redact(c("text"))).alias("digest"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def url_tokens(t: Tables) -> DataFrame:
    return t("pages").select("page_id", X.token(F.regexp_extract("url", r"\?([^#]*)", 1), "page", "&").alias("page"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, len(json_keys(props)) = 1 AS exact_fields FROM events")
def json_props(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), (F.json_object_keys("props") == F.array(F.lit("k"))).alias("exact_fields"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS points, CAST(strlen(text) AS BIGINT) AS octets, length(text) <= 128 AND strlen(text) <= 16384 AS within FROM documents")
def text_bounds(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", big(F.length("text")).alias("points"), big(F.octet_length("text")).alias("octets"), X.within_bounds(c("text")).alias("within"))


@query("SELECT doc_id, length(source || lang) || ':' || source || lang AS encoded FROM documents")
def length_prefix(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.length_prefixed(F.concat("source", "lang")).alias("encoded"))


@query("SELECT p_partkey, list_extract(string_split(p_type, ' '), -1) AS leaf, CASE WHEN substr(p_name,1,1) IN ('=','+','-','@') THEN '''' || p_name ELSE p_name END AS cell, left(p_name, 8) AS short FROM part")
def cell_texts(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", X.leaf(F.replace("p_type", F.lit(" "), F.lit("/"))).alias("leaf"), X.guard_formula(c("p_name")).alias("cell"), F.left("p_name", F.lit(8)).alias("short"))


# Sources, streams and exports


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer FROM conversations GROUP BY 1")
def sse_fold(t: Tables) -> DataFrame:
    turns = t("conversations")
    events = turns.select(c("conv_id").alias("stream_id"), c("turn").alias("seq"), F.lit("answer").alias("kind"), c("text").alias("content"))
    ends = turns.groupBy(c("conv_id").alias("stream_id")).agg((F.max("turn") + 1).alias("seq")).select("stream_id", "seq", F.lit("complete").alias("kind"), F.lit("").alias("content"))
    return answers.fold(events.unionByName(ends)).select(c("stream_id").alias("conv_id"), "answer")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'partial' ELSE 'open' END AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def export_rows(t: Tables) -> DataFrame:
    rows = L.numbered(t("orders"), ["o_custkey"], [c("o_orderdate"), c("o_orderkey")], "position")
    return rows.select("o_orderkey", F.coalesce(P.label(c("o_orderstatus"), {"F": "done", "P": "partial"}), F.lit("open")).alias("status"), big(c("position")).alias("position"))


@query("SELECT c_custkey, to_json({'id': c_custkey, 'name': c_name}) AS body FROM customer")
def json_projection(t: Tables) -> DataFrame:
    return t("customer").select("c_custkey", F.to_json(F.struct(c("c_custkey").alias("id"), c("c_name").alias("name"))).alias("body"))


