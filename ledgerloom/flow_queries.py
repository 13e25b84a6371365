"""Queries of the flows: event streams, leases, acceptance, paged reads, reconciliation and scans in rounds, each with
DuckDB SQL. Frames are those of ``ledger_queries`` and a few more, made from the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import ledger_queries as Q
from ledgerloom.operators.tables import shared_dir, written
from ledgerloom.plans import reconcile as R
from ledgerloom.plans import rounds as N
from ledgerloom.plans.live import LiveProgress
from ledgerloom.sinks.accepted import AcceptedStore
from ledgerloom.streaming import calls as C
from ledgerloom.streaming import leases as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
big = lambda x: x.cast("bigint")

FRAMES = {
    # orders are streams, their lines are events; of every tenth order the lines' own numbers, which have gaps
    "turns": """SELECT 'S' || k AS stream_id, CAST(CASE WHEN k % 10 = 0 THEN l ELSE n END AS BIGINT) AS seq, 'p' || part AS words, 'c' || (CASE WHEN part % 7 = 0 THEN 1 ELSE 0 END) AS id, part % 5 > 0 AS success,
        CASE WHEN k % 4 < 2 THEN CASE n WHEN 1 THEN CASE WHEN part % 2 = 1 THEN 'declared' ELSE 'answer' END WHEN 2 THEN 'call' WHEN 3 THEN 'result' WHEN 4 THEN CASE WHEN part % 11 = 0 THEN 'call' ELSE 'answer' END ELSE 'complete' END
          WHEN k % 4 = 2 THEN CASE n WHEN 1 THEN 'call' WHEN 2 THEN 'result' ELSE 'complete' END
          ELSE CASE part % 12 WHEN 6 THEN 'other' WHEN 7 THEN 'not a message' WHEN 8 THEN 'not json' WHEN 9 THEN 'no type' WHEN 10 THEN 'forbidden tool' WHEN 11 THEN 'error' ELSE CASE WHEN n >= 3 THEN 'complete' ELSE 'answer' END END END AS kind
        FROM (SELECT l_orderkey AS k, l_linenumber AS l, part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM {lines}) AS x""",
}
ALL = {**Q.FRAMES, **FRAMES}
WITH = Q.WITH + ", " + ", ".join(f"{name} AS ({sql.format_map(Q.DRIVER | {n: n for n in ALL})})" for name, sql in FRAMES.items())


class Tables(Q.Tables):
    def __call__(self, name: str) -> DataFrame:
        if name in FRAMES and name not in self.made:
            self.made[name] = self.spark.sql(FRAMES[name], **{n: self(n) for n in [*ALL, *Q.DRIVER] if f"{{{n}}}" in FRAMES[name]})
        return super().__call__(name)


def query(sql: str | None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a query under its name; SQL that begins with a comma adds frames of its own."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = f"{WITH}{', ' if sql.lstrip().startswith(',') else ' '}{sql.lstrip().removeprefix(',')}"
        return f

    return add


def _raw(turns: DataFrame) -> DataFrame:
    """The turns as raw events of a server: a name and JSON data."""
    kind = c("kind")
    tool = lambda name, *more: F.to_json(F.struct(F.lit("tool_call").alias("response_type"), F.struct(F.lit(name).alias("tool_name"), *more).alias("data")))
    typed = lambda name, *more: F.to_json(F.struct(F.lit(name).alias("response_type"), *more))
    data = (
        F.when(kind == "declared", tool("read_skill", c("id").alias("call_id")))
        .when(kind == "call", tool("read_skill", c("id").alias("tool_call_id"), F.struct(F.lit("reader").alias("skill_name")).alias("arguments")))
        .when(kind == "result", F.to_json(F.struct(F.lit("tool_result").alias("response_type"), F.struct(c("id"), c("success")).alias("data"))))
        .when(kind == "complete", typed("complete", F.lit(True).alias("done")))
        .when(kind == "error", typed("error", F.lit(True).alias("done"), F.lit("m").alias("message")))
        .when(kind == "forbidden tool", tool("shell"))
        .when(kind == "other", tool("execute_skill_script"))
        .when(kind == "not json", F.lit("{"))
        .when(kind == "no type", F.to_json(F.struct(c("words").alias("content"))))
        .otherwise(typed("answer", c("words").alias("content")))
    )
    return turns.select("stream_id", "seq", F.when(kind == "not a message", "ping").otherwise("message").alias("event"), data.alias("data"))


@query(""", e AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) = seq AS counts, CASE WHEN kind = 'answer' THEN words ELSE '' END AS content FROM turns),
  first AS (SELECT stream_id, min(seq) AS called_at, arg_min(id, seq) AS id FROM e WHERE counts AND kind = 'call' GROUP BY 1),
  ends AS (SELECT stream_id, min(seq) AS stop, arg_min(CASE WHEN kind = 'call' THEN 'repeated call' ELSE kind END, seq) AS why FROM e LEFT JOIN first USING (stream_id)
    WHERE counts AND (kind IN ('complete', 'not a message', 'not json', 'no type', 'forbidden tool', 'error') OR kind = 'call' AND seq > called_at) GROUP BY 1),
  live AS (SELECT e.*, CASE WHEN stop IS NULL OR called_at < stop THEN called_at END AS called_at, CASE WHEN stop IS NULL OR called_at < stop THEN first.id END AS own FROM e LEFT JOIN ends USING (stream_id) LEFT JOIN first USING (stream_id) WHERE counts AND (stop IS NULL OR seq < stop)),
  told AS (SELECT stream_id, string_agg(content, '' ORDER BY seq) AS answer, sum(length(content)) AS size, max(called_at) AS called_at, arg_min(success, seq) FILTER (kind = 'result' AND id = own AND seq > called_at) AS good,
    count(*) FILTER (kind = 'result') AS results, count(DISTINCT id) FILTER (kind = 'declared' AND (own IS NULL OR id <> own OR seq > called_at)) AS opened FROM live GROUP BY 1),
  s AS (SELECT e.stream_id, max(why) AS why, coalesce(max(size), 0) AS size, coalesce(max(answer), '') AS answer, coalesce(max(opened), 0) AS opened, CASE WHEN max(called_at) IS NOT NULL AND max(good) IS NULL THEN 1 ELSE 0 END AS calls, max(good) AS good,
    coalesce(max(results), 0) - CASE WHEN max(good) IS NULL THEN 0 ELSE 1 END AS unknown, bool_and(counts) AS whole FROM e LEFT JOIN ends USING (stream_id) LEFT JOIN told USING (stream_id) GROUP BY 1),
  t AS (SELECT *, CASE WHEN size > 12 THEN 'oversized answer' WHEN why = 'complete' THEN CASE WHEN opened > 0 THEN 'open declaration' WHEN calls > 0 THEN 'open call' WHEN NOT good THEN 'failed call' WHEN good THEN 'complete' ELSE 'no evidence' END
    WHEN why IS NOT NULL THEN why WHEN whole THEN 'unterminated' ELSE 'torn' END AS status FROM s)
  SELECT stream_id, CASE WHEN status = 'complete' THEN answer END AS answer, status, CAST(CASE WHEN told THEN opened END AS BIGINT) AS open_declarations, CAST(CASE WHEN told THEN calls END AS BIGINT) AS open_calls, CAST(CASE WHEN told THEN unknown END AS BIGINT) AS unknown_results
  FROM (SELECT *, why = 'complete' AND size <= 12 AS told FROM t)""")  # fmt: skip
def answer_calls(t: Tables) -> DataFrame:
    # dealt out by stream before the events are made, narrow as the turns are, and not again
    return C.fold(C.classify(_raw(t("turns").repartition(t.parts, "stream_id")), skill="reader", max_characters=1000), limit=12, evidence=True)


# Leases and acceptance


@query(None)
def lease_changes(t: Tables) -> DataFrame:
    """Users are pools, events tell of tasks; a sequence by pool, which SQL does not express."""
    kind = F.when(c("event_type") == "view", "queued").when(c("event_type") == "click", "done").when(c("event_type") == "error", "failed").otherwise("beat")
    events = t("events").select(F.concat(F.lit("P"), c("user_id") % 50).alias("pool"), F.concat(F.lit("T"), F.floor(c("event_id") / 8)).alias("task_id"), kind.alias("kind"), c("ts").alias("at"))
    return S.lease_log(events, slots=5, lease_ms=300_000)


def _deliver(store: AcceptedStore, rows: DataFrame) -> AcceptedStore:
    """Three epochs, the second delivered twice, and the first one's rows once more at the end."""
    for number, epoch in enumerate((0, 1, 1, 2, 0)):
        store.accept(rows.where(c("epoch") == epoch).drop("epoch"), epoch if number < 4 else 3)
    return store


@query(""", d AS (SELECT 'B' || l_orderkey AS batch_id, 'A' || (part % 3) AS attempt_id, l_linenumber AS row_sequence, CAST(l_linenumber % 3 AS BIGINT) AS epoch FROM lines),
  f AS (SELECT batch_id, min(epoch) AS epoch FROM d GROUP BY 1), w AS (SELECT batch_id, epoch, min(attempt_id) AS attempt_id FROM d JOIN f USING (batch_id, epoch) GROUP BY 1, 2)
  SELECT batch_id, attempt_id, row_sequence, epoch FROM d JOIN w USING (batch_id, epoch, attempt_id)""")
def durable_acceptance(t: Tables) -> DataFrame:
    rows = t("lines").selectExpr("'B' || l_orderkey AS batch_id", "'A' || (part % 3) AS attempt_id", "l_linenumber AS row_sequence", "l_linenumber % 3 AS epoch")
    store = AcceptedStore(t.spark, f"{shared_dir(t.spark)}/accepted-{uuid.uuid4().hex}", ["batch_id"], "attempt_id")
    return _deliver(store, rows).rows()


@query(""", d AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber % 3 AS epoch, part % 2 AS v, part % 5 AS w FROM lines)
  SELECT k, n, 'insert' AS outcome, CAST(epoch AS BIGINT) AS epoch FROM d UNION ALL SELECT k, n, CASE WHEN w = 0 THEN 'conflict' ELSE 'same' END, 3 FROM d WHERE epoch = 0""")
def replayed_rows(t: Tables) -> DataFrame:
    rows = t("lines").selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_linenumber % 3 AS epoch", "part % 2 AS v", "part % 5 AS w")
    store = AcceptedStore(t.spark, f"{shared_dir(t.spark)}/accepted-{uuid.uuid4().hex}", ["k", "n"])
    for epoch in (0, 1, 2):
        store.accept(rows.where(c("epoch") == epoch).select("k", "n", "v"), epoch)
    store.accept(rows.where("epoch = 0").select("k", "n", F.when(c("w") == 0, c("v") + 2).otherwise(c("v")).alias("v")), 3)
    return store.outcomes()


# Rounds


@query(Q._SETTLED + " SELECT task_id, CAST(page AS BIGINT) AS page, path, source_id, type, explanation, reused FROM settled")
def reconciled_rounds(t: Tables) -> DataFrame:
    """The model's answers come from a table; every 41st target is left out until it is asked for the second time, and
    every 43rd while it is asked for with others."""
    # the model's table is made once, not at every attempt that asks it
    t.keep("lines")
    table = written(t("judged").select("task_id", "occurrence_id", "type", "explanation", "evidence").join(t("candidates").select("occurrence_id", "part"), "occurrence_id"), "answers_of_the_model")

    def ask(requests: DataFrame) -> DataFrame:
        each = requests.select("task_id", "page", "alone", "attempt", F.explode("targets").alias("t")).select("task_id", "page", "alone", "attempt", "t.occurrence_id")
        out = each.join(table, ["task_id", "occurrence_id"])
        return out.where("(part % 41 > 0 OR attempt > 1) AND (part % 43 > 0 OR alone <> '')").select("task_id", "page", "alone", "occurrence_id", "type", F.when(c("type") == "SPLIT", F.concat("explanation", F.lit("<br>Second"))).otherwise(c("explanation")).alias("explanation"), "evidence")

    got = N.reconcile_in_rounds(R.pages(t("candidates")), ask)
    plain = F.when(c("type") == "SPLIT", F.substring_index("explanation", "<br>", 1)).otherwise(c("explanation"))
    return got.conclusions.select("task_id", big(c("page")).alias("page"), "path", "source_id", "type", plain.alias("explanation"), "reused")


@query(""", found AS (SELECT 'U' || l_orderkey AS unit_id, 'L' || (part % 7) AS line, 1 + part % 3 AS at_pass, l_orderkey % 50 = 0 AS fails FROM lines),
  firsts AS (SELECT unit_id, line, min(at_pass) AS at_pass, max(fails) AS fails FROM found GROUP BY 1, 2),
  u AS (SELECT unit_id, max(fails) AS fails, CASE WHEN NOT bool_or(at_pass = 1) THEN 1 WHEN NOT bool_or(at_pass = 2) THEN 2 WHEN NOT bool_or(at_pass = 3) THEN 3 ELSE 4 END AS n FROM firsts GROUP BY 1),
  e AS (SELECT unit_id, CASE WHEN fails AND n >= 2 THEN 2 ELSE n END AS passes, fails AND n >= 2 AS failed FROM u)
  SELECT unit_id, CAST(passes AS BIGINT) AS passes, NOT failed AS converged, failed, (SELECT count(*) FROM firsts f WHERE f.unit_id = e.unit_id AND f.at_pass < e.passes) AS accepted FROM e""")
def scanned_rounds(t: Tables) -> DataFrame:
    """A pass finds the lines of its own number and all before; every 50th unit's second pass fails."""
    found = t("lines").selectExpr("'U' || l_orderkey AS unit_id", "'L' || (part % 7) AS line", "1 + part % 3 AS at_pass", "l_orderkey % 50 = 0 AS fails")
    found = written(found, "found")  # made of the line items once, not at every pass

    def scan(asked: DataFrame, added: DataFrame | None, number: int) -> tuple[DataFrame, DataFrame]:
        rows = found.join(asked, "unit_id", "left_semi")
        return rows.where(c("at_pass") <= number).select("unit_id", "line"), rows.where(F.lit(number == 2) & c("fails")).select("unit_id").distinct()

    got = N.scan_in_rounds(found, scan, unit=["unit_id"], content=["line"], max_passes=None)
    counts = got.accepted.groupBy("unit_id").agg(F.count("*").alias("accepted"))
    return got.units.join(counts, "unit_id", "left").select("unit_id", big(c("passes")).alias("passes"), "converged", "failed", F.coalesce("accepted", F.lit(0)).alias("accepted"))


# Progress from changes


@query("," + Q.ORACLES["task_progress"].removeprefix(Q.WITH).lstrip().removeprefix(","))
def live_progress(t: Tables) -> DataFrame:
    """Three batches of changes that add up to the frames: half of the rows, with work that is still queued and
    conclusions of another type; their corrections and the other half; and accepted batches that go and come back."""
    names = {"documents": "inventory", "units": "units", "work": "work", "candidates": "candidates", "links": "links", "conclusions": "conclusions", "frozen": "targets", "batches": "batches", "cases": "cases"}
    tables = {k: t(v) for k, v in names.items()}
    half = {k: F.pmod(F.xxhash64(*df.columns), F.lit(2)) == 0 for k, df in tables.items()}
    sign = lambda df, n: df.withColumn("sign", F.lit(n))
    wrong = {"work": ("status", "QUEUED"), "conclusions": ("conclusion_type", "SPLIT")}
    first, second = {}, {}
    for k, df in tables.items():
        first[k], second[k] = sign(df.where(half[k]), 1), sign(df.where(~half[k]), 1)
        if k in wrong:
            column, value = wrong[k]
            early = df.where(~half[k]).withColumn(column, F.lit(value))
            first[k] = first[k].unionByName(sign(early, 1))
            second[k] = second[k].unionByName(sign(early, -1))
    taken = tables["batches"].where("status = 'ACCEPTED'")
    third = {"batches": sign(taken, -1).unionByName(sign(taken, 1)), "cases": sign(tables["cases"], 1).unionByName(sign(tables["cases"], -1))}
    live = LiveProgress(t.spark, f"{shared_dir(t.spark)}/live-{uuid.uuid4().hex}")
    for number, changes in enumerate((first, second, third)):
        live.apply(changes, number)
    return live.progress(t("tasks")).select("task_id", *Q.PROGRESS_COLUMNS)
