"""Reconciliation of scanned candidates, page by page: groups, representatives, anchors and what failures mean.

A model judges one representative of each business path; its conclusion holds for all candidates of that path. The
pages of one task are judged in turn, but which page's conclusion a later candidate takes is the first one in page
order, so the whole can be stated as one aggregate by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.ids import UNIT
from ledgerloom.operators.tables import written
from ledgerloom.plans.review import target_paths

PAGE = 8
MACHINE = ["documentId", "unitId", "candidateIds", "groupAnchorId"]
# Texts of contract failures and their categories, and the labels of categories and conclusions.
FAILURES = {
    "MISSING_TARGET": [
        "Each page representative candidateId must have exactly one conclusion",
        "Each page target candidateId must have exactly one conclusion",
        "Each page conclusion must contain exactly one target candidateId",
        "Every retained candidate requires exactly one page conclusion",
    ],
    "REPRESENTATIVE_BINDING": [
        "Grouped representative evidence must contain one exact binding token",
        "Grouped representative evidence must bind its exact documentId and unitId",
        "Grouped representative evidence must bind its exact candidateId",
        "Conclusion evidence must retain each candidate documentId and unitId",
    ],
    "BUSINESS_PATH_STRUCTURE": [
        "Only SPLIT conclusions may contain multiple business paths",
        "SPLIT conclusions require explicit <br> separated business paths",
        "Business path must not be blank",
        "Business paths must be plain text",
        "SPLIT conclusions require distinct business paths",
        "Each grouped representative must retain its normalized business path",
    ],
    "NORMALIZED_PATH_CONFLICT": ["Each normalized business path must retain one groupAnchorId and conclusion type"],
    "ANCHOR_CONFLICT": [
        "Each groupAnchorId must reference a retained global candidate",
        "Each groupAnchorId must not point after its target candidate",
        "Each groupAnchorId must reference a self-anchored global candidate",
        "Each conclusion must contain one valid groupAnchorId",
        "Every anchored group must have one exact type and business path",
        "Every anchored group must close on a global candidate",
    ],
}
STRICT = "Expected strict final reconciliation Markdown with"
MISSING_PREFIXES = [f"{STRICT} every retained candidateId exactly once", f"{STRICT} only retained candidateIds", f"{STRICT} candidateIds= token"]
RECHECKED = ["MISSING_TARGET", "REPRESENTATIVE_BINDING", "BUSINESS_PATH_STRUCTURE"]
CATEGORY_LABELS = {
    "STRICT_MARKDOWN": "Markdown 格式不符合约定",
    "MISSING_TARGET": "目标覆盖不完整",
    "REPRESENTATIVE_BINDING": "代表项证据绑定不正确",
    "BUSINESS_PATH_STRUCTURE": "业务路径结构不符合约定",
    "ANCHOR_CONFLICT": "锚点关系不一致",
    "NORMALIZED_PATH_CONFLICT": "同一业务路径结论不一致",
    "UNKNOWN_CONTRACT": "固定合同未满足",
}


def failure_category(message: Column) -> Column:
    """The closed category of a contract failure, by whole text or by its beginning; unknown and null ones are one too."""
    out = F.when(F.array_contains(F.transform(F.array(*map(F.lit, MISSING_PREFIXES)), lambda p: message.startswith(p)), True), "MISSING_TARGET")
    for category, texts in FAILURES.items():
        out = out.when(message.isin(texts), category)
    return out.when(message.startswith(STRICT), "STRICT_MARKDOWN").otherwise("UNKNOWN_CONTRACT")


def may_recheck_alone(category: Column) -> Column:
    return category.isin(RECHECKED)


def feedback(message: Column, exact: dict[str, str], contained: dict[str, str], other: str, before: str = "") -> Column:
    """The text that a retry is given: that of the whole message, else of the first key (in the order given) that the
    message contains, else ``other``; all after ``before``. A null message gets ``other``."""
    out = F.lit(other)
    for key, value in reversed(contained.items()):
        out = F.when(message.contains(key), value).otherwise(out)
    for key, value in exact.items():
        out = F.when(message == key, value).otherwise(out)
    return F.concat(F.lit(before), out)


def anchor(evidence: Column) -> Column:
    """The one groupAnchorId token's value, null if there is none, several or a blank one."""
    return X.token(evidence, "groupAnchorId")


def _with_path(candidates: DataFrame) -> DataFrame:
    rows = candidates.where("task_id IS NOT NULL").withColumn("path", X.normal_path_in_rows(F.col("feature_text")))
    return rows.withColumn("path", F.when(X.is_blank(F.col("feature_text")), F.concat(F.lit("\x00"), "occurrence_id")).otherwise(F.col("path")))


def _numbered(rows: DataFrame, size: int) -> DataFrame:
    """Number and count from the one order of the task's rows; what comes after finds them dealt out by task."""
    task = Window.partitionBy("task_id")
    rows = rows.withColumns({"position_index": F.row_number().over(task.orderBy("position", "occurrence_id")) - 1, "pages": F.ceil(F.count("*").over(task) / size).cast("int")})
    return rows.withColumn("page", F.floor(F.col("position_index") / size).cast("int") + 1)


def pages(candidates: DataFrame, size: int = PAGE) -> DataFrame:
    """``candidates`` (task_id, occurrence_id, position, feature_text ...) with position_index from 0, page from 1, pages,
    and path: the normal form of the business path, or one of its own for a candidate without a path."""
    return _numbered(_with_path(candidates), size)


def groups(paged: DataFrame) -> DataFrame:
    """(task_id, page, path, representative, members): the groups of each page, in first-seen order within it."""
    out = paged.groupBy("task_id", "page", "path").agg(F.min_by("occurrence_id", "position_index").alias("representative"), F.min("position_index").alias("first_index"), F.transform(F.array_sort(F.collect_list(F.struct("position_index", "occurrence_id"))), lambda x: x["occurrence_id"]).alias("members"))
    return out.withColumn("group_number", F.row_number().over(Window.partitionBy("task_id", "page").orderBy("first_index")))


def settled(paged: DataFrame, judged: DataFrame) -> DataFrame:
    """For each group of each page the conclusion that holds: (task_id, page, path, source_id, type, explanation,
    evidence, reused). ``judged`` has what a model says of candidates: task_id, occurrence_id, type, explanation,
    evidence. The first page that has a path is judged by its representative there; later pages take that conclusion
    over if it keeps the single path of the group, else their own representative is judged anew."""
    own = groups(paged).select("task_id", "page", "path", "representative").join(judged.withColumnRenamed("occurrence_id", "representative"), ["task_id", "representative"], "left")
    keeps = (F.col("type") != "SPLIT") & (F.col("_said") == F.col("path"))
    own = X.with_normal_path(own, "explanation", "_said").withColumn("keeps", F.coalesce(keeps, F.lit(False))).drop("_said")
    # the first page that keeps the path: first accepted wins, for all pages after it
    first = own.where("keeps").groupBy("task_id", "path").agg(F.min(F.struct("page", F.col("representative").alias("source_id"), "type", "explanation", "evidence")).alias("f"))
    both = own.join(first, ["task_id", "path"], "left")
    reused = F.coalesce(F.col("f.page") < F.col("page"), F.lit(False))
    pick = lambda c, mine: F.when(reused, F.col(f"f.{c}")).otherwise(F.col(mine)).alias(c)
    return both.select("task_id", "page", "path", pick("source_id", "representative"), pick("type", "type"), pick("explanation", "explanation"), pick("evidence", "evidence"), reused.alias("reused"))


def concluded(candidates: DataFrame, judged: DataFrame, size: int = PAGE) -> DataFrame:
    """``pages`` of the candidates, each row with what ``settled`` says of its group (source_id, type, explanation,
    evidence, reused), and leads: whether it is its group's representative. ``judged`` has a row a candidate at most. Both
    are dealt out by task once, and all that follows is said by windows there: nothing is joined with itself."""
    said = judged.where("task_id IS NOT NULL AND occurrence_id IS NOT NULL").withColumn("_said", X.normal_path_in_rows(F.col("explanation")))
    said = said.select("task_id", "occurrence_id", F.struct("type", "explanation", "evidence", "_said").alias("_told"))
    rows = _with_path(candidates).withColumn("_own", F.lit(True)).unionByName(said, allowMissingColumns=True).repartition("task_id")
    rows = rows.withColumn("_told", F.max("_told").over(Window.partitionBy("task_id", "occurrence_id"))).where("_own").drop("_own")
    group = Window.partitionBy("task_id", "page", "path").orderBy("position_index")
    mine = F.struct("page", F.col("occurrence_id").alias("source_id"), "_told.type", "_told.explanation", "_told.evidence", "_told._said")
    rows = _numbered(rows, size).withColumns({"_mine": F.first(mine).over(group), "leads": F.row_number().over(group) == 1})
    keeps = (F.col("_mine.type") != "SPLIT") & (F.col("_mine._said") == F.col("path"))
    # the first page that keeps the path: first accepted wins, for all pages after it
    rows = rows.withColumn("_first", F.min(F.when(F.col("leads") & keeps, F.col("_mine"))).over(Window.partitionBy("task_id", "path")))
    rows = rows.withColumn("reused", F.coalesce(F.col("_first.page") < F.col("page"), F.lit(False)))
    picked = {x: F.when(F.col("reused"), F.col(f"_first.{x}")).otherwise(F.col(f"_mine.{x}")) for x in ("source_id", "type", "explanation", "evidence")}
    return rows.withColumns(picked).drop("_told", "_mine", "_first")


def projected(paged: DataFrame, conclusions: DataFrame) -> DataFrame:
    """A conclusion for every candidate: its group's, with the evidence bound to the candidate. The candidate keeps the
    words of its own evidence; the group's anchor stays. ``conclusions`` is that of ``settled``."""
    return bound(paged.join(conclusions, ["task_id", "page", "path"]))


def bound(rows: DataFrame) -> DataFrame:
    """``projected`` for rows that have their group's conclusion, as ``concluded`` gives them; of its evidence only the
    anchor counts."""
    reader = X.without_tokens(F.col("evidence_text"), MACHINE)
    own = F.concat_ws("; ", F.concat(F.lit("documentId="), "document_id"), F.concat(F.lit("unitId="), "unit_id"), F.concat(F.lit("candidateIds="), "occurrence_id"), F.concat(F.lit("groupAnchorId="), F.coalesce(anchor(F.col("evidence")), F.lit(""))), F.when(reader != "", reader))
    return rows.select("task_id", "position_index", "page", "occurrence_id", "document_id", "unit_id", "type", "explanation", own.alias("evidence"), "source_id")


def page_violations(conclusions: DataFrame) -> DataFrame:
    """(rule, key, detail) for the conclusions of candidates (as ``projected`` gives them): anchors that are unknown, come
    later, are not their own anchor, or judge otherwise; and paths with two anchors or types."""
    # read three times: by anchor, as anchors, and by path
    own = written(conclusions.select("task_id", "occurrence_id", "position_index", "type", "explanation", anchor(F.col("evidence")).alias("anchor")), "anchored")
    to = own.select("task_id", F.col("occurrence_id").alias("anchor"), F.col("position_index").alias("at"), F.col("type").alias("t"), F.col("explanation").alias("e"), F.col("anchor").alias("aa"))
    pairs = own.join(to, ["task_id", "anchor"], "left")
    known = F.col("at").isNotNull()
    rule = lambda name, broken, detail: F.when(broken, F.struct(F.lit(name).alias("rule"), detail.alias("detail")))
    rules = F.array(
        rule("known anchor", ~known, F.coalesce("anchor", F.lit("none"))),
        rule("earlier anchor", known & (F.col("at") > F.col("position_index")), F.col("anchor")),
        rule("self-anchored", known & ~F.col("aa").eqNullSafe(F.col("anchor")), F.col("anchor")),
        rule("one type and path", known & ((F.col("type") != F.col("t")) | (F.col("explanation") != F.col("e"))), F.col("anchor")),
    )
    broken = pairs.select(F.concat_ws("|", "task_id", "occurrence_id").alias("key"), F.explode(F.array_compact(rules)).alias("r"))
    paths = target_paths(own.select("task_id", F.col("occurrence_id").alias("id"), F.col("type").alias("conclusion_type"), "explanation", "anchor"))
    disposed = paths.where("error IS NULL").groupBy("task_id", "normal").agg(F.countDistinct(F.struct("conclusion_type", "anchor")).alias("n")).where("n > 1")
    paths_twice = disposed.select(F.lit("one disposition").alias("rule"), F.concat_ws("|", "task_id", "normal").alias("key"), F.col("n").cast("string").alias("detail"))
    return broken.select("r.rule", "key", "r.detail").unionByName(paths_twice)


def merged(conclusions: DataFrame) -> DataFrame:
    """One conclusion for each anchor, in the order of the anchors' positions: the members' evidence joined in order, and
    an identity over sequence, type, path, evidence and members."""
    rows = conclusions.withColumn("anchor", anchor(F.col("evidence")))
    member = F.array_sort(F.collect_list(F.struct("position_index", "occurrence_id", "evidence")))
    out = rows.groupBy("task_id", "anchor").agg(F.max_by("type", F.col("occurrence_id") == F.col("anchor")).alias("type"), F.max_by("explanation", F.col("occurrence_id") == F.col("anchor")).alias("explanation"), F.max(F.when(F.col("occurrence_id") == F.col("anchor"), F.col("position_index"))).alias("at"), member.alias("m"))
    out = out.where("at IS NOT NULL").withColumns({"evidence": F.array_join(F.transform("m", lambda x: x["evidence"]), "; "), "candidate_ids": F.transform("m", lambda x: x["occurrence_id"])})
    out = out.withColumn("sequence", F.row_number().over(Window.partitionBy("task_id").orderBy("at")))
    identity = F.sha2(F.concat_ws(UNIT, F.col("sequence").cast("string"), "type", "explanation", "evidence", F.array_join("candidate_ids", ",")), 256)
    return out.select("task_id", identity.alias("id"), "sequence", "type", "explanation", "evidence", "candidate_ids")


def path_conflicts(conclusions: DataFrame) -> DataFrame:
    """(task_id, path, targets, earliest): paths on which a page's conclusions differ in type or anchor, with the
    candidates in order; the earliest would be the anchor of all."""
    rows = conclusions.select("task_id", "position_index", "occurrence_id", F.col("occurrence_id").alias("id"), F.col("type").alias("conclusion_type"), "explanation", anchor(F.col("evidence")).alias("anchor"))
    paths = target_paths(rows).where("error IS NULL")
    out = paths.groupBy("task_id", F.col("normal").alias("path")).agg(F.countDistinct(F.struct("conclusion_type", "anchor")).alias("kinds"), F.array_sort(F.collect_set(F.struct("position_index", "occurrence_id"))).alias("m"))
    out = out.where((F.col("kinds") > 1) & (F.size("m") > 1))
    return out.select("task_id", "path", F.transform("m", lambda x: x["occurrence_id"]).alias("targets"), F.get("m", F.lit(0))["occurrence_id"].alias("earliest"))


def exact_references(conclusions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(task_id, id, candidate_id) of conclusions (task_id, id, evidence, candidate_ids) whose evidence lacks the exact
    coordinate pair of one of its candidates, or that name no known one."""
    rows = conclusions.select("task_id", "id", "evidence", F.explode("candidate_ids").alias("candidate_id"))
    own = candidates.select("task_id", F.col("occurrence_id").alias("candidate_id"), "document_id", "unit_id")
    both = rows.join(own, ["task_id", "candidate_id"], "left")
    return both.where(~F.coalesce(X.has_coordinate_pair(F.col("evidence"), F.col("document_id"), F.col("unit_id")), F.lit(False))).select("task_id", "id", "candidate_id")
