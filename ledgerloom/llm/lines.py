"""Fuzzy duplicate lines by MinHash, in DataFrame functions alone.

A line's shingles are all runs of SHINGLE characters (a shorter line is one shingle). A line's sketch is its LEAST
smallest hashes among the least of SLOTS slots, and each two hashes of a sketch together are a bucket key. Exact copies
are one node, and every two nodes that share a bucket are decided: by their digests, which rule out most that are not alike
whatever their number, or else by the exact Jaccard similarity of all shingles; first each with its bucket's first node;
then, in buckets that still hold several components, each node outside the largest component with every node of another,
its nearest first. Pairs inside a component change nothing and are left out, so a family of near copies costs an exact
comparison or two a line. Components are found by star steps (distributed union-find); each keeps its first line.

Shingles are hashed as rows: a line is exploded to its positions, in one generated loop with the hash, and only hashes
that are small enough to be among the least of a line of that length become rows of the aggregate. Where too few of them
are left, as in lines that repeat themselves, all are taken. Digests and exact comparisons hold a line's hashes in an array.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, free_name
from ledgerloom.llm.common import written as common_written
from ledgerloom.llm.graph import components

SHINGLE = 12
#: each two of the five least hashes are a key: two lines of similarity 0.8 share none with probability 0.00125
LEAST = 5
#: hashes expected below a line's bound, and slots of which each keeps its least one
KEPT, SLOTS = 20, 16
#: a bucket of more than (4 * BLOCK) ** 2 pairs to decide has its nodes meet by their rarest shingles
BLOCK = 512
#: 64-bit words of a digest
WORDS = 16
#: shingles that one task of exact comparisons is given
PART = 1 << 21
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPACE = " \t\r\x0b\f"
_MAX = 2**63 - 1


def written(df: DataFrame, name: str) -> DataFrame:
    """As common's. What was shuffled for the table goes when it is written, and not when the driver happens to collect
    garbage: each of these tables takes one shuffle of all lines or more."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANED, None)
    conf.set(_CLEANED, "true")
    try:
        return common_written(df, name)
    finally:
        conf.unset(_CLEANED) if before is None else conf.set(_CLEANED, before)


def normal(line: Column) -> Column:
    """What lines are compared by: letter case and white space at the ends don't count."""
    return F.lower(F.btrim(line, F.lit(_SPACE)))


def occurrences(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text, content): a row with pos -1 and the number of lines in n for each document, and a row for
    each line that is not blank, with the normal line and its hash (lid). rid numbers the rows of ``docs``; it is made
    once, in a table that is written."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "content", F.coalesce("text", F.lit("")).alias("text"))
    split = F.split("text", "\n")
    rows = numbered.select("rid", "doc_id", "content", F.posexplode(F.concat(F.array(F.when(F.col("text") == "", F.lit("0")).otherwise(F.size(split).cast("string"))), split)).alias("at", "line"))
    head = F.col("at") == 0
    rows = rows.where(head | (F.btrim("line", F.lit(_SPACE)) != "")).select("rid", "doc_id", "content", (F.col("at") - 1).alias("pos"), F.when(head, F.col("line").cast("int")).alias("n"), F.when(~head, normal(F.col("line"))).alias("norm"))
    return rows.withColumn("lid", F.when(F.col("pos") >= 0, F.xxhash64("norm")))


def shingle_rows(lines: DataFrame, *keys: str, few: bool = False) -> DataFrame:
    """(keys, n, h): the hash of each of the n shingles of ``norm``, repeats included; those of a line that is longer
    than KEPT and does not seem to repeat itself, if ``few``, only up to the bound under which KEPT are expected."""
    n = F.greatest(F.char_length("norm") - (SHINGLE - 1), F.lit(1))
    code = F.encode("norm", "UTF-16BE")
    bound = F.lit(_MAX)
    if few:
        middle = F.substring("norm", (n / 2).cast("int") + 1, F.lit(SHINGLE))
        repeats = F.expr(f"locate(substring(norm, 1, {SHINGLE}), norm, 2) > 0") | (F.call_function("locate", middle, F.col("norm"), (n / 2).cast("int") + 2) > 0)
        bound = F.when((n > KEPT) & ~repeats, ((F.lit(float(KEPT)) / n - 0.5) * 2.0**64).cast("long")).otherwise(bound)
    # inline() keeps these from being computed anew for each position
    held = lines.select(*keys, "norm", F.inline(F.array(F.struct(n.alias("n"), code.alias("code"), bound.alias("bound"), (F.octet_length(code) != 2 * F.char_length("norm")).alias("pairs")))))
    placed = held.select(*keys, "norm", "n", "code", "bound", "pairs", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    own = F.when(F.col("pairs"), F.encode(F.substring("norm", F.col("i"), F.lit(SHINGLE)), "UTF-16BE")).otherwise(F.substring("code", 2 * F.col("i") - 1, F.lit(2 * SHINGLE)))
    rows = placed.select(*keys, "n", "bound", F.xxhash64(own).alias("h"))
    return (rows.where("h <= bound") if few else rows).select(*keys, "n", "h")


def _sketched(rows: DataFrame) -> DataFrame:
    slots = [F.min(F.when(F.col("h").bitwiseAND(SLOTS - 1) == k, F.col("h"))).alias(f"m{k}") for k in range(SLOTS)]
    least = F.slice(F.sort_array(F.array(*(F.coalesce(f"m{k}", F.lit(_MAX)) for k in range(SLOTS)))), 1, LEAST)
    return rows.groupBy("lid").agg(F.max("n").alias("n"), *slots).select("lid", "n", least.alias("s"))


def sketches(lines: DataFrame) -> DataFrame:
    """(lid, s) of lines (lid, norm): the LEAST least hashes, the largest number where there are fewer."""
    first = written(_sketched(shingle_rows(lines, "lid", few=True)), "sketches")
    poor = (F.col("n") > KEPT) & (F.get("s", F.lit(LEAST - 1)) == _MAX)
    lids = first.where(poor).select("lid")
    if lids.isEmpty():
        return first.select("lid", "s")
    whole = _sketched(shingle_rows(lines.join(lids, "lid", "left_semi"), "lid"))
    return first.where(~poor).unionByName(written(whole, "sketches")).select("lid", "s")


def buckets(held: DataFrame) -> DataFrame:
    """(lid, b): a key for each two hashes of a sketch (lid, s), or for its only one."""
    s = F.col("s")
    two = [F.when(s[j] != _MAX, F.xxhash64(s[i], s[j])) for i, j in combinations(range(LEAST), 2)]
    return held.select("lid", F.explode(F.array(*two, F.when(s[1] == _MAX, F.xxhash64(s[0])))).alias("b")).where("b IS NOT NULL")


def _hashes(norm: str) -> Column:
    """The hashes of the shingles of a line in the column ``norm``, whose code is beside it (``_dealt``), repeats included, as
    ``shingle_rows`` makes them."""
    text, code = F.col(norm), F.col(f"{norm}_code")
    n = F.greatest(F.char_length(text) - (SHINGLE - 1), F.lit(1))
    plain = F.transform(F.sequence(F.lit(1), 2 * n - 1, F.lit(2)), lambda i: F.xxhash64(F.substring(code, i, F.lit(2 * SHINGLE))))
    other = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.encode(F.substring(text, i, F.lit(SHINGLE)), "UTF-16BE")))
    return F.when(F.octet_length(code) == 2 * F.char_length(text), plain).otherwise(other)


def _dealt(df: DataFrame, *norms: str) -> DataFrame:
    """Dealt out so that a task has about PART shingles, with the code of each line."""
    total = df.agg(F.sum(reduce(lambda x, y: x + y, (F.char_length(x).cast("long") for x in norms)))).first()[0] or 0
    codes = F.inline(F.array(F.struct(*(F.encode(x, "UTF-16BE").alias(f"{x}_code") for x in norms))))
    return df.repartition(int(total // PART) + 1).select(*df.columns, codes)


def digests(texts: DataFrame) -> DataFrame:
    """(lid, n, x0, x1, ...) of nodes (lid, norm): the number of different shingles, and a bit for each value of a hash's
    lowest bits, which tells whether an odd number of them has it. What two nodes have in common cancels out of the
    exclusive or of their bits, so that no more bits differ than shingles are in one of the two alone."""
    # inline() and explode() keep what is before them from being computed anew
    sets = _dealt(texts, "norm").select("lid", F.inline(F.array(F.struct(_hashes("norm").alias("h")))))
    each = sets.select("lid", F.explode(F.array_distinct("h")).alias("h"))
    word, bit = F.expr(f"cast(h & {64 * WORDS - 1} as int) >> 6"), F.expr("shiftleft(1L, cast(h & 63 as int))")
    bits = [F.coalesce(F.bit_xor(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("long")).alias(f"x{k}") for k in range(WORDS)]
    return each.select("lid", word.alias("word"), bit.alias("bit")).groupBy("lid").agg(F.count("*").alias("n"), *bits)


def _as_side(df: DataFrame, side: str) -> DataFrame:
    return df.select("b", *(F.col(x).alias(f"{x}_{side}") for x in df.columns if x != "b")) if "b" in df.columns else df.select(*(F.col(x).alias(f"{x}_{side}") for x in df.columns))


def _differing() -> Column:
    """How many bits of the digests of two sides differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"x{k}_u").bitwiseXOR(F.col(f"x{k}_v"))) for k in range(WORDS)))


def may_be_similar(threshold: float) -> Column:
    """False only of two sides whose digests rule the threshold out: of sets that share s of t shingles, t - s are in one of
    the two alone, and (1 + s / t) (t - s) is (1 - s / t) times the sum of their sizes."""
    sizes = F.least("n_u", "n_v") >= threshold * F.greatest("n_u", "n_v") - 1e-6
    return sizes & ((1 + threshold) * _differing() <= (1 - threshold) * (F.col("n_u") + F.col("n_v")) + 1e-6)


def near_pairs(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) that the digests ``held`` don't rule out."""
    both = pairs.join(_as_side(held, "u").withColumnRenamed("lid_u", "u"), "u").join(_as_side(held, "v").withColumnRenamed("lid_v", "v"), "v")
    return both.where(may_be_similar(threshold)).select("u", "v")


def similar_pairs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v) of nodes those whose exact Jaccard similarity of shingles reaches the threshold."""
    both = pairs.join(texts.select(F.col("lid").alias("u"), F.col("norm").alias("nu")), "u").join(texts.select(F.col("lid").alias("v"), F.col("norm").alias("nv")), "v")
    both = written(both.select("u", "v", "nu", "nv"), "compared")
    total = both.agg(F.sum(F.char_length("nu").cast("long") + F.char_length("nv"))).first()[0]
    if total is None:
        return pairs.select("u", "v").limit(0)
    # all of a pair's shingles are in one task, and meet there without another shuffle
    sides = both.repartition(int(total // PART) + 1, "u", "v").select("u", "v", F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("nu").alias("norm")), F.struct(F.lit(2).alias("side"), F.col("nv").alias("norm")))))
    held = shingle_rows(sides, "u", "v", "side").groupBy("u", "v", "h").agg(F.bit_or("side").alias("side"))
    counts = held.groupBy("u", "v").agg(F.count("*").alias("t"), F.count(F.when(F.col("side") == 3, 1)).alias("s"))
    return counts.where(F.col("s") >= threshold * F.col("t") - 1e-9).select("u", "v")


def similar_pairs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v) of nodes those whose exact Jaccard similarity of shingles reaches the threshold."""
    both = pairs.join(texts.select(F.col("lid").alias("u"), F.col("norm").alias("nu")), "u").join(texts.select(F.col("lid").alias("v"), F.col("norm").alias("nv")), "v")
    both = _dealt(written(both.select("u", "v", "nu", "nv"), "compared"), "nu", "nv")
    sets = both.select("u", "v", F.inline(F.array(F.struct(_hashes("nu").alias("hu"), _hashes("nv").alias("hv")))))
    sets = sets.select("u", "v", F.inline(F.array(F.struct(F.array_distinct("hu").alias("hu"), F.array_distinct("hv").alias("hv")))))
    counts = sets.select("u", "v", (F.size("hu") + F.size("hv")).alias("k"), F.inline(F.array(F.struct(F.size(F.array_intersect("hu", "hv")).alias("s")))))
    return counts.where(F.col("s") >= threshold * (F.col("k") - F.col("s")) - 1e-9).select("u", "v")


def rare_shingles(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(lid, n, b) of nodes (lid): their rarest shingles, which two nodes that reach the threshold cannot both be without.
    Sets of n shingles share threshold * n of them at least, so that one of the other n - threshold * n + 1 is shared
    whichever these are; here they are those that fewest of the nodes have, without those that one node has alone."""
    held = written(shingle_rows(nodes.join(texts, "lid"), "lid").select("lid", "h").distinct(), "shingles")
    often = held.groupBy("h").agg(F.count("*").alias("f"))
    sets = held.join(often, "h").groupBy("lid").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("s")).withColumn("n", F.size("s"))
    few = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-6) + 1).cast("int"))
    return sets.select("lid", "n", F.explode(few).alias("x")).where("x.f > 1").select("lid", "n", F.col("x.h").alias("b"))


def _several(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of buckets that hold several components, with the bucket's size and that of its largest component."""
    named = met.join(roots.select(F.col("node").alias("lid"), "root"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    shares = named.groupBy("b", "root").agg(F.count("*").alias("k"))
    largest = shares.groupBy("b").agg(F.sum("k").alias("c"), F.max("k").alias("most"), F.max_by("root", F.struct("k", "root")).alias("big")).where("most < c")
    return named.join(largest, "b").withColumn("other", F.col("root") != F.col("big"))


def _to_decide(several: DataFrame, threshold: float) -> DataFrame:
    """(u, v, other, gap): each node outside its bucket's largest component (u) with every node of another component whose
    digest does not rule it out, with that component's root; the smaller the gap, the more alike they seem."""
    shown = several.select("b", "lid", "root", "other", "n", *(f"x{k}" for k in range(WORDS)))
    apart = (F.col("root_u") != F.col("root_v")) & (~F.col("other_v") | (F.col("lid_u") < F.col("lid_v")))
    both = _as_side(shown.where("other"), "u").join(_as_side(shown, "v"), "b").where(apart & may_be_similar(threshold))
    gap = (1 + threshold) * _differing() - (1 - threshold) * (F.col("n_u") + F.col("n_v"))
    return both.select(F.col("lid_u").alias("u"), F.col("lid_v").alias("v"), F.col("root_v").alias("other"), gap.alias("gap"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _work(several: DataFrame) -> int:
    """Comparisons of digests that the buckets ask for."""
    return several.select("b", "c", "most").distinct().agg(F.coalesce(F.sum((F.col("c") - F.col("most")) * F.col("c")), F.lit(0))).first()[0]


def _nearest(found: DataFrame) -> DataFrame:
    """Of each node and each component that it may belong to, the pair that seems most alike."""
    return found.groupBy("u", "other").agg(F.min_by("v", F.struct("gap", "v")).alias("v"))


def block_links(met: DataFrame, edges: DataFrame, known: DataFrame, texts: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links that connect all similar nodes that share a bucket of ``met`` (lid, b), with ``edges``, which are links
    that pairs ``known`` have given, decided before.

    In a bucket of several components, each node outside its largest one meets every node of another, by their digests.
    What these don't rule out is decided in two steps: first a node's nearest one of each other component; then, when
    components are joined by the links of these, all that is left between different ones. Where a bucket has more than
    (4 * BLOCK) ** 2 pairs, as with lines of one template that are not alike, its nodes meet in buckets of their rarest
    shingles instead, if these have fewer.
    """
    roots = written(components(edges), "roots")
    several = written(_several(met, roots).join(held, "lid"), "several")
    if several.isEmpty():
        return edges
    wide = (F.col("c") - F.col("most")) * F.col("c") > (4 * BLOCK) ** 2
    crowd = several.where(wide).select("lid").distinct()
    found = _to_decide(several, threshold)
    if not crowd.isEmpty():
        rare = written(_several(rare_shingles(crowd, texts, threshold).select("lid", "b"), roots).join(held, "lid"), "several")
        if _work(rare) < _work(several.where(wide)):
            found = _to_decide(several.where(~wide), threshold).unionByName(_to_decide(rare, threshold))
    found = written(found.groupBy("u", "v").agg(F.first("other").alias("other"), F.first("gap").alias("gap")), "found")
    nearest = written(_ordered(_nearest(found)).join(known, ["u", "v"], "left_anti"), "pairs")
    edges = edges.unionByName(written(similar_pairs(nearest, texts, threshold), "links"))
    roots = written(components(edges), "roots")
    ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv"]
    apart = found.select("u", "v").join(ends[0], "u", "left").join(ends[1], "v", "left").where("coalesce(root_u, u) <> coalesce(root_v, v)")
    left = _ordered(apart).join(known.unionByName(nearest), ["u", "v"], "left_anti")
    return edges.unionByName(written(similar_pairs(left, texts, threshold), "links"))


def line_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Documents (rid, doc_id, content, n_lines), and the lines (rid, pos) that repeat an earlier line of their component.

    The first line of a component is that of the smallest document id (null ids last), then of the earliest row,
    then the earliest line.
    """
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[id_col].cast("long"), docs[text_col]).alias("content"))
    table = written(occurrences(named), "lines")
    rows, lines = table.where("pos < 0").select("rid", "doc_id", "content", F.col("n").alias("n_lines")), table.where("pos >= 0")

    # dealt out once: the nodes of a bucket are counted, and joined to what is counted, where they lie
    dealt = buckets(sketches(lines.select("lid", "norm"))).repartition("b")
    leads = dealt.groupBy("b").agg(F.min("lid").alias("lead"), F.max("lid").alias("last")).where("lead <> last").select("b", "lead")
    met = written(dealt.join(leads.hint("shuffle_hash"), "b").select("lid", "b", "lead"), "met")
    pairs = written(met.where("lid <> lead").select(F.col("lead").alias("u"), F.col("lid").alias("v")).distinct(), "pairs")
    wanted = met.select("lid").distinct()
    texts = written(lines.select("lid", "norm").join(wanted.hint("shuffle_hash"), "lid", "left_semi").dropDuplicates(["lid"]), "texts")
    held = written(digests(texts), "digests")
    edges = written(similar_pairs(near_pairs(pairs, held, threshold), texts, threshold), "links")
    roots = components(block_links(met.select("lid", "b"), edges, pairs, texts, held, threshold))

    placed = lines.select("lid", "rid", "pos", "doc_id").join(roots.select(F.col("node").alias("lid"), "root"), "lid", "left").select(F.coalesce("root", "lid").alias("root"), "rid", "pos", "doc_id")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "pos")).alias("at"), F.count("*").alias("copies")).where("copies > 1")
    keep = written(first.select("root", F.col("at.rid").alias("krid"), F.col("at.pos").alias("kpos")), "repeated")
    gone = placed.join(keep, "root").where("rid <> krid OR pos <> kpos").select("rid", "pos")
    return rows, gone


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(rid, doc_id, content, n_lines, n_removed, removed), a row for each document: the numbers, from 0, of the lines
    that repeat an earlier line of the corpus, exactly or to a similarity of ``threshold``. content is a hash of id and text.

    Blank lines are never removed. Null and empty texts have no lines. Ids must be integers; a null id stays
    null, and rows that repeat an id are told apart by the order in which they are read. Other columns are
    ignored; no rows give no rows.
    """
    rows, gone = line_classes(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    gone = gone.groupBy("rid").agg(F.array_sort(F.collect_list("pos")).alias("removed"))
    out = rows.join(gone, "rid", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.select("rid", "doc_id", "content", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the lines that ``dedup_lines`` names taken out of the text; other columns stay as they are,
    whatever their names.

    All rows stay, unless ``drop_emptied`` is set: then those go that had words and have none left. Of rows that
    repeat both id and text, one keeps its lines and the others lose all that are not blank.
    """
    content, gone, again = (free_name(docs, x) for x in ("content", "removed", "again"))
    found = dedup_lines(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    found = written(found.groupBy("content").agg(F.min_by("removed", "rid").alias("removed"), F.count("*").alias("copies")), "removed")
    removed = found.where(F.size("removed") > 0).select(F.col("content").alias(content), F.col("removed").alias(gone))
    named = docs.withColumn(content, F.xxhash64(docs[id_col].cast("long"), docs[text_col])).withColumn(again, F.lit(False))
    twice = found.where("copies > 1").select(F.col("content").alias(content))
    if not twice.isEmpty():  # such rows are numbered in a table of their own, so that one of each stays first
        number = free_name(named, "number")
        several = written(named.join(twice, content, "left_semi").withColumn(number, F.monotonically_increasing_id()), "several")
        lead = several.groupBy(content).agg(F.min(number).alias("lead"))
        several = several.join(lead, content).withColumn(again, F.col(number) != F.col("lead")).select(named.columns)
        named = named.join(twice, content, "left_anti").select(named.columns).unionByName(several)
    rows = named.join(removed, content, "left")
    text = F.col(text_col)
    left = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i))
    blank = F.filter(F.split(text, "\n"), lambda x: ~x.rlike("[^ \\t\\r\\x0b\\f]"))
    changed = F.col(again) | F.col(gone).isNotNull()
    rows = rows.withColumn(text_col, F.when(F.col(again), F.array_join(blank, "\n")).when(F.col(gone).isNull(), text).otherwise(F.array_join(left, "\n")))
    if drop_emptied:
        rows = rows.where(~changed | F.col(text_col).rlike("\\S"))
    return rows.select(docs.columns)
