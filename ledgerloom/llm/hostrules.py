"""Quality rules by document and by host, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut

SPACE = "[ \\t\\n\\x0B\\f\\r]"
SYMBOLS = "[#*$%&|<>]"


def base_metrics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", width: int = 8) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), a row for each document.

    A null text counts as empty: all figures are zero. Windows of ``width`` words are compared by 64-bit
    hashes within their document. Each step is a projection of its own because its result is read many
    times in the next one's lambdas; only documents with a repeated window are sorted.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    step = docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("host"), text.alias("t"))
    step = step.select(
        "doc_id",
        "host",
        F.array_remove(F.split("t", f"{SPACE}+"), "").alias("w"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"),
    )
    step = step.select(
        "doc_id",
        "host",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > width, F.transform(F.sequence(F.lit(1), F.size("w") - (width - 1)), lambda i: F.xxhash64(F.slice("w", i, width)))).alias("h"),
    )
    found = ("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    step = step.select(*found, F.when(repeats, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda k: F.get("s", k)["h"].eqNullSafe(F.get("s", k + 1)["h"])
    twice = F.filter(F.transform("s", lambda x, k: F.when(same(k) | ((k > 0) & same(k - 1)), x["i"])), lambda i: i.isNotNull())
    step = step.select(*found, F.array_sort(twice).alias("p"))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("p") - 2),
        F.lit(width).cast("long"),
        lambda total, k: total + F.least(F.lit(width), F.get("p", k + 1) - F.get("p", k)).cast("long"),
    )
    return step.select(*found, F.when(F.size("p") > 1, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def base_rules() -> dict[str, Column]:
    """Names of rules and whether a row of ``base_metrics`` fails them."""
    return {
        "too_short": F.col("n_words") < 20,
        "repetitive": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    }


def host_rules() -> dict[str, Column]:
    """Rules that speak of hosts only: their failures are counted by host, and no document goes for its own."""
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": 20 * F.col("n_dup_lines") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    }


def shrunk_rates(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """``hosts`` (host, n, a count for each rule) with the posterior mean failure rate of each in ``<rule>_rate``.

    A rule's beta prior is fitted over all hosts by moments, hosts weighted by their documents: its mean is the
    pooled rate, its precision what the rates' spread beyond binomial noise leaves. With no such spread
    (or one host) all hosts get the pooled rate. One row with the sums of all rules is joined to all hosts.
    """
    n = F.col("n").cast("double")
    sums = [F.sum("n").alias("_n"), F.count("*").alias("_k"), F.sum(n * F.col("n")).alias("_nn")]
    for r in rules:
        sums += [F.sum(r).alias(f"_f_{r}"), F.sum(n * (F.col(r) / n) * (F.col(r) / n)).alias(f"_ss_{r}")]
    rates = []
    for r in rules:
        mean = F.col(f"_f_{r}") / F.col("_n")
        noise = mean * (1 - mean)
        spread = F.col(f"_ss_{r}") / F.col("_n") - mean * mean - noise * (F.col("_k") - 1) / F.col("_n")
        between = spread / F.nullif(1 - F.col("_nn") / F.col("_n") / F.col("_n"), F.lit(0.0))
        precision = F.greatest(noise / between - 1, F.lit(0.0))
        rates.append(F.when((between > 0) & (noise > 0), (F.col(r) + mean * precision) / (F.col("n") + precision)).otherwise(mean).alias(f"{r}_rate"))
    return hosts.crossJoin(F.broadcast(hosts.agg(*sums))).select(*hosts.columns, *rates)


def host_verdicts(flags: DataFrame, rules: list[str], max_rate: float = 0.5) -> DataFrame:
    """(host, n, a count and a shrunk ``<rule>_rate`` for each rule, host_rejected) for every host.

    ``flags`` has host and a boolean column for each rule, true where the document fails it. A host is
    rejected if a shrunk rate is over ``max_rate``. Rows without a host have no verdict.
    """
    hosts = flags.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(r).alias(r) for r in rules))
    hosts = shrunk_rates(cut(hosts), rules)
    return hosts.withColumn("host_rejected", F.greatest(*(F.col(f"{r}_rate") for r in rules), F.lit(0.0)) > max_rate)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The figures of ``base_metrics``, base_failed, host_rejected and kept, a row for each document.

    A document is kept unless it fails a base rule itself or its host is rejected, for the rate of its documents that
    fail any base rule, one of them, or one of ``host_rules``. Without a host (null)
    only the base rules count. Null ids and repeated rows are kept as rows of their own; other columns
    are ignored; no rows give no rows. The figures, a few numbers a row, are computed once and read from a
    checkpoint; the join of verdicts, one row a host, is an equi-join that adaptive execution can split.
    """
    metrics = cut(base_metrics(docs, id_col=id_col, text_col=text_col, host_col=host_col))
    rules = base_rules()
    flags = metrics.select("*", *(c.alias(r) for r, c in (rules | host_rules()).items()))
    verdicts = host_verdicts(flags.withColumn("base_failed", F.greatest(*rules)), ["base_failed", *rules, *host_rules()], max_rate).select("host", "host_rejected")
    verdicts = cut(verdicts)  # a table of its own, so that both sides of the join are dealt out for it and a hot host can be split
    joined = flags.join(verdicts, "host", "left").withColumn("base_failed", F.greatest(*rules))
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.select(*metrics.columns, "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))
