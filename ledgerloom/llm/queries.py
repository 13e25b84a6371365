"""The queries of the subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), capacity=4096, end_id=2, with_ids=False)


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.simhash import hex16, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seed=42, radius=2)
    return found.select("doc_id", hex16(found["fp"]).alias("fingerprint"), "component_id")


@query
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.hostrules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), max_rate=0.5).drop("host", "host_rejected")


ORACLES["op8_host_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM d
), g AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM s WHERE len(w) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS o(k) GROUP BY r
), m AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repetitive, 10 * n_symbols > n_words AS symbols,
         20 * n_dup_lines > n_words AS repeated_lines, word_chars < 2 * n_words OR word_chars > 12 * n_words AS word_length FROM m
), h AS (
  SELECT host, count(*) AS n, unnest([{'rule': 1, 'f': count_if(short OR repetitive)}, {'rule': 2, 'f': count_if(short)}, {'rule': 3, 'f': count_if(repetitive)},
    {'rule': 4, 'f': count_if(symbols)}, {'rule': 5, 'f': count_if(repeated_lines)}, {'rule': 6, 'f': count_if(word_length)}], recursive := true)
  FROM f WHERE host IS NOT NULL GROUP BY host
), p AS (
  SELECT rule, sum(n)::DOUBLE AS nn, sum(f) / sum(n)::DOUBLE AS mean, count(*) AS k, sum(n * (f / n::DOUBLE) ** 2) AS ss, sum(n::DOUBLE * n) AS n2 FROM h GROUP BY rule
), q AS (
  SELECT *, (ss / nn - mean * mean - mean * (1 - mean) * (k - 1) / nn) / nullif(1 - n2 / nn / nn, 0) AS between_hosts FROM p
), v AS (
  SELECT host, max(CASE WHEN between_hosts > 0 AND mean > 0 AND mean < 1
      THEN (f + mean * greatest(mean * (1 - mean) / between_hosts - 1, 0)) / (n + greatest(mean * (1 - mean) / between_hosts - 1, 0)) ELSE mean END) > 0.5 AS rejected
  FROM h JOIN q USING (rule) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
       NOT (short OR repetitive) AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN v USING (host)
"""


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.warc import round_trip

    captures = round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return captures.selectExpr(
        "page_id",
        "capture.payload_bytes AS payload_bytes",
        "capture.payload_digest AS payload_digest",
        "capture.record_type AS record_type",
        "refers_to_page AS refers_to",
    )


ORACLES["op1_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


ORACLES["op7_decontamination"] = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT *, len(w) AS n, least(5, len(w)) AS width FROM (SELECT row_number() OVER () AS k, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0
), ig AS (
  SELECT k, width, gram, count(*) AS c FROM (SELECT k, width, array_to_string(w[i:i + width - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, n - width + 2)) AS i FROM iw)) GROUP BY ALL
), dg AS (
  SELECT r, width, i, array_to_string(w[i:i + width - 1], ' ') AS gram FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM dw, (SELECT DISTINCT width FROM iw) WHERE len(w) >= width)
), hits AS (
  SELECT r, k, i, gram, c, len(dw.w) AS m, n, width FROM dg JOIN ig USING (width, gram) JOIN iw USING (k, width) JOIN dw USING (r)
), spans AS (
  SELECT DISTINCT r, k, m, n, width, CASE WHEN m >= n THEN n - width + 1 ELSE m - width + 1 END AS span, n - width + 1 AS total FROM hits
), starts AS (
  SELECT DISTINCT r, k, s FROM (SELECT h.r, h.k, unnest(range(greatest(1, i - span + 1), least(i, greatest(1, h.m - h.n + 1)) + 1)) AS s FROM hits h JOIN spans USING (r, k))
), shared AS (
  SELECT r, k, s, sum(least(f, c)) AS shared FROM (SELECT r, k, s, gram, any_value(c) AS c, count(*) AS f FROM starts JOIN spans USING (r, k) JOIN hits USING (r, k) WHERE i BETWEEN s AND s + span - 1 GROUP BY r, k, s, gram) GROUP BY r, k, s
), scored AS (
  SELECT r, k, s, CAST(shared AS DOUBLE) / CAST(total + span - shared AS DOUBLE) AS similarity FROM shared JOIN spans USING (r, k)
)
SELECT doc_id, item_id, CAST(s - 1 AS BIGINT) AS start_word, similarity
FROM (SELECT * FROM scored WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY similarity DESC, s) = 1) JOIN dw USING (r) JOIN iw USING (k)
"""


@query
def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.substring import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), width=13, with_text=False).drop("factors")


ORACLES["op2_substring"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS passage FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), m AS (
  SELECT passage, min(doc_id) AS first FROM g GROUP BY passage
), gone AS (
  SELECT DISTINCT r, i + k AS j FROM g JOIN m USING (passage), range(13) AS o(k) WHERE first < doc_id
), kept AS (
  SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


@query
def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.cotrain import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


@query
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), threshold=0.8).drop("rid")


@query
def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents; deletion of those labelled toxic; recounts of the rest under a version with an end
    token, to which they move, each with one token more. The first two are delivered twice. Compacted after two."""
    from pyspark.sql import functions as F

    from ledgerloom.llm.common import written
    from ledgerloom.llm.rollup import DIMENSIONS, Rollup, count_tokens

    counts = written(count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k"), "counts")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    none = F.lit(None).cast("long").alias("old_tokens")
    rollup = Rollup(spark, compact_every=2)
    insert = counts.select(F.lit("insert").alias("op"), *DIMENSIONS, "n_tokens", none)
    delete = counts.join(toxic, "doc_id", "left_semi").select(F.lit("delete").alias("op"), *DIMENSIONS, "n_tokens", F.col("n_tokens").alias("old_tokens"))
    rest = counts.join(toxic, "doc_id", "left_anti")
    old = [F.col(d).alias(f"old_{d}") for d in DIMENSIONS]
    revise = rest.select(F.lit("revise").alias("op"), "source", "lang", F.lit("word_bpe_49k+end").alias("tokenizer_version"), (F.col("n_tokens") + 1).alias("n_tokens"), F.col("n_tokens").alias("old_tokens"), *old)
    for batch_id, changes in (("load", insert), ("load", insert), ("toxic", delete), ("end-token", revise), ("toxic", delete)):
        rollup.commit(batch_id, changes)
    return rollup.totals()


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), end_id=2, with_ids=False)


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.merkle import document_manifest

    return document_manifest(table(spark, sf_dir, "documents"))


ORACLES["op13_merkle"] = r"""
WITH RECURSIVE crc AS (
  SELECT DISTINCT doc_id, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda x, b: list_reduce(
      [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(x, b)), 4294967295::BIGINT) AS c
  FROM documents WHERE doc_id IS NOT NULL
), raw AS (
  SELECT d.*, CASE WHEN (4294967295 - c) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text2 FROM documents d LEFT JOIN crc USING (doc_id)
), f AS (
  SELECT doc_id, source, text, text2, array_to_string(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: coalesce(strlen(x) || ':' || x, '-')), '') AS head FROM raw
), h AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text2) || ':' || text2, '-')) AS found FROM f
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS r FROM h
), low AS (
  SELECT sid, 0 AS lvl, pos, n, leaf AS node FROM leaves
  UNION ALL
  SELECT sid, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY sid, lvl, pos // 3, n
), subroots AS (
  SELECT sid, node AS subroot, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, sid AS pos, n, subroot AS node FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 3, n
), met AS (
  SELECT r, lvl AS step, a.pos AS place, a.pos < l.pos // CAST(3 ** lvl AS BIGINT) AS before, node FROM leaves l JOIN low a ON a.sid = l.sid AND a.n > 1
    AND a.pos // 3 = l.pos // CAST(3 ** (lvl + 1) AS BIGINT) AND a.pos <> l.pos // CAST(3 ** lvl AS BIGINT)
  UNION ALL
  SELECT r, 1000 + lvl, a.pos, a.pos < l.sid // CAST(3 ** lvl AS BIGINT), node FROM leaves l JOIN high a ON a.n > 1
    AND a.pos // 3 = l.sid // CAST(3 ** (lvl + 1) AS BIGINT) AND a.pos <> l.sid // CAST(3 ** lvl AS BIGINT)
), levels AS (
  SELECT r, lvl AS step FROM leaves l JOIN (SELECT DISTINCT sid, lvl FROM low WHERE n > 1) USING (sid)
  UNION ALL
  SELECT r, 1000 + lvl FROM leaves, (SELECT DISTINCT lvl FROM high WHERE n > 1)
), runs AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY step) AS k, coalesce(string_agg(node, '' ORDER BY place) FILTER (before), '') AS a,
         coalesce(string_agg(node, '' ORDER BY place) FILTER (NOT before), '') AS b
  FROM levels LEFT JOIN met USING (r, step) GROUP BY r, step
), folds AS (
  SELECT r, 0 AS k, found AS node FROM leaves
  UNION ALL
  SELECT r, folds.k + 1, sha256(a || node || b) FROM folds JOIN runs USING (r) WHERE runs.k = folds.k + 1
), proofs AS (
  SELECT r, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256 FROM runs GROUP BY r
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (sid) JOIN (SELECT r, arg_max(node, k) AS folded_root FROM folds GROUP BY r) USING (r) LEFT JOIN proofs USING (r),
     (SELECT node AS root FROM high WHERE n = 1)
"""


@query
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.lexical import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op11_lexical"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), q AS (
  SELECT row_number() OVER () AS i, item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), wt AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, s GROUP BY term, n_docs
), gain AS (
  SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w)::BIGINT * n_docs) // n_terms))) AS gain FROM tf JOIN d USING (r) JOIN wt USING (term), s
), scored AS (
  SELECT i, item_id, r, sum(gain)::BIGINT AS score FROM q JOIN gain USING (term) GROUP BY i, item_id, r
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored JOIN d USING (r) WHERE score > 0) WHERE rank <= 10
"""
