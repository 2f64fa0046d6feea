"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import decontaminate, html_extract, licenses, line_dedup, lm_score, minhash, mixing, quality, secret_scan, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_report(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents labelled as of good quality."""
    good = _table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score_documents(_table(spark, sf_dir, "documents"), good)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix": op2_mix,
    "op3_extract": op3_extract,
    "op4_line_dedup": op4_line_dedup,
    "op5_license": op5_license,
    "op6_quality": op6_quality,
    "op7_minhash": op7_minhash,
    "op8_secrets": op8_secrets,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_lm_score": op10_lm_score,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12) AS digits
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1.0 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight FROM totals),
ratios AS (SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM ratios WINDOW o AS (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT level FROM levels WHERE level < ratio ORDER BY ratio, level DESC LIMIT 1) * weight, cap))::DOUBLE AS target
  FROM levels),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM targets),
rests AS (SELECT *, target - copies * source_size AS rest FROM split),
buckets AS (SELECT source, digits, sum(size) AS n FROM sized GROUP BY source, digits),
runs AS (
  SELECT source, digits, n, sum(n) OVER (PARTITION BY source ORDER BY digits) AS upto FROM buckets),
cuts AS (
  SELECT r.source, CASE WHEN upto - rest <= rest - (upto - n) THEN digits || 'g' ELSE digits END AS below
  FROM runs r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source
  WHERE rest > 0 AND upto - n < rest AND rest <= upto)
SELECT s.doc_id, s.size::BIGINT AS size, t.source_size, t.target,
       t.copies + CASE WHEN s.digits < coalesce(c.below, '') THEN 1 ELSE 0 END AS copies,
       ((t.copies + CASE WHEN s.digits < coalesce(c.below, '') THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM sized s JOIN rests t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
""",
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p
  FROM documents),
filled AS (
  SELECT doc_id, p, trim(line, E' \t\n\x0b\x0c\r') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS k
  FROM lines WHERE trim(line, E' \t\n\x0b\x0c\r') <> ''),
windows AS (
  SELECT a.doc_id, a.k, a.t AS t1, b.t AS t2, c.t AS t3
  FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN filled c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
later AS (
  SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, k) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, k + d AS k FROM later, (VALUES (0), (1), (2)) v(d)),
judged AS (
  SELECT l.doc_id, l.p, l.line, f.k IS NOT NULL AS filled, g.k IS NOT NULL AS gone
  FROM lines l LEFT JOIN filled f ON l.doc_id = f.doc_id AND l.p = f.p LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.k = g.k)
SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_text_md5
FROM judged GROUP BY doc_id
""",
    "op6_quality": r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, E' \t\n\x0b\x0c\r') <> '') AS lines
  FROM documents),
starts AS (
  SELECT doc_id, unnest(range(len(w) - 7)) AS i, w FROM texts WHERE len(w) >= 8),
twins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i + 1, i + 8)) AS n FROM starts),
places AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twins, range(8) r(d) WHERE n > 1 GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM texts t LEFT JOIN places p ON t.doc_id = p.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM counts
""",
}
