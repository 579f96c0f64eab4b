"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm import exact_dedup, license_scan, near_dedup, neighbours, pieces, quality, secret_scan, source_mixing, substring_dedup, toxicity


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the mix: sizes and targets."""
    return source_mixing.op1_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the license scan: words and base places."""
    return license_scan.op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the secret scan: matches of each base kind."""
    return secret_scan.op9_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


MIX_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS w FROM d GROUP BY source),
 f AS (SELECT *, 2 * words AS most, 2 * words / w AS fills FROM s),
 l AS (SELECT *, ((SELECT 1.5 * sum(words) FROM s) - sum(most) OVER o + most) / ((SELECT sum(w) FROM s) - sum(w) OVER o + w) AS level, row_number() OVER o AS nr FROM f WINDOW o AS (ORDER BY fills, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
 t AS (SELECT source, words, least(most, w * coalesce((SELECT arg_min(level, nr) FROM l WHERE level <= fills), 'inf'::DOUBLE)) AS target FROM l)
 SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(words AS BIGINT) AS source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""
LICENSE_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, len(w) AS n, list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS a, list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS b, list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS c FROM d)
 SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(a) + len(b) + len(c) AS BIGINT) AS n_base, list_min(a || b || c) AS first_word, list_max(a || b || c) AS last_word, concat_ws(',', CASE WHEN len(b) > 0 THEN 'apache' END, CASE WHEN len(c) > 0 THEN 'gpl' END, CASE WHEN len(a) > 0 THEN 'mit' END) AS base_labels FROM p"""
SECRET_SQL = r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
 CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM documents"""

QUERIES = {
    "op1_source_mixing": source_mixing.op1_source_mixing,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_pieces": pieces.op3_pieces,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_neighbours": neighbours.op10_neighbours,
    "mix_targets": mix_targets,
    "license_base": license_base,
    "secret_base": secret_base,
}
ORACLE = {"op4_exact_dedup": exact_dedup.OP4_SQL, "mix_targets": MIX_SQL, "license_base": LICENSE_SQL, "secret_base": SECRET_SQL}
