"""The registered queries of the training-data operators, one thin ``opN_<name>`` for each.

Each applies its operator with production parameters to its whole table and returns the full
result. ``oracle_sql`` has DuckDB SQL where SQL can express the result over whole tables in
reasonable time; the others are held against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloupe.llm import decontamination, fingerprints, main_text, mixing, quality_gam, sharding, simhash_dedup, suffix_dedup, toxicity_cnn, url_filter
from codeloupe.llm.common import table


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignments(table(spark, sf_dir, "documents"))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_syncmer_fingerprints, op2_main_text, op3_simhash_near_dedup, op4_benchmark_decontamination, op5_toxicity_cnn,
    op6_quality_gam, op7_suffix_dedup, op8_url_filter, op9_minimax_sharding, op10_temperature_mixing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


DECONTAMINATION_SQL = r"""
WITH w AS (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM g),
d AS (SELECT rid, size, i AS pos, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram FROM w, s, unnest(range(1, greatest(len(w) - size + 2, 1))) AS t(i)),
hits AS (SELECT d.rid, d.pos, d.size, g.item_id FROM d JOIN g ON g.size = d.size AND g.gram = d.gram),
n AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS k FROM hits) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS ids FROM hits GROUP BY rid)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON n.rid = w.rid LEFT JOIN i ON i.rid = w.rid"""


def oracle_sql() -> dict[str, str]:
    return {"op4_benchmark_decontamination": DECONTAMINATION_SQL}
