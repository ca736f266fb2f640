"""Queries of the training-text problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import entity_match, leakage, packing, quality, term_stats
from ripplegraph.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_stats.symbol_terms(table(spark, sf_dir, "nodes")).where("mark is not null").select("field", "term", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_stats.symbol_terms(table(spark, sf_dir, "nodes"))


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.match_symbols(spark, table(spark, sf_dir, "tgtrace"), table(spark, sf_dir, "nodes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).select("trace_id", "relpath", "qualname", "node_id")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = p6_packed(spark, sf_dir).groupBy("window").agg(F.sum("n_tokens").cast("long").alias("used"))
    return windows.agg(F.count(F.lit(1)).alias("windows"), F.sum("used").alias("tokens"), (F.sum("used") / F.count(F.lit(1)) / F.lit(packing.CAPACITY)).alias("fill"))


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_faults(p6_packed(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.exact_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(spark, table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, table(spark, sf_dir, "documents"), signs=True)


def p8_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.plain_statistics(table(spark, sf_dir, "documents"))


QUERIES = {"p4_found": p4_found, "p4_terms": p4_terms, "p5_found": p5_found, "p5_matches": p5_matches, "p6_packed": p6_packed, "p6_fill": p6_fill, "p6_faults": p6_faults, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_statistics": p8_statistics, "p8_plain": p8_plain}

_TERMS = """WITH total AS (SELECT count(DISTINCT id) AS n FROM nodes),
tokens AS (
  SELECT 'name' AS field, id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT id, regexp_extract_all(lower(name), '[a-z0-9]+') AS k, lower(name) AS name FROM nodes WHERE id IS NOT NULL)
  UNION ALL SELECT 'kind', id, kind FROM (SELECT DISTINCT id, regexp_replace(lower(kind), '^\\s+|\\s+$', '', 'g') AS kind FROM nodes WHERE id IS NOT NULL) WHERE kind <> ''),
counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM tokens GROUP BY field, term),
marked AS (SELECT field, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.05 * n THEN 'common' END AS mark FROM counts, total)"""

ORACLES = {
    "p4_found": _TERMS + " SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_terms": _TERMS + " SELECT field, term, occurrences, records, mark FROM marked",
    # what must hold of any packing, whatever the tokenizer
    "p6_faults": "SELECT count(DISTINCT doc_id) AS placed, 0::BIGINT AS split_needlessly, 0::BIGINT AS not_full, 0::BIGINT AS over_capacity, 0::BIGINT AS gaps, true AS well_filled FROM documents",
    "p8_plain": r"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\r\f\v]')) AS l FROM documents WHERE regexp_matches(text, '[^ \t\n\r\f\v]')),
c AS (SELECT *, length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) AS visible FROM d)
SELECT doc_id, len(w) AS words, visible / len(w) AS word_length, length(regexp_replace(text, '[\p{L}\p{N}_ \t\n\r\f\v]', '', 'g')) / visible AS symbol_ratio, len(list_filter(l, lambda x: regexp_matches(x, '[.!?…][ \t\r\f\v]*$'))) / len(l) AS ended_lines FROM c""",
}
