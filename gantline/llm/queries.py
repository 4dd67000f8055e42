"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, fingerprints, html_text, jaccard_join, language, lexical, licenses, line_dedup, mixing, neighbours, packing, simhash, warc
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents")).drop("component", "th")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("th")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_best_fit_packing,
        op3_line_dedup,
        op4_language_id,
        op5_ngram_jaccard_join,
        op6_source_mixing,
        op7_html_extraction,
        op8_document_fingerprints,
        op9_nearest_neighbours,
        op10_warc_derivatives,
        op11_centroid_clustering,
        op12_lexical_search,
        op13_simhash_near_dedup,
    )
}

#: Line dedup counted exactly, in DuckDB's SQL.
OP3_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, text, coalesce(source, chr(1)) AS site FROM documents),
told AS (
    SELECT k, site, raw, trim(raw, '{line_dedup.WHITE}') AS line, i
    FROM (SELECT k, site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts)
),
gone AS (SELECT line FROM told WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10)
SELECT t.doc_id,
    CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(string_agg(x.raw, chr(10) ORDER BY x.i) FILTER (WHERE g.line IS NULL), '') END AS text,
    CAST(count(x.i) AS BIGINT) AS n_lines, CAST(count(g.line) AS BIGINT) AS n_removed
FROM texts t LEFT JOIN told x ON x.k = t.k LEFT JOIN gone g ON g.line = x.line
GROUP BY t.k, t.doc_id, t.text
"""

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op11_centroid_clustering": centroids.sql(), "op12_lexical_search": lexical.SQL}
