"""One query per operator over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesight.llm import (
    decontaminate, fill_middle, jaccard_join, language_crf, lattice_lm, licences, line_dedup, mixing, nearest, pii, quality, table_clusters,
    toxicity,
)
from sitesight.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.per_document(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of lines and the places (from 0) of those that repeat an earlier line."""
    marked = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped")


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scored(table(spark, sf_dir, "documents"))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.predicted(table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.matches(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_clusters.clusters(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, and the toxic spans as start:end, comma-joined (code points, end exclusive)."""
    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "held_out", "score", "predicted", "n_tokens", spans.alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_nearest_neighbours, op3_decontamination, op4_pii, op5_line_dedup, op6_lattice_lm, op7_language_crf,
        op8_licences, op9_jaccard_join, op10_quality_classifier, op11_centroid_clustering, op12_fill_in_middle, op13_toxicity,
    )
}
ORACLES: dict[str, str] = {
    "op8_licences": licences.duckdb_sql(), "op11_centroid_clustering": table_clusters.duckdb_sql(), "op12_fill_in_middle": fill_middle.duckdb_sql(),
}
