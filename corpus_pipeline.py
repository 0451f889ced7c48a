"""From raw documents to a mixed training corpus: five stages, each one a Spark job of its own.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` (doc_id, text, lang, source,
n_chars) and returns a table; the caller writes it and hands the reread table to the next stage.
Extra columns pass through the first four stages; rows that share a doc_id share its fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesight.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from sitesight.llm.common import small, table
from sitesight.workspace import keep


def _same_id(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, Column]:
    ids = keep(ids.select(F.col("doc_id").alias("_id")).distinct(), "ids")
    return small(ids), docs["doc_id"].cast("long").eqNullSafe(ids["_id"])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    poor = quality.scored(docs, table(spark, sf_dir, "labels")).where("predicted = 0")
    return docs.join(*_same_id(docs, poor), "left_anti")


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; documents all of whose lines do are gone."""
    marked = line_dedup.dedup_lines(docs)
    cut = F.size("dropped") > 0
    marked = marked.where(~cut | (F.size("dropped") < F.col("n_lines")))
    text = line_dedup.kept_text()
    n_chars = F.when(cut, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return marked.select(*[{"text": text, "n_chars": n_chars}.get(c, F.col(c)).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id."""
    found = keep(jaccard_join.near_duplicates(docs), "classes")
    kept = docs.join(*_same_id(docs, found.where("not doc_id <=> class_id")), "left_anti")
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    ids, same = _same_id(kept, twice)
    if ids.isEmpty():
        return kept
    return kept.join(ids, same, "left_anti").unionByName(kept.join(ids, same, "left_semi").dropDuplicates(["doc_id"]))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(*_same_id(docs, leaks), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy, with its output shard and its place there."""
    return mixing.mixed_corpus(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", first_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", not_in_benchmark),
    ("mixing to target weights", mixed),
]

#: The first stage is a learned model, which SQL cannot express; tests/llm run the whole on edge rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"stage{k}")
    return docs
