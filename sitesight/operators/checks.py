"""Data checks. Each returns the offending rows, or one line with the count of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesight.operators.ordering import best_per_group


def rank_violations(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Groups seen, and how many of them do not start at rank 1."""
    return (
        ranked.groupBy(*keys)
        .agg(F.min("rank").alias("lowest"))
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.count_if(F.col("lowest") != 1).alias("violations"),
        )
    )


def row_counts(result: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of the result and of its input, and whether they agree."""
    n = source.agg(F.count(F.lit(1))).scalar()
    return (
        result.agg(F.count(F.lit(1)).alias("result_rows"))
        .withColumn("source_rows", n)
        .withColumn("equal", F.col("result_rows") == F.col("source_rows"))
    )


def split_municipalities(sites: DataFrame) -> DataFrame:
    """Municipality names that occur in more than one region."""
    pairs = sites.select("municipality", "region").distinct()
    return pairs.groupBy("municipality").agg(F.count("region").alias("regions")).where("regions > 1")


def repeated_sites(sites: DataFrame) -> DataFrame:
    """Site ids that occur more than once."""
    return sites.groupBy("site_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def preview(df: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of every group."""
    return best_per_group(df, keys, [F.col(c) for c in order], n)
