"""Selections, dimension codes, joins and lists on the site table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesight.operators.ordering import SLICE_ROWS, row_numbers
from sitesight.workspace import keep


def in_region(sites: DataFrame, region: str) -> DataFrame:
    return sites.where(F.col("region") == region)


def in_municipality(sites: DataFrame, municipality: str) -> DataFrame:
    return sites.where(F.col("municipality") == municipality)


def in_list(sites: DataFrame, names: list[str] | DataFrame) -> DataFrame:
    """Rows of the named municipalities; a list is pushed to the scan, a table semi-joins."""
    if isinstance(names, DataFrame):
        return sites.join(names.select("municipality"), "municipality", "left_semi")
    return sites.where(F.col("municipality").isin(names))


def name_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.col(column).contains(text))


def group_codes(sites: DataFrame, keys: list[str], out: str, base: int = 1) -> DataFrame:
    """Dimension table: sorted distinct keys with a dense code counted from ``base``.

    Codes are given to the distinct keys only, never by a window over the rows.
    """
    distinct = sites.select(*keys).distinct()
    coded = row_numbers(distinct, [], list(keys), "_n").select(
        *keys, (F.col("_n") - 1 + base).cast("bigint").alias(out)
    )
    return keep(coded, "codes")


def attach_codes(sites: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Put a dimension's columns on the rows; every row stays."""
    return sites.join(codes, keys, "left")


def site_index(sites: DataFrame, out: str = "site_index", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Row index in declared key order, where an ordinal is wanted."""
    return row_numbers(sites, [], ["region", "municipality", "site_id"], out, slice_rows)


def region_of_municipality(sites: DataFrame) -> DataFrame:
    """One region per municipality: that of its first site."""
    return sites.groupBy("municipality").agg(F.min_by("region", F.struct("site_id", "region")).alias("region"))


def site_lists(sites: DataFrame, per_list: int = 1000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Ordered site ids of each municipality in lists of at most ``per_list``.

    ``part`` numbers the lists, so that a very large municipality is many rows and never
    one huge array; the lists in order are the whole list.
    """
    placed = row_numbers(
        sites.select("region", "municipality", "site_id"),
        ["region", "municipality"], ["site_id"], "_pos", slice_rows,
    )
    return (
        placed.withColumn("part", F.floor((F.col("_pos") - 1) / per_list).cast("bigint"))
        .groupBy("region", "municipality", "part")
        .agg(F.count(F.lit(1)).alias("n_sites"), F.sort_array(F.collect_list("site_id")).alias("sites"))
    )


def first_per_group(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per group and column the first non-null value in the given order."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    )


def with_counts(summary: DataFrame, sites: DataFrame) -> DataFrame:
    """Site summary with its counts: inner join on region, municipality and site id."""
    keys = ["region", "municipality", "site_id"]
    return summary.join(sites.select(*keys, "tests", "successes"), keys)


def attach_by_site(estimates: DataFrame, sites: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join columns by site id alone; a repeated site id multiplies rows, as a merge does."""
    return estimates.join(sites.select("site_id", *columns), "site_id", how)


def with_posterior(sites: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Sites whose group has a posterior."""
    return sites.join(keep(summary.select(*keys).distinct(), "known"), keys, "left_semi")


def without_posterior(sites: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """The complement: sites whose group has no posterior."""
    return sites.join(keep(summary.select(*keys).distinct(), "known"), keys, "left_anti")
