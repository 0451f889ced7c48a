"""Registered queries that write results with the sinks and read them back with the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesight.operators import kpi
from sitesight.plans.draw_oracles import W as W_DRAWS
from sitesight.plans.oracles import W_EST, W_MONTH, r
from sitesight.plans.shared_tables import draws_fact, site_fact
from sitesight.plans.site_queries import (
    PLACE,
    Query,
    estimates,
    monthly_municipalities,
    municipalities,
    shown,
)
from sitesight.sources import tables as T
from sitesight.workspace import scratch_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _result_folder(spark: SparkSession, d: str) -> DataFrame:
    """Monthly results in two sub-folders with different columns, scanned as one table."""
    folder = _folder(spark, "results")
    monthly = monthly_municipalities(spark, d).select(
        "month", "region", "municipality", "mean_mun", "lo_mun", "hi_mun", "tests_mun"
    )
    early = F.col("month") < "1999-01-01"
    T.write_result(monthly.where(early).drop("tests_mun"), f"{folder}/early", by_month=False)
    T.write_result(monthly.where(~early), f"{folder}/late", by_month=False)
    back = T.read_result_folder(spark, folder)
    return shown(back, "month", "region", "municipality", "mean_mun", "tests_mun", digits=9)


def _month_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Results partitioned by month; the month filter reads one folder per month wanted."""
    folder = _folder(spark, "by_month")
    monthly = monthly_municipalities(spark, d).select("month", "municipality", "mean_mun")
    T.write_result(monthly, folder)
    back = spark.read.schema(monthly.schema).parquet(folder).where("month >= '1997-01-01' AND month < '1998-01-01'")
    return shown(back, "month", "municipality", "mean_mun", digits=9)


def _month_append(spark: SparkSession, d: str) -> DataFrame:
    """One month is written after the others; all of them are read back."""
    folder = _folder(spark, "appended")
    monthly = monthly_municipalities(spark, d).select("month", "region", "municipality", "mean_mun")
    last = F.col("month") >= "1998-01-01"
    T.write_result(monthly.where(~last), folder)
    T.write_result(monthly.where(last), folder)
    return shown(spark.read.schema(monthly.schema).parquet(folder), "month", "region", "municipality", "mean_mun", digits=9)


def _read_by_name(spark: SparkSession, d: str) -> DataFrame:
    """A CSV whose header has another order, and tables that lack a column: found by name, refused by name."""
    folder = _folder(spark, "by_name")
    raw = site_fact(spark, d).select("rate", "municipality", "tests", F.col("site_id").cast("string").alias("site_id"), "region")
    T.write_result(raw, f"{folder}/csv", "csv")
    T.write_result(raw.drop("rate"), f"{folder}/lacking")
    try:
        T.read_site_table(spark, f"{folder}/lacking")
        refused = False
    except T.MissingColumns:
        refused = True
    back = T.read_site_table(spark, f"{folder}/csv", fmt="csv").withColumn("lacking_refused", F.lit(refused))
    return shown(back, "region", "municipality", "site_id", "tests", "rate", "lacking_refused")


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """The raw site table out to CSV and in again under its declared schema."""
    folder = _folder(spark, "csv")
    raw = site_fact(spark, d).select(
        "region", "municipality", F.col("site_id").cast("string").alias("site_id"), "tests", "rate"
    )
    T.write_result(raw, f"{folder}/Export", "csv")
    back = T.with_successes(T.read_site_table(spark, folder, fmt="csv", sheet="Export"))
    return shown(back, "region", "municipality", "site_id", "tests", "successes", "rate")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """Region, municipality and site results under one path, read back with their level."""
    folder = _folder(spark, "levels")
    mun = municipalities(spark, d)
    tables = {
        "region": mun.select("region", F.col("mean_region").alias("mean")).distinct(),
        "municipality": mun.select("region", "municipality", F.col("mean_mun").alias("mean")),
        "site": estimates(spark, d).select(*PLACE, F.col("mean_site").alias("mean")),
    }
    T.write_levels(tables, folder)
    back = T.read_levels(spark, folder, list(tables))
    rows = T.union_months([back[n].withColumn("level", F.lit(n)) for n in ("site", "municipality", "region")])
    return shown(rows, "level", *PLACE, "mean")


def _draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws stored by parameter with the observed counts; one parameter read back."""
    folder = _folder(spark, "fit")
    draws = draws_fact(spark, d)
    for c in ("region", "municipality", "site_id"):
        draws = T.add_if_absent(draws, c, F.lit(None).cast("string"))
    T.write_draws(draws, folder, observed=site_fact(spark, d))
    return shown(T.read_draws(spark, folder, ["click", "view"]), "param", "chain", "draw", "value")


def _guarded(spark: SparkSession, d: str) -> DataFrame:
    """The priority list, published over an older one only because it has one row per site."""
    folder = _folder(spark, "guarded")
    ranked = kpi.prioritise_by_share(estimates(spark, d)).select(*PLACE, "rank")
    T.guarded_write(ranked.where("rank = 1"), ranked.where("rank = 1"), folder)
    T.guarded_write(ranked, site_fact(spark, d), folder)
    return T.read_published(spark, folder, ranked.schema)


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """A site table addressed by name."""
    site_fact(spark, d).withColumn("site_id", F.col("site_id").cast("string")).createOrReplaceTempView("site_export")
    return shown(T.read_site_table(spark, table="site_export"), "region", "municipality", "site_id", "tests", "rate")


QUERIES: dict[str, Query] = {
    "result_folder_scan": _result_folder,
    "month_partitions": _month_partitions,
    "month_append": _month_append,
    "read_by_name": _read_by_name,
    "csv_round_trip": _csv,
    "levels_round_trip": _levels,
    "draws_round_trip": _draws,
    "guarded_export": _guarded,
    "catalog_table": _catalog,
}

_AS_TEXT = "region, municipality, CAST(site_id AS VARCHAR) AS site_id"

ORACLES: dict[str, str] = {
    "result_folder_scan": W_MONTH
    + f"""SELECT month, region, municipality, {r('mean_mun', digits=9)},
         CASE WHEN month >= DATE '1999-01-01' THEN tests_mun END AS tests_mun FROM mun_est""",
    "month_partitions": W_MONTH
    + f"""SELECT month, municipality, {r('mean_mun', digits=9)} FROM mun_est
         WHERE month >= DATE '1997-01-01' AND month < DATE '1998-01-01'""",
    "month_append": W_MONTH + f"SELECT month, region, municipality, {r('mean_mun', digits=9)} FROM mun_est",
    "read_by_name": W_EST + f"SELECT {_AS_TEXT}, tests, {r('rate')}, true AS lacking_refused FROM site_fact",
    "csv_round_trip": W_EST + f"SELECT {_AS_TEXT}, tests, successes, {r('rate')} FROM site_fact",
    "levels_round_trip": W_EST
    + f"""SELECT 'site' AS level, region, municipality, site_id, {r('mean_site', 'mean')} FROM est
         UNION ALL SELECT 'municipality', region, municipality, NULL, round_even(mean_mun, 6) FROM mun_est
         UNION ALL SELECT 'region', region, NULL, NULL, round_even(mean_region, 6) FROM region_est""",
    "draws_round_trip": W_DRAWS
    + f"SELECT param, chain, draw, {r('value')} FROM draws_fact WHERE param IN ('click', 'view')",
    "guarded_export": W_EST
    + """SELECT region, municipality, site_id,
         row_number() OVER (PARTITION BY region, municipality ORDER BY failures DESC, site_id)::BIGINT AS rank FROM est""",
    "catalog_table": W_EST + f"SELECT {_AS_TEXT}, tests, {r('rate')} FROM site_fact",
}
