"""Site, month and draw tables derived from the shared test tables.

customer = site, nation = municipality, region = region; a line item is a test and it
succeeds unless it was returned. Events stand in for draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesight.functions.scalars import ratio
from sitesight.operators.ordering import row_numbers
from sitesight.workspace import by_size, kept_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id with its municipality and region; the two dimension tables are tiny files."""
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("region"),
            F.col("n_name").alias("municipality"),
            F.col("c_custkey").alias("site_id"),
        )
    )


def build_site_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per site. Line items shrink to one row per order before the order join."""
    items = table(spark, sf_dir, "lineitem")
    per_order = (
        by_size(items.select("l_orderkey", "l_returnflag"), items.count(), "l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("tests"),
            F.count_if(F.col("l_returnflag") != "R").alias("successes"),
        )
    )
    per_site = (
        per_order.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("tests").alias("tests"), F.sum("successes").alias("successes"))
    )
    return (
        places(spark, sf_dir)
        .join(per_site, F.col("site_id") == F.col("o_custkey"))
        .select(
            "region",
            "municipality",
            "site_id",
            "tests",
            "successes",
            ratio(F.col("successes"), F.col("tests")).alias("rate"),
        )
    )


def build_site_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per site and month. Hardly two line items share a site and a month, so the rows of a task are bounded and not only combined."""
    items = table(spark, sf_dir, "lineitem")
    n = items.count()
    dated = items.select(
        "l_orderkey",
        F.trunc(F.to_date("l_shipdate"), "month").alias("month"),
        F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("ok"),
    )
    per_order = (
        by_size(dated, n, "l_orderkey")
        .groupBy("l_orderkey", "month")
        .agg(F.count(F.lit(1)).alias("tests"), F.sum("ok").alias("successes"))
    )
    by_site = per_order.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    per_site = (
        by_size(by_site.select("o_custkey", "month", "tests", "successes"), n, "o_custkey")
        .groupBy("o_custkey", "month")
        .agg(F.sum("tests").alias("tests"), F.sum("successes").alias("successes"))
    )
    return (
        per_site.join(places(spark, sf_dir), F.col("site_id") == F.col("o_custkey"))
        .select(
            "month",
            "region",
            "municipality",
            "site_id",
            "tests",
            "successes",
            ratio(F.col("successes"), F.col("tests")).alias("rate"),
        )
    )


def build_draws_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """param, chain, draw, value: every event is a draw; chains differ in length."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("param"),
        (F.col("user_id") % 4).cast("int").alias("chain"),
        "ts",
        "event_id",
        "value",
    )
    numbered = row_numbers(events, ["param", "chain"], ["ts", "event_id"], "draw")
    return numbered.select("param", "chain", "draw", "value")


def site_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_once(spark, sf_dir, "site_fact", lambda: build_site_fact(spark, sf_dir))


def site_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_once(spark, sf_dir, "site_month", lambda: build_site_month(spark, sf_dir))


def draws_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_once(spark, sf_dir, "draws_fact", lambda: build_draws_fact(spark, sf_dir))
