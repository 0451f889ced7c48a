"""Impact measures, priority lists, targets, what-ifs and month comparison.

Input is a site estimate table: region, municipality, site_id, tests, successes, a
``*_site``, ``*_mun`` and ``*_region`` estimate (mean, sd, lo, hi), and the municipality
totals ``tests_mun``, ``min_failures``, ``max_failures``. The closed-form estimates, the
grid posterior and a summary of draws all deliver it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesight.functions.scalars import clip_low, interval_text, label, min_max, ratio
from sitesight.operators.ordering import (
    SLICE_ROWS,
    best_per_group,
    dense_ranks,
    quantiles,
    row_numbers,
    running_sum,
)
from sitesight.workspace import keep

MUNICIPALITY = ["region", "municipality"]

# Default target, lift over the municipality mean, critical upper bound.
TARGET = 0.8
LIFT = 0.02
CRITICAL = 0.60
# Impacts are compared at this many decimals, so equal impacts tie on every machine.
IMPACT_DIGITS = 9


def with_failures(sites: DataFrame) -> DataFrame:
    return sites.withColumn("failures", F.col("tests") - F.col("successes"))


def with_failure_share(sites: DataFrame) -> DataFrame:
    """Failures as a share of all tests of the municipality."""
    return with_failures(sites).withColumn("failure_share", ratio(F.col("failures"), F.col("tests_mun")))


def with_impact(sites: DataFrame) -> DataFrame:
    """Impact with failures scaled inside the municipality."""
    return (
        with_failures(sites)
        .withColumn("failures_norm", min_max(F.col("failures"), F.col("min_failures"), F.col("max_failures")))
        .withColumn("impact", F.bround((1 - F.col("mean_site")) * F.col("failures_norm"), IMPACT_DIGITS))
    )


def with_global_impact(sites: DataFrame) -> DataFrame:
    """Impact with failures scaled over the whole table.

    The two limits are scalar subqueries, one aggregate of one row.
    """
    rows = with_failures(sites)
    low = rows.agg(F.min("failures")).scalar()
    high = rows.agg(F.max("failures")).scalar()
    return rows.withColumn("failures_norm", min_max(F.col("failures"), low, high)).withColumn(
        "impact", F.bround((1 - F.col("mean_site")) * F.col("failures_norm"), IMPACT_DIGITS)
    )


def rank_in_municipality(
    sites: DataFrame, measure: str, out: str = "rank", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """1 for the largest measure of a municipality; ties by site id."""
    return row_numbers(sites, MUNICIPALITY, [f"-{measure}", "site_id"], out, slice_rows)


PRIORITY_COLUMNS = [
    "region", "municipality", "site_id", "lo_site", "mean_site", "hi_site",
    "lo_mun", "mean_mun", "hi_mun", "failures", "tests", "successes",
]


def prioritise_by_share(sites: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Priority list by failure share, ranked inside each municipality."""
    rows = with_failure_share(with_impact(sites)).select(*PRIORITY_COLUMNS, "failure_share", "impact")
    return rank_in_municipality(rows, "failure_share", "rank", slice_rows).orderBy(*MUNICIPALITY, "rank")


def prioritise_by_impact(sites: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Priority list by impact over the whole table; equal impacts share a dense rank."""
    rows = with_global_impact(sites).select(*PRIORITY_COLUMNS, "impact")
    ranked = dense_ranks(rows, [], "impact", ["site_id"], "rank", ascending=False, slice_rows=slice_rows)
    return ranked.orderBy(*MUNICIPALITY, "rank", "site_id")


def cumulative_impact(sites: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Impact gained by repairing the sites of a municipality best-first, and its gain.

    Gain is the cumulative impact relative to the municipality's mean rate.
    """
    rows = with_impact(sites).select(*MUNICIPALITY, "site_id", "impact", "mean_mun")
    return running_sum(rows, MUNICIPALITY, ["-impact", "site_id"], "impact", "impact_cum", slice_rows=slice_rows).withColumn(
        "gain", ratio(F.col("impact_cum"), F.col("mean_mun"))
    )


def potential_gain(sites: DataFrame) -> DataFrame:
    """Percent of the municipality's tests a full repair of the site would win."""
    rows = with_failures(sites)
    return rows.withColumn(
        "gain_percent",
        ratio(clip_low(1 - F.col("mean_site")) * F.col("failures"), F.col("tests_mun")) * 100,
    )


def with_target_impact(sites: DataFrame, target: float = TARGET) -> DataFrame:
    """Tests times the distance to the target: negative where the target is met."""
    return sites.withColumn("target_impact", F.col("tests") * (F.lit(target) - F.col("mean_site")))


def target_impact_top(sites: DataFrame, n: int, target: float = TARGET) -> DataFrame:
    return (
        with_target_impact(sites, target)
        .select("region", "municipality", "site_id", "tests", "mean_site", "lo_site", "hi_site", "target_impact")
        .orderBy(F.bround("target_impact", 9).desc(), "site_id", "region", "municipality")
        .limit(n)
    )


def below_municipality(sites: DataFrame) -> DataFrame:
    """Sites whose whole interval lies below their municipality's mean."""
    return sites.where(F.col("hi_site") < F.col("mean_mun"))


def below_target(sites: DataFrame, target: float = TARGET) -> DataFrame:
    """Sites whose whole interval lies below an absolute target."""
    return sites.where(F.col("hi_site") < F.lit(target))


def below_lifted_municipality(sites: DataFrame, lift: float = LIFT) -> DataFrame:
    """Sites to act on when the municipality's mean should rise by ``lift``."""
    return sites.where(F.col("hi_site") < F.col("mean_mun") + F.lit(lift))


def critical_sites(sites: DataFrame, bound: float = CRITICAL) -> DataFrame:
    """Sites below their municipality, or with an upper bound below a fixed limit."""
    low = F.col("hi_site") < F.col("mean_mun")
    return sites.where(low | (F.col("hi_site") < F.lit(bound))).withColumn(
        "reason",
        F.when(low, F.lit("below municipality")).otherwise(F.lit("below limit")),
    )


def worst_municipalities(municipalities: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` lowest means of each region."""
    return best_per_group(
        municipalities, ["region"], [F.bround("mean_mun", 9), F.col("municipality")], k
    )


def worst_region(municipalities: DataFrame) -> DataFrame:
    """The region with the lowest mean, with its interval."""
    return (
        municipalities.select("region", "mean_region", "lo_region", "hi_region")
        .distinct()
        .orderBy(F.bround("mean_region", 9), "region")
        .limit(1)
    )


def outlier_municipalities(municipalities: DataFrame) -> DataFrame:
    """Municipalities whose interval excludes their region's mean, with the side."""
    return (
        municipalities.withColumn(
            "side",
            F.when(F.col("lo_mun") > F.col("mean_region"), F.lit("high")).when(
                F.col("hi_mun") < F.col("mean_region"), F.lit("low")
            ),
        )
        .where(F.col("side").isNotNull())
        .select("region", "municipality", "mean_mun", "lo_mun", "hi_mun", "mean_region", "side")
    )


def lift_worst_share(sites: DataFrame, share: float = 0.10, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Region rate before and after the worst share of its sites reach the region mean.

    The worst share of n sites are the first ``floor(share * n)`` by mean; a site that is
    already above the region's mean keeps its rate.
    """
    rows = sites.select("region", "municipality", "site_id", "tests", "mean_site", "mean_region", F.bround("mean_site", 9).alias("_m"))
    placed = row_numbers(rows, ["region"], ["_m", "site_id", "municipality"], "_pos", slice_rows)
    sizes = keep(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n_sites")), "sizes")
    lifted = F.when(
        F.col("_pos") <= F.floor(F.col("n_sites") * F.lit(share)),
        F.greatest("mean_site", "mean_region"),
    ).otherwise(F.col("mean_site"))
    return (
        placed.join(sizes, "region")
        .groupBy("region")
        .agg(
            F.count_if(F.col("_pos") <= F.floor(F.col("n_sites") * F.lit(share))).alias("sites_lifted"),
            ratio(F.sum(F.col("tests") * F.col("mean_site")), F.sum("tests")).alias("rate_before"),
            ratio(F.sum(F.col("tests") * lifted), F.sum("tests")).alias("rate_after"),
        )
    )


def budget_share(sites: DataFrame, target: float = TARGET) -> DataFrame:
    """Split of a budget over regions by their positive target impact."""
    need = (
        with_target_impact(sites, target)
        .groupBy("region")
        .agg(F.sum(F.greatest("target_impact", F.lit(0.0))).alias("need"))
    )
    return need.withColumn("share", ratio(F.col("need"), need.agg(F.sum("need")).scalar()))


def volume_extremes(sites: DataFrame, n: int = 15, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sites with most tests, then farthest from the median rate, with a label."""
    rows = sites.select("region", "municipality", "site_id", "tests", "mean_site")
    median = quantiles(rows, [], "mean_site", {"median": 0.5}, slice_rows).scalar()
    return (
        rows.withColumn("distance", F.bround(F.abs(F.col("mean_site") - median), 9))
        .orderBy(F.col("tests").desc(), F.col("distance").desc(), "site_id", "region", "municipality")
        .limit(n)
        .withColumn("label", label(F.col("site_id").cast("string"), F.col("municipality")))
    )


def volume_against_rate(sites: DataFrame, n: int = 15, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every site's tests and rate; the extremes carry their label, the others null."""
    place = ["region", "municipality", "site_id"]
    marked = volume_extremes(sites, n, slice_rows).select(*place, "label")
    return sites.select(*place, "tests", "mean_site").join(marked, place, "left")


def management_report(sites: DataFrame, municipalities: DataFrame) -> DataFrame:
    """One long table: region lines, best and worst municipality, critical sites."""
    text = lambda lo, hi: interval_text(F.col(lo), F.col(hi))
    region = municipalities.groupBy("region").agg(
        F.first("mean_region").alias("value"),
        F.first(text("lo_region", "hi_region")).alias("interval"),
    )
    regions = region.select(
        F.lit("1 region").alias("section"), "region", F.col("region").alias("subject"), "value", "interval"
    )
    key = F.struct(F.bround("mean_mun", 9), "municipality")
    line = F.struct("municipality", "mean_mun", text("lo_mun", "hi_mun").alias("interval"))
    ends = municipalities.groupBy("region").agg(
        F.max_by(line, key).alias("best"), F.min_by(line, key).alias("worst")
    )
    named = ends.select(
        "region",
        F.explode(
            F.array(
                F.struct(F.lit("2 best municipality").alias("section"), F.col("best").alias("m")),
                F.struct(F.lit("3 worst municipality").alias("section"), F.col("worst").alias("m")),
            )
        ).alias("e"),
    ).select(
        "e.section", "region", F.col("e.m.municipality").alias("subject"),
        F.col("e.m.mean_mun").alias("value"), F.col("e.m.interval").alias("interval"),
    )
    critical = below_municipality(sites).select(
        F.lit("4 critical site").alias("section"), "region",
        F.col("site_id").cast("string").alias("subject"),
        F.col("mean_site").alias("value"), text("lo_site", "hi_site").alias("interval"),
    )
    return regions.unionByName(named).unionByName(critical)


def method_comparison(sites: DataFrame) -> DataFrame:
    """Raw rate, pooled rate and shrunken interval of each site side by side."""
    return sites.select(
        "region", "municipality", "site_id", "tests", "successes",
        ratio(F.col("successes"), F.col("tests")).alias("raw_rate"),
        ratio(F.col("successes_mun"), F.col("tests_mun")).alias("pooled_rate"),
        "mean_site", "lo_site", "hi_site",
        (F.col("hi_site") - F.col("lo_site")).alias("width"),
    )


def month_panel(monthly: DataFrame) -> DataFrame:
    """Distinct (region, municipality, month) estimates of a consolidated result table."""
    return monthly.select("region", "municipality", "lo_mun", "mean_mun", "hi_mun", "month").distinct()


def first_and_last_month(panel: DataFrame) -> DataFrame:
    return panel.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def end_months(panel: DataFrame) -> DataFrame:
    """Per municipality its estimates in the panel's last and first month.

    Two filtered reads of the panel meet on region and municipality; one without a row in either
    end month is left out, as an inner join does.
    """
    ends = first_and_last_month(panel)
    last = panel.where(F.col("month") == ends.select("last_month").scalar()).select(
        "region", "municipality", "lo_mun", F.col("mean_mun").alias("mean_last")
    )
    first = panel.where(F.col("month") == ends.select("first_month").scalar()).select(
        "region", "municipality", F.col("mean_mun").alias("mean_first")
    )
    return last.join(first, ["region", "municipality"])


def improved_municipalities(panel: DataFrame) -> DataFrame:
    """Municipalities whose interval in the last month lies above their first mean."""
    return end_months(panel).where(F.col("lo_mun") > F.col("mean_first"))


def month_series(panel: DataFrame, chosen: DataFrame) -> DataFrame:
    """(month, lo, mean, hi) of the municipalities named in ``chosen``, in time order."""
    place = ["region", "municipality"]
    return panel.join(chosen.select(*place), place, "left_semi").orderBy(*place, "month")
