"""Registered queries on the site and month tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesight.functions import scalars as S
from sitesight.operators import checks, facts, kpi, shrinkage
from sitesight.operators.ordering import quantiles
from sitesight.plans.shared_tables import build_site_fact, places, site_fact, site_month, table
from sitesight.sources.tables import union_months, with_successes
from sitesight.workspace import kept_once

Query = Callable[[SparkSession, str], DataFrame]


def municipalities(spark: SparkSession, d: str) -> DataFrame:
    return kept_once(spark, d, "municipalities", lambda: shrinkage.municipality_estimates(site_fact(spark, d)))


def estimates(spark: SparkSession, d: str) -> DataFrame:
    return shrinkage.site_estimates(site_fact(spark, d), municipalities(spark, d))


def monthly_municipalities(spark: SparkSession, d: str) -> DataFrame:
    return kept_once(
        spark, d, "monthly", lambda: shrinkage.municipality_estimates(site_month(spark, d), ["month"])
    )


# Impacts carry nine decimals already; rounding them a second time would only make ties.
NINE_DECIMALS = {"impact", "impact_cum"}


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The named columns, doubles at ``digits`` decimals."""
    doubles = {n for n, t in df.dtypes if t == "double"}
    places = {c: 9 if c in NINE_DECIMALS else digits for c in columns}
    return df.select(*[F.bround(c, places[c]).alias(c) if c in doubles else F.col(c) for c in columns])


PLACE = ["region", "municipality", "site_id"]


def _on_sites(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: fn(site_fact(spark, d))


def _on_estimates(fn: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, d: shown(fn(estimates(spark, d)), *columns)


def _category_codes(sites: DataFrame) -> DataFrame:
    mun = facts.group_codes(sites, ["municipality"], "mun_idx", base=0)
    reg = facts.group_codes(sites, ["region"], "region_idx", base=0)
    rows = facts.attach_codes(facts.attach_codes(sites, mun, ["municipality"]), reg, ["region"])
    return rows.select("site_id", "municipality", "region", "mun_idx", "region_idx")


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated table: two result sets with different columns, matched by name."""
    monthly = monthly_municipalities(spark, d)
    early = monthly.where(F.col("month") < "1999-01-01").drop("phi_site")
    late = monthly.where(F.col("month") >= "1999-01-01")
    return kpi.month_panel(union_months([early, late]))


def _rising(panel: DataFrame) -> DataFrame:
    """Municipalities with a higher mean in the panel's last month than in its first."""
    return kpi.end_months(panel).where("mean_last > mean_first").select("region", "municipality")


def _known(sites: DataFrame) -> DataFrame:
    """Stands for a posterior that covers only the larger municipalities."""
    return sites.groupBy("municipality").agg(F.sum("tests").alias("n")).where("n > 2400")


def site_bands(spark: SparkSession, d: str) -> DataFrame:
    """Sites by tax band, the band in the place of the municipality: groups that differ widely.

    A line item passes when its discount and tax together are at most nine per cent.
    """

    def build() -> DataFrame:
        percent = lambda c: F.floor(F.col(c) * 100 + 0.5)
        lines = table(spark, d, "lineitem").select(
            "l_orderkey", F.concat(F.lit("tax "), percent("l_tax").cast("string")).alias("municipality"),
            (percent("l_discount") + percent("l_tax") <= 9).cast("int").alias("ok"),
        )
        per_site = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "municipality")
        sums = per_site.agg(F.count(F.lit(1)).alias("tests"), F.sum("ok").cast("bigint").alias("successes"))
        sites = sums.join(places(spark, d).select("region", "site_id"), F.col("site_id") == F.col("o_custkey"))
        return sites.select("region", "municipality", "site_id", "tests", "successes", S.ratio(F.col("successes"), F.col("tests")).alias("rate"))

    return kept_once(spark, d, "site_bands", build)


def _band_estimates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sites = site_bands(spark, d)
    parents = kept_once(spark, d, "band_parents", lambda: shrinkage.municipality_estimates(sites))
    return parents, shrinkage.site_estimates(sites, parents)


QUERIES: dict[str, Query] = {
    "outlier_bands": lambda s, d: shown(
        kpi.outlier_municipalities(_band_estimates(s, d)[0]),
        "region", "municipality", "mean_mun", "lo_mun", "hi_mun", "mean_region", "side",
    ),
    "critical_site_bands": lambda s, d: shown(
        kpi.critical_sites(_band_estimates(s, d)[1]), *PLACE, "mean_site", "hi_site", "reason"
    ),
    "check_hierarchy_bands": lambda s, d: checks.split_municipalities(site_bands(s, d)),
    "check_unique_site_bands": lambda s, d: checks.repeated_sites(site_bands(s, d)),
    "site_fact": lambda s, d: shown(build_site_fact(s, d), *PLACE, "tests", "successes", "rate"),
    "filter_region": _on_sites(lambda t: facts.in_region(t, "ASIA").select("site_id", "tests", "successes")),
    "filter_municipality": _on_sites(
        lambda t: facts.in_municipality(t, "NATION_7").select("site_id", "tests", "successes")
    ),
    "filter_in_list": _on_sites(
        lambda t: facts.in_list(t, ["NATION_3", "NATION_11", "NATION_20"]).select("municipality", "site_id", "tests")
    ),
    "filter_in_table": lambda s, d: facts.in_list(
        site_fact(s, d),
        table(s, d, "nation").where("n_regionkey = 2").withColumnRenamed("n_name", "municipality"),
    ).select("municipality", "site_id", "tests"),
    "filter_like": _on_sites(
        lambda t: facts.name_contains(t, "municipality", "NATION_1").select("municipality", "site_id", "tests")
    ),
    "derive_successes": _on_sites(
        lambda t: with_successes(
            t.drop("successes").withColumn("rate", F.bround("rate", 2))
        ).select("site_id", "tests", "successes")
    ),
    "group_summary": _on_sites(
        lambda t: shown(
            t.groupBy("region", "municipality").agg(
                F.count(F.lit(1)).alias("n_sites"),
                F.sum("tests").alias("tests"),
                F.sum("successes").alias("successes"),
                F.count_distinct("tests").alias("distinct_tests"),
                F.max("tests").alias("max_tests"),
                F.avg("rate").alias("mean_rate"),
                F.stddev_pop("rate").alias("sd_pop"),
                F.stddev_samp("rate").alias("sd_samp"),
            ),
            "region", "municipality", "n_sites", "tests", "successes", "distinct_tests", "max_tests",
            "mean_rate", "sd_pop", "sd_samp",
        )
    ),
    "group_municipality": _on_sites(
        lambda t: shown(
            t.groupBy("municipality").agg(F.count(F.lit(1)).alias("n_sites"), F.avg("rate").alias("mean_rate")),
            "municipality", "n_sites", "mean_rate",
        )
    ),
    "distinct_groups": _on_sites(lambda t: t.select("region", "municipality").distinct()),
    "group_counts": _on_sites(
        lambda t: t.agg(
            F.count_distinct("region").alias("regions"),
            F.count_distinct("municipality").alias("municipalities"),
            F.count(F.lit(1)).alias("sites"),
            F.max("tests").alias("max_tests"),
        )
    ),
    "pooled_rate": _on_sites(
        lambda t: shown(
            shrinkage.pooled_rate(t, ["region", "municipality"]),
            "region", "municipality", "tests", "successes", "pooled_rate",
        )
    ),
    "pooled_rate_rollup": _on_sites(
        lambda t: shown(shrinkage.rate_levels(t), *PLACE, "level", "tests", "successes", "rate")
    ),
    "raw_rates": _on_sites(lambda t: shown(shrinkage.raw_rate(t), "site_id", "raw_rate")),
    "group_codes": _on_sites(
        lambda t: facts.attach_codes(
            t, facts.group_codes(t, ["region", "municipality"], "group_id"), ["region", "municipality"]
        ).select(*PLACE, "group_id")
    ),
    "category_codes": _on_sites(_category_codes),
    "site_row_index": _on_sites(lambda t: facts.site_index(t.select(*PLACE)).select(*PLACE, "site_index")),
    "municipality_region_map": _on_sites(facts.region_of_municipality),
    "site_lists": _on_sites(
        lambda t: facts.site_lists(t).withColumn("sites", F.array_join(F.col("sites").cast("array<string>"), ","))
    ),
    "failures": _on_sites(lambda t: kpi.with_failures(t).select("site_id", "failures")),
    "failures_share_rank": _on_estimates(
        lambda e: kpi.rank_in_municipality(
            kpi.with_failure_share(e).select(*PLACE, "failures", "failure_share"), "failure_share"
        ),
        *PLACE, "failures", "failure_share", "rank",
    ),
    "impact_by_municipality": _on_estimates(kpi.with_impact, *PLACE, "failures", "failures_norm", "impact"),
    "impact_rank": _on_estimates(
        lambda e: kpi.rank_in_municipality(kpi.with_impact(e).select(*PLACE, "impact"), "impact"), *PLACE, "rank"
    ),
    "impact_global": lambda s, d: shown(
        kpi.prioritise_by_impact(estimates(s, d)), *PLACE, "impact", "rank"
    ),
    "cumulative_impact": _on_estimates(kpi.cumulative_impact, *PLACE, "impact", "impact_cum", "gain"),
    "potential_gain": _on_estimates(kpi.potential_gain, *PLACE, "failures", "gain_percent"),
    "shrunk_rates": _on_estimates(lambda e: e, *PLACE, "mean_site", "sd_site", "lo_site", "hi_site"),
    "municipality_rates": lambda s, d: shown(
        municipalities(s, d),
        "region", "municipality", "n_sites", "tests_mun", "successes_mun", "phi_site", "phi_mun",
        "mean_mun", "sd_mun", "lo_mun", "hi_mun", "mean_region", "sd_region",
    ),
    "method_comparison": _on_estimates(
        kpi.method_comparison,
        *PLACE, "tests", "successes", "raw_rate", "pooled_rate", "mean_site", "lo_site", "hi_site", "width",
    ),
    "prioritisation_share": _on_estimates(
        kpi.prioritise_by_share, *kpi.PRIORITY_COLUMNS, "failure_share", "impact", "rank"
    ),
    "prioritisation_impact": _on_estimates(kpi.prioritise_by_impact, *kpi.PRIORITY_COLUMNS, "impact", "rank"),
    "below_municipality": _on_estimates(kpi.below_municipality, *PLACE, "mean_site", "hi_site", "mean_mun"),
    "below_target": _on_estimates(kpi.below_target, *PLACE, "mean_site", "lo_site", "hi_site"),
    "plus_two_points": _on_estimates(kpi.below_lifted_municipality, *PLACE, "mean_site", "hi_site", "mean_mun"),
    "critical_sites": _on_estimates(kpi.critical_sites, *PLACE, "mean_site", "hi_site", "reason"),
    "target_impact": _on_estimates(kpi.with_target_impact, *PLACE, "target_impact"),
    "target_impact_top": _on_estimates(
        lambda e: kpi.target_impact_top(e, 10),
        *PLACE, "tests", "mean_site", "lo_site", "hi_site", "target_impact",
    ),
    "worst_municipality": lambda s, d: shown(
        kpi.worst_municipalities(municipalities(s, d)), "region", "municipality", "mean_mun", "lo_mun", "hi_mun"
    ),
    "worst_region": lambda s, d: shown(
        kpi.worst_region(municipalities(s, d)), "region", "mean_region", "lo_region", "hi_region"
    ),
    "outlier_municipalities": lambda s, d: shown(
        kpi.outlier_municipalities(municipalities(s, d)),
        "region", "municipality", "mean_mun", "lo_mun", "hi_mun", "mean_region", "side",
    ),
    "what_if_worst_decile": _on_estimates(
        kpi.lift_worst_share, "region", "sites_lifted", "rate_before", "rate_after"
    ),
    "budget_share": lambda s, d: kpi.budget_share(estimates(s, d)).select(
        "region", F.bround("need", 4).alias("need"), F.bround("share", 6).alias("share")
    ),
    "volume_extremes": _on_estimates(
        kpi.volume_extremes, "municipality", "site_id", "tests", "mean_site", "distance", "label"
    ),
    "volume_against_rate": _on_estimates(kpi.volume_against_rate, *PLACE, "tests", "mean_site", "label"),
    "median_rate": _on_estimates(
        lambda e: quantiles(e, ["region"], "mean_site", {"median": 0.5}), "region", "median"
    ),
    "management_report": lambda s, d: shown(
        kpi.management_report(estimates(s, d), municipalities(s, d)),
        "section", "region", "subject", "value", "interval",
    ),
    "check_rank": lambda s, d: checks.rank_violations(
        kpi.rank_in_municipality(
            kpi.with_failure_share(estimates(s, d)).select(*PLACE, "failure_share"), "failure_share"
        ),
        kpi.MUNICIPALITY,
    ),
    "check_rowcount": lambda s, d: checks.row_counts(estimates(s, d), site_fact(s, d)),
    "check_hierarchy": _on_sites(checks.split_municipalities),
    "check_unique_site": _on_sites(checks.repeated_sites),
    "check_unique_site_month": lambda s, d: checks.repeated_sites(site_month(s, d)),
    "summary_with_counts": lambda s, d: shown(
        facts.with_counts(estimates(s, d).select(*PLACE, "mean_site", "sd_site"), site_fact(s, d)),
        *PLACE, "mean_site", "sd_site", "tests", "successes",
    ),
    "attach_tests_inner": lambda s, d: shown(
        facts.attach_by_site(estimates(s, d).select("site_id", "mean_site"), site_fact(s, d), ["tests"]),
        "site_id", "mean_site", "tests",
    ),
    "attach_tests_left": lambda s, d: facts.attach_by_site(
        table(s, d, "customer").select(
            F.col("c_custkey").alias("site_id"), F.col("c_mktsegment").alias("segment")
        ),
        site_fact(s, d), ["tests"], how="left",
    ),
    "first_row_per_group": _on_sites(
        lambda t: facts.first_per_group(t, ["region", "municipality"], ["site_id"], ["site_id", "tests"])
    ),
    "group_preview": _on_sites(
        lambda t: checks.preview(t, ["region", "municipality"], ["site_id"], 3).select(*PLACE, "tests")
    ),
    "labelled_month": _on_sites(lambda t: t.select("site_id", "tests", F.lit("out/24").alias("month_label"))),
    "month_labels": lambda s, d: site_month(s, d).select("month").distinct().select(
        "month", S.month_label(F.col("month")).alias("month_label")
    ),
    "guarded_ratio": _on_estimates(
        lambda e: kpi.with_failures(e)
        .withColumn("odds", S.ratio(F.col("successes"), F.col("failures")))
        .withColumn("guarded", S.min_max(F.col("failures"), F.lit(0), F.col("max_failures") - F.col("min_failures"))),
        "site_id", "odds", "guarded",
    ),
    "logit_rates": _on_estimates(
        lambda e: e.withColumn("logit", S.logit(F.col("mean_site"))).withColumn(
            "back", S.inverse_logit(F.col("logit"))
        ),
        "site_id", "logit", "back",
    ),
    "log_likelihood_terms": _on_sites(
        lambda t: shown(
            t.withColumn("log_gamma", S.log_gamma(F.col("tests") + 0.5)).withColumn(
                "log_beta", S.log_beta(F.col("successes") + 2.0, F.col("tests") - F.col("successes") + 2.0)
            ),
            "site_id", "log_gamma", "log_beta",
        )
    ),
    "param_index": _on_sites(
        lambda t: t.select(F.concat(F.lit("rate["), "site_id", F.lit("]")).alias("name"), "tests").select(
            "name", S.parameter_index(F.col("name")).alias("idx"), "tests"
        )
    ),
    "posterior_semi": _on_sites(
        lambda t: facts.with_posterior(t, _known(t), ["municipality"]).select("site_id", "municipality")
    ),
    "posterior_anti": _on_sites(
        lambda t: facts.without_posterior(t, _known(t), ["municipality"]).select("site_id", "municipality")
    ),
    "monthly_rates": lambda s, d: shown(
        monthly_municipalities(s, d), "month", "region", "municipality", "tests_mun", "mean_mun", "lo_mun", "hi_mun",
        digits=9,
    ),
    "monthly_sites": lambda s, d: shown(
        shrinkage.site_estimates(site_month(s, d), monthly_municipalities(s, d), ["month"]),
        "month", *PLACE, "mean_site", "lo_site", "hi_site", digits=9,
    ),
    "panel_union": lambda s, d: shown(_panel(s, d), "region", "municipality", "lo_mun", "mean_mun", "hi_mun", "month", digits=9),
    "improved_municipalities": lambda s, d: shown(
        kpi.improved_municipalities(_panel(s, d)), "region", "municipality", "lo_mun", "mean_first", digits=9
    ),
    "month_series": lambda s, d: shown(
        kpi.month_series(_panel(s, d), _rising(_panel(s, d))), "region", "municipality", "month", "lo_mun", "mean_mun", "hi_mun", digits=9
    ),
}
