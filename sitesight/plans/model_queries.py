"""Registered queries on fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesight.operators import grid_posterior as P
from sitesight.operators import kpi
from sitesight.operators import model_spec as M
from sitesight.operators.model_spec import Model
from sitesight.functions.scalars import half_even, month_label
from sitesight.plans import model_oracles as O
from sitesight.operators import diagnostics, draws, factors, sampling
from sitesight.plans.oracles import MONTH_LABEL, W_SITE, r
from sitesight.plans.shared_tables import site_fact, site_month, table
from sitesight.plans.site_queries import Query, shown
from sitesight.workspace import by_size, kept_once, still_stored

# Coarse grids: small enough for the plain-join SQL that checks them on whole tables.
COARSE = {"mean_cells": 60, "region_mean": M.beta(2, 2, 20)}
CHECKED: dict[str, Model] = {
    "fixed_precision": M.fixed_precision(**COARSE),
    "three_level": M.three_level(4, **COARSE),
    "own_precision": M.own_precision(4, **COARSE),
    "two_level": M.two_level(4, **COARSE),
    "hyper_prior": M.hyper_prior(4, 4, **COARSE),
}
YEARLY = M.three_level(3, **COARSE)
MONTHLY = M.three_level(2, mean_cells=40, region_mean=M.beta(2, 2, 15))
#: Regions whose posterior stands for one that does not cover all groups.
COVERED = ["ASIA", "EUROPE"]
FULL = M.three_level()

_fits: dict[tuple[str, str, str], P.Posterior] = {}


def _fitted(spark: SparkSession, d: str, name: str, model: Model, sites: DataFrame, period=None) -> P.Posterior:
    """One fit per application, folder and model; its tables are kept files."""
    slot = (spark.sparkContext.applicationId, d, name)
    if slot not in _fits or not still_stored(_fits[slot].municipalities):
        # the SQL that checks these sums over the grid as given
        _fits[slot] = P.fit_on_grid(sites, model, period)
    return _fits[slot]


def _resolved(spark: SparkSession, d: str, name: str, model: Model, sites: DataFrame) -> P.Posterior:
    """One fit per application, folder and model, on grids that follow the posterior."""
    slot = (spark.sparkContext.applicationId, d, name)
    if slot not in _fits or not still_stored(_fits[slot].municipalities):
        _fits[slot] = P.fit(sites, model)
    return _fits[slot]


def site_year(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        months = site_month(spark, d)
        return (
            by_size(months, months.count(), "region", "municipality", "site_id")
            .groupBy(F.year("month").alias("year"), "region", "municipality", "site_id")
            .agg(F.sum("tests").alias("tests"), F.sum("successes").alias("successes"))
        )

    return kept_once(spark, d, "site_year", build)


def _municipalities(name: str, model: Model) -> Query:
    return lambda s, d: shown(
        _fitted(s, d, name, model, site_fact(s, d)).municipalities, "region", "municipality", "mean_mun", "sd_mun"
    )


def _regions(name: str, model: Model) -> Query:
    return lambda s, d: shown(
        _fitted(s, d, name, model, site_fact(s, d)).regions, "region", "mean_region", "sd_region"
    )


def _sites(name: str, model: Model) -> Query:
    return lambda s, d: shown(
        P.site_posterior(site_fact(s, d), _fitted(s, d, name, model, site_fact(s, d))),
        "region", "municipality", "site_id", "mean_site", "sd_site",
    )


def _shared(name: str) -> Query:
    return lambda s, d: shown(
        P.shared_parameters(_fitted(s, d, name, CHECKED[name], site_fact(s, d))), "param", "mean", "sd"
    )


def _monthly(spark: SparkSession, d: str) -> P.Posterior:
    """All months as one job, each fitted on its own; ``posterior_by_month`` has a fit on the whole grids."""
    return _fitted(spark, d, "month", MONTHLY, site_month(spark, d), ["month"])


def _region_month_posterior(spark: SparkSession, d: str) -> DataFrame:
    """A report line for each region and month from its posterior: rounded mean and sd."""
    rows = _monthly(spark, d).regions
    return rows.select(
        F.col("region").alias("parameter"), half_even(F.col("mean_region"), 3).alias("mean"),
        half_even(F.col("sd_region"), 3).alias("std_dev"), month_label(F.col("month")).alias("month_label"),
    )


def _risen(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities whose posterior mean rose from the first month to the last by more than twice both sds."""
    panel = _monthly(spark, d).municipalities
    ends = panel.agg(F.min("month").alias("first"), F.max("month").alias("last"))
    keys = ["region", "municipality"]
    at = lambda m, tag: panel.where(F.col("month") == ends.select(m).scalar()).select(*keys, F.col("mean_mun").alias(f"mean_{tag}"), F.col("sd_mun").alias(f"sd_{tag}"))
    both = at("first", "first").join(at("last", "last"), keys)
    far = F.col("mean_last") - F.col("mean_first") > 2 * F.sqrt(F.col("sd_first") * F.col("sd_first") + F.col("sd_last") * F.col("sd_last"))
    return shown(both.where(far), *keys, "mean_first", "mean_last")


def _covered(known: bool) -> Query:
    """Sites whose municipality has a posterior, or has none, in a fit of some regions only."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        sites = site_fact(spark, d)
        fitted = _fitted(spark, d, "covered", CHECKED["fixed_precision"], sites.where(F.col("region").isin(COVERED)))
        keys = ["region", "municipality"]
        rows = sites.join(fitted.municipalities.select(*keys), keys, "left_semi" if known else "left_anti")
        return rows.select(*keys, "site_id")

    return run


def full_sites(spark: SparkSession, d: str) -> DataFrame:
    """Site posterior on grids that follow the data."""

    def build() -> DataFrame:
        sites = site_fact(spark, d)
        return P.site_posterior(sites, P.fit(sites, FULL))

    return kept_once(spark, d, "full_sites", build)


def _priorities_from_model(spark: SparkSession, d: str) -> DataFrame:
    """The priority list fed by the model instead of the closed form."""
    rows = P.for_priorities(full_sites(spark, d), site_fact(spark, d), kpi.MUNICIPALITY)
    return shown(
        kpi.prioritise_by_share(rows), *kpi.PRIORITY_COLUMNS, "failure_share", "impact", "rank"
    )


def _logit(name: str, model: Model) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        sites = site_fact(spark, d)
        rows = P.site_posterior(sites, _resolved(spark, d, name, model, sites))
        return shown(
            rows, "region", "municipality", "site_id", "mean_site", "sd_site", "lo_site", "hi_site", "mean_mun"
        )

    return run


SITE_KEYS = ["region", "municipality", "site_id"]


def _sampled(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    fitted = _fitted(spark, d, "three_level", CHECKED["three_level"], site_fact(spark, d))
    return sampling.posterior_draws(site_fact(spark, d), fitted, chains=2, draws=250)


def _counted_draws(spark: SparkSession, d: str) -> DataFrame:
    """Site draws with the counts they are held against: the sites are joined, not their draws."""
    sites = site_fact(spark, d)
    fitted = _fitted(spark, d, "three_level", CHECKED["three_level"], sites)
    held = sites.select(*SITE_KEYS, F.col("tests").alias("held_tests"), F.col("successes").alias("held_successes"))
    tables = sampling.posterior_draws(sites.join(held, SITE_KEYS), fitted, chains=2, draws=250, carry=["held_tests", "held_successes"])
    return tables["site_rate"].withColumnsRenamed({"held_tests": "tests", "held_successes": "successes"})


def _draw_summary(spark: SparkSession, d: str) -> DataFrame:
    return shown(draws.posterior_summary(_sampled(spark, d)["site_rate"], SITE_KEYS, 0.95), *SITE_KEYS, "mean", "sd", "hdi_lo", "hdi_hi")


def _group_draw_summary(level: str, keys: list[str]) -> Query:
    return lambda s, d: shown(
        diagnostics.full_summary(_sampled(s, d)[level], keys, 0.95), *keys, "mean", "sd", "hdi_lo", "hdi_hi", "ess", "rhat"
    )


def _region_comparison(spark: SparkSession, d: str) -> DataFrame:
    region = _sampled(spark, d)["region_mean"]
    return shown(
        draws.prob_greater(region, draws.neighbour_pairs(region, "region"), "region"), "better", "worse", "draws", "prob"
    )


def _explained(spark: SparkSession, d: str) -> DataFrame:
    about = table(spark, d, "customer").select(
        F.col("c_custkey").alias("site_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )
    return site_fact(spark, d).join(about, "site_id")


def _factors(spark: SparkSession, d: str) -> DataFrame:
    return shown(
        factors.success_factors(_explained(spark, d), "segment + balance"), "factor", "coefficient", "std_error", "p_value"
    )


def _factor_totals(spark: SparkSession, d: str) -> DataFrame:
    """Observed and expected successes of each segment, and a test's mean balance that succeeded: the score equations."""
    sites = factors.expected_successes(_explained(spark, d), "segment + balance").withColumn("balance", F.col("balance").cast("double"))
    by_segment = sites.groupBy(F.col("segment").alias("factor")).agg(
        F.sum("successes").cast("double").alias("observed"), F.sum("expected").alias("expected")
    )
    per_test = lambda x: F.try_divide(F.sum(F.col(x) * F.col("balance")), F.sum("tests"))
    balance = sites.agg(per_test("successes").alias("observed"), per_test("expected").alias("expected"))
    rows = by_segment.unionByName(balance.withColumn("factor", F.lit("balance")))
    return shown(rows, "factor", "observed", "expected", digits=4)


QUERIES: dict[str, Query] = {
    **{f"posterior_{n}": _municipalities(n, m) for n, m in CHECKED.items()},
    **{f"posterior_{n}_regions": _regions(n, m) for n, m in CHECKED.items()},
    **{f"posterior_{n}_sites": _sites(n, CHECKED[n]) for n in ("fixed_precision", "three_level")},
    "posterior_by_month": lambda s, d: shown(
        _fitted(s, d, "month_full", FULL, site_month(s, d), ["month"]).municipalities,
        "month", "region", "municipality", "mean_mun", "sd_mun",
    ),
    "region_month_posterior": _region_month_posterior,
    "risen_municipalities_posterior": _risen,
    "sites_with_posterior": _covered(True),
    "sites_without_posterior": _covered(False),
    **{f"posterior_shared_{n}": _shared(n) for n in ("three_level", "hyper_prior")},
    "posterior_by_year": lambda s, d: shown(
        _fitted(s, d, "year", YEARLY, site_year(s, d), ["year"]).municipalities,
        "year", "region", "municipality", "mean_mun", "sd_mun",
    ),
    "posterior_by_year_regions": lambda s, d: shown(
        _fitted(s, d, "year", YEARLY, site_year(s, d), ["year"]).regions, "year", "region", "mean_region", "sd_region"
    ),
    "posterior_sites_full": lambda s, d: shown(
        full_sites(s, d),
        "region", "municipality", "site_id", "mean_site", "sd_site", "lo_site", "hi_site", "mean_mun", "lo_mun", "hi_mun",
    ),
    "prioritisation_posterior": _priorities_from_model,
    "posterior_draws": _draw_summary,
    "posterior_draws_regions": _group_draw_summary("region_mean", ["region"]),
    "posterior_draws_municipalities": _group_draw_summary("municipality_mean", ["region", "municipality"]),
    "prob_region_better": _region_comparison,
    "dic": lambda s, d: shown(
        diagnostics.dic(_counted_draws(s, d)),
        "draws", "mean_deviance", "p_d", "dic",
    ),
    "success_factors": _factors,
    "factor_totals": _factor_totals,
    "posterior_logit_normal": _logit("logit", M.logit_normal(5, mean_cells=80)),
    "posterior_logit_normal_revised": _logit("logit2", M.logit_normal_revised(5, 5, mean_cells=80)),
}

ORACLES: dict[str, str] = {
    **{f"posterior_{n}": O.municipality_sql(m) for n, m in CHECKED.items()},
    **{f"posterior_{n}_regions": O.region_sql(m) for n, m in CHECKED.items()},
    **{f"posterior_{n}_sites": O.site_sql(CHECKED[n]) for n in ("fixed_precision", "three_level")},
    "risen_municipalities_posterior": O.month_sql(
        MONTHLY,
        f"""SELECT b.region, b.municipality, {r('a.mean_mun', 'mean_first')}, {r('b.mean_mun', 'mean_last')} FROM mun a JOIN mun b
        ON a.region = b.region AND a.municipality = b.municipality
        WHERE a.month = (SELECT min(month) FROM mun) AND b.month = (SELECT max(month) FROM mun)
          AND b.mean_mun - a.mean_mun > 2 * sqrt(a.sd_mun ** 2 + b.sd_mun ** 2)""",
    ),
    "posterior_by_month": O.full_month_sql(FULL),
    "region_month_posterior": O.month_sql(
        MONTHLY, f"SELECT region AS parameter, {r('mean_region', 'mean', 3)}, {r('sd_region', 'std_dev', 3)}, {MONTH_LABEL} FROM reg"
    ),
    "factor_totals": W_SITE
    + """, about AS (SELECT f.*, c_mktsegment AS segment, c_acctbal::DOUBLE AS balance FROM site_fact f JOIN customer ON c_custkey = site_id WHERE tests > 0)
SELECT segment AS factor, sum(successes)::DOUBLE AS observed, sum(successes)::DOUBLE AS expected FROM about GROUP BY segment
UNION ALL SELECT 'balance', round_even(sum(successes * balance) / sum(tests), 4), round_even(sum(successes * balance) / sum(tests), 4) FROM about""",
    "sites_with_posterior": W_SITE + "SELECT region, municipality, site_id FROM site_fact WHERE region IN ('ASIA', 'EUROPE')",
    "sites_without_posterior": W_SITE + "SELECT region, municipality, site_id FROM site_fact WHERE region NOT IN ('ASIA', 'EUROPE')",
    **{f"posterior_shared_{n}": O.shared_sql(CHECKED[n]) for n in ("three_level", "hyper_prior")},
    "posterior_by_year": O.year_municipality_sql(YEARLY),
    "posterior_by_year_regions": O.year_region_sql(YEARLY),
}
