"""Registered queries on draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesight.functions import scalars as S
from sitesight.operators import diagnostics as G
from sitesight.operators import draws as D
from sitesight.plans.shared_tables import draws_fact, site_fact, site_month, table
from sitesight.plans.site_queries import Query, estimates, shown
from sitesight.workspace import by_size

PARAM = ["param"]


def _on_draws(fn: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, d: shown(fn(draws_fact(spark, d)), *columns)


def _site_month_rates(spark: SparkSession, d: str) -> DataFrame:
    """The monthly rates of the sites of a municipality stand for its draws."""
    return site_month(spark, d).withColumn("value", F.col("rate"))


def _event_rows(spark: SparkSession, d: str) -> DataFrame:
    """tests and successes per event type: an event succeeds when its value is above 50."""
    return (
        table(spark, d, "events")
        .groupBy(F.col("event_type").alias("param"), F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("value") > 50).alias("successes"))
    )


def _estimates_on_rows(spark: SparkSession, d: str) -> DataFrame:
    summary = D.posterior_summary(draws_fact(spark, d), PARAM, 0.95)
    return shown(
        D.estimates_on_rows(_event_rows(spark, d), summary, PARAM),
        "param", "day", "tests", "successes", "raw_rate", "mean", "hdi_lo", "hdi_hi",
    )


def _region_month_report(spark: SparkSession, d: str) -> DataFrame:
    rates = _site_month_rates(spark, d)
    report = D.parameter_report(rates, ["region", "month"], 0.94)
    return report.select(
        F.col("region").alias("parameter"), "mean", "std_dev", "hdi_interval",
        S.month_label(F.col("month")).alias("month_label"),
    )


SITE_KEYS = ["region", "municipality", "site_id"]


def _fixed_draws(sites: DataFrame, spark: SparkSession) -> dict[str, DataFrame]:
    """Three ways to estimate a site's rate, each with draws at fixed steps around the estimate."""
    steps = spark.range(60).select((F.col("id") % 3).cast("int").alias("chain"), (F.floor(F.col("id") / 3) + 1).cast("int").alias("draw"))
    wave = F.sin(F.col("site_id") + 17 * F.col("chain") + 31 * F.col("draw"))
    rates = {
        "own": (F.col("successes") + 1) / (F.col("tests") + 2), "municipality": F.col("mean_mun"),
        "shrunk": F.col("mean_site"),
    }
    models = {}
    # dealt by the number of draws before there are any, so that they are made where they are used
    sites = by_size(sites, sites.count() * 60, *SITE_KEYS)
    for name, rate in rates.items():
        spread = F.sqrt(rate * (1 - rate) / (F.col("tests") + 20))
        value = F.least(F.greatest(rate + spread * wave, F.lit(0.001)), F.lit(0.999))
        # a fixed set of 60 steps, so this side is small at any size
        models[name] = sites.crossJoin(F.broadcast(steps)).select(*SITE_KEYS, "chain", "draw", value.alias("value"))
    return models


def _dic_models(spark: SparkSession, d: str) -> DataFrame:
    sites = estimates(spark, d)
    return shown(G.dic_models(_fixed_draws(sites, spark), sites, SITE_KEYS), "model", "draws", "mean_deviance", "penalty", "dic", digits=5)


def _dic_fixed(spark: SparkSession, d: str) -> DataFrame:
    sites = estimates(spark, d)
    return shown(G.dic(_fixed_draws(sites, spark)["shrunk"], sites, SITE_KEYS), "draws", "mean_deviance", "p_d", "dic", digits=5)


def _sketch_ranks(t: DataFrame) -> DataFrame:
    """Whether each sketched quantile has the rank asked for, to the sketch's accuracy."""
    ranks = D.ranks_of_quantiles(t, D.approximate_quantiles(t, PARAM), PARAM)
    off = 1.0 / 10_000 + 1.0 / F.col("n")
    return ranks.select("param", "quantile", ((F.col("below") <= F.col("asked") + off) & (F.col("at_most") >= F.col("asked") - off)).alias("within"))


def _months_back(spark: SparkSession, d: str) -> DataFrame:
    """Labels parsed back to dates."""
    labels = site_month(spark, d).select("month").distinct().withColumn("label", S.month_label(F.col("month")))
    return labels.select("label", S.month_from_label(F.col("label")).alias("parsed"), "month")


SUMMARY = ["param", "mean", "sd", "hdi_lo", "hdi_hi"]

QUERIES: dict[str, Query] = {
    "draws_fact": _on_draws(lambda t: t, "param", "chain", "draw", "value"),
    "draws_arrays_long": lambda s, d: shown(
        D.arrays_to_long(table(s, d, "embeddings"), ["vec_id"], "embedding"), "vec_id", "draw", "value"
    ),
    "draws_columns_long": lambda s, d: D.columns_to_long(
        site_fact(s, d), ["site_id"], ["tests", "successes"]
    ),
    "draws_thin": _on_draws(lambda t: D.thin(t, burn=100, every=5), "param", "chain", "draw", "value"),
    "draws_pool": _on_draws(lambda t: D.moments(t, PARAM), "param", "mean", "sd"),
    "draws_by_chain": _on_draws(
        lambda t: D.moments(t, ["param", "chain"], sample=True), "param", "chain", "mean", "sd"
    ),
    "param_list": _on_draws(D.params, "param"),
    "param_filter": _on_draws(
        lambda t: D.only_params(t, ["click", "view"]), "param", "chain", "draw", "value"
    ),
    "hdi_94": _on_draws(lambda t: D.hdi(t, PARAM, 0.94), "param", "hdi_lo", "hdi_hi"),
    "hdi_95": _on_draws(lambda t: D.hdi(t, PARAM, 0.95), "param", "hdi_lo", "hdi_hi"),
    "hdi_spread": _on_draws(
        lambda t: D.hdi(t, PARAM, 0.95, slice_rows=1000), "param", "hdi_lo", "hdi_hi"
    ),
    "hdi_municipality": lambda s, d: shown(
        D.hdi(_site_month_rates(s, d), ["region", "municipality"], 0.95),
        "region", "municipality", "hdi_lo", "hdi_hi",
    ),
    "draws_summary": _on_draws(lambda t: D.posterior_summary(t, PARAM, 0.95), *SUMMARY),
    "quantile_summary": _on_draws(
        lambda t: D.quantile_summary(t, PARAM), "param", "mean", "sd", *D.SUMMARY_QUANTILES
    ),
    "quantile_spread": _on_draws(
        lambda t: D.quantile_summary(t, PARAM, slice_rows=1000), "param", "mean", "sd", *D.SUMMARY_QUANTILES
    ),
    "quantile_sketch": _on_draws(
        lambda t: D.approximate_quantiles(t, PARAM), "param", *D.SUMMARY_QUANTILES
    ),
    "rhat": _on_draws(lambda t: G.rhat(t, PARAM), "param", "rhat"),
    "rhat_split": _on_draws(lambda t: G.rhat(t, PARAM, split=True), "param", "rhat"),
    "effective_size": _on_draws(lambda t: G.effective_size(t, PARAM), "param", "ess"),
    "draws_needed": _on_draws(
        lambda t: G.draws_needed(t, PARAM),
        "param", "chain", "thin", "n00", "n01", "n10", "n11", "burn_in", "needed", "least", "dependence",
    ),
    "full_summary": _on_draws(
        lambda t: G.settled(G.full_summary(t, PARAM)), *SUMMARY, "ess", "ess_bulk", "ess_tail", "rhat", "rhat_rank",
        "mcse_mean", "mcse_sd", "converged",
    ),
    "rhat_limits": _on_draws(lambda t: G.rhat_limits(t, PARAM), "param", "df_between", "df_within", "rhat_adjusted"),
    "rhat_multivariate": _on_draws(lambda t: G.rhat_multivariate(t, [], ["click", "view"]), "chains", "rhat_multivariate"),
    "dic_models": _dic_models,
    "dic_fixed": _dic_fixed,
    "quantile_sketch_ranks": _on_draws(_sketch_ranks, "param", "quantile", "within"),
    "rank_rhat": _on_draws(lambda t: G.rank_rhat(t, PARAM), "param", "rhat_bulk", "rhat_folded", "rhat_rank"),
    "prob_greater": _on_draws(
        lambda t: D.prob_greater(t, D.neighbour_pairs(t, "param"), "param"), "better", "worse", "draws", "prob"
    ),
    "estimates_on_rows": _estimates_on_rows,
    "region_month_report": _region_month_report,
    "months_parsed": _months_back,
    "forest": _on_draws(lambda t: D.forest(t, PARAM, 0.94), *SUMMARY, "q25", "q50", "q75"),
    "posterior_histogram": _on_draws(
        lambda t: D.histogram(t, PARAM, 20), "param", "bin", "bin_from", "n", "hdi_lo", "hdi_hi"
    ),
    "rank_histogram": _on_draws(lambda t: D.rank_histogram(t, PARAM, 20), "param", "chain", "bin", "n"),
    "trace_series": _on_draws(
        lambda t: D.trace_series(t.withColumn("value", F.log(1 + F.col("value"))), PARAM),
        "param", "chain", "draw", "value", "running_mean",
    ),
}
