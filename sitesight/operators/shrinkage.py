"""Closed-form estimates: raw, pooled and two-level shrunken rates.

Sites shrink to their municipality and municipalities to their region. Each level's prior
precision is the moment estimate for over-dispersed counts. Everything needed from a
group is a handful of sums, so each level is one map-side combined aggregate, and the
group tables are small and attach by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesight.functions.scalars import ratio
from sitesight.workspace import keep

# Prior precision where a group cannot tell (single unit, rate 0 or 1),
# and the limits of the intra-group correlation.
SITE_PRECISION = 20.0
MUNICIPALITY_PRECISION = 100.0
RHO_LIMITS = (1e-4, 0.99)
NORMAL_95 = 1.96


def raw_rate(sites: DataFrame, out: str = "raw_rate") -> DataFrame:
    return sites.withColumn(out, ratio(F.col("successes"), F.col("tests")))


def pooled_rate(sites: DataFrame, keys: list[str]) -> DataFrame:
    """One rate per group: all tests of the group taken together."""
    return sites.groupBy(*keys).agg(
        F.sum("tests").alias("tests"),
        F.sum("successes").alias("successes"),
        ratio(F.sum("successes"), F.sum("tests")).alias("pooled_rate"),
    )


def rate_levels(sites: DataFrame) -> DataFrame:
    """Region, municipality and site rates in one pass; ``level`` is 0 for a site row."""
    return (
        sites.rollup("region", "municipality", "site_id")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("tests").alias("tests"),
            F.sum("successes").alias("successes"),
            ratio(F.sum("successes"), F.sum("tests")).alias("rate"),
        )
    )


def _correlation(
    units: Column, tests: Column, successes: Column, sum_sq: Column, sum_k2n: Column, default: float
) -> Column:
    """Moment estimate of the share of variance between the units of a group."""
    p = F.try_divide(successes, tests)
    spread = sum_k2n - successes * F.try_divide(successes, tests)
    below = tests - F.try_divide(sum_sq, tests) - (units - 1)
    rho = F.try_divide(F.try_divide(spread, p * (1 - p)) - (units - 1), below)
    low, high = RHO_LIMITS
    return F.when(rho.isNull() | (below <= 0), F.lit(1.0 / (default + 1))).otherwise(
        F.greatest(F.lit(low), F.least(F.lit(high), rho))
    )


def _sums(n: str, k: str) -> list[Column]:
    """The sums a moment estimate needs; units without tests carry no information."""
    has = F.col(n) > 0
    return [
        F.count_if(has).cast("double").alias("_g"),
        F.sum(F.col(n)).cast("double").alias("_n"),
        F.sum(F.col(k)).cast("double").alias("_k"),
        F.sum(F.col(n).cast("double") * F.col(n)).alias("_n2"),
        F.sum(F.when(has, F.col(k).cast("double") * F.col(k) / F.col(n))).alias("_k2n"),
    ]


def _posterior(df: DataFrame, k: str, n: str, centre: str, phi: str, name: str) -> DataFrame:
    """Mean, standard deviation and clipped 95 % normal interval of the shrunken rate."""
    k_, n_, c, f = (F.col(x) for x in (k, n, centre, phi))
    mean = (k_ + c * f) / (n_ + f)
    return (
        df.withColumn(f"mean_{name}", mean)
        .withColumn(f"sd_{name}", F.sqrt(F.col(f"mean_{name}") * (1 - F.col(f"mean_{name}")) / (n_ + f + 1)))
        .withColumn(
            f"lo_{name}",
            F.greatest(F.lit(0.0), F.col(f"mean_{name}") - NORMAL_95 * F.col(f"sd_{name}")),
        )
        .withColumn(
            f"hi_{name}",
            F.least(F.lit(1.0), F.col(f"mean_{name}") + NORMAL_95 * F.col(f"sd_{name}")),
        )
    )


def municipality_estimates(sites: DataFrame, period: list[str] | None = None) -> DataFrame:
    """One row per municipality with its own and its region's estimate.

    ``period`` adds keys (for example ``month``) so that every period is fitted on its
    own in the same job. Kept: the table is read by every site-level operator.
    """
    period = period or []
    failures = F.col("tests") - F.col("successes")
    own = keep(
        sites.groupBy(*period, "region", "municipality").agg(
            *_sums("tests", "successes"),
            F.count(F.lit(1)).alias("n_sites"),
            F.min(failures).alias("min_failures"),
            F.max(failures).alias("max_failures"),
        ),
        "municipality_sums",
    )
    mun = own.select(
        *period, "region", "municipality", "n_sites", "min_failures", "max_failures",
        F.col("_n").cast("bigint").alias("tests_mun"),
        F.col("_k").cast("bigint").alias("successes_mun"),
        (
            1 / _correlation(*(F.col(c) for c in ("_g", "_n", "_k", "_n2", "_k2n")), SITE_PRECISION) - 1
        ).alias("phi_site"),
    )
    region = (
        mun.groupBy(*period, "region")
        .agg(*_sums("tests_mun", "successes_mun"))
        .select(
            *period, "region",
            F.col("_n").cast("bigint").alias("tests_region"),
            F.col("_k").cast("bigint").alias("successes_region"),
            F.try_divide("_k", "_n").alias("mean_region"),
            (
                1 / _correlation(
                    *(F.col(c) for c in ("_g", "_n", "_k", "_n2", "_k2n")), MUNICIPALITY_PRECISION
                ) - 1
            ).alias("phi_mun"),
        )
        .withColumn(
            "sd_region",
            F.sqrt(F.col("mean_region") * (1 - F.col("mean_region")) / (F.col("tests_region") + 1)),
        )
        .withColumn("lo_region", F.greatest(F.lit(0.0), F.col("mean_region") - NORMAL_95 * F.col("sd_region")))
        .withColumn("hi_region", F.least(F.lit(1.0), F.col("mean_region") + NORMAL_95 * F.col("sd_region")))
    )
    both = mun.join(region, [*period, "region"])
    return keep(
        _posterior(both, "successes_mun", "tests_mun", "mean_region", "phi_mun", "mun"),
        "municipality_estimates",
    )


def site_estimates(sites: DataFrame, municipalities: DataFrame, period: list[str] | None = None) -> DataFrame:
    """Every site row with its shrunken rate and the estimates of its parents.

    The municipality table is a kept file; it is broadcast when it is small and joined by
    shuffle when it is not. A left join keeps every site.
    """
    joined = sites.join(municipalities, [*(period or []), "region", "municipality"], "left")
    return _posterior(joined, "successes", "tests", "mean_mun", "phi_site", "site")
