"""Which explanatory variables go with a better rate: a binomial regression on sites."""

from __future__ import annotations

from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesight.functions.scalars import ratio


def _regression(sites: DataFrame, formula: str) -> tuple[DataFrame, GeneralizedLinearRegressionModel]:
    """Sites with tests and their features, and the model fitted to them."""
    rows = sites.where(F.col("tests") > 0).select(
        "*",
        ratio(F.col("successes"), F.col("tests")).alias("observed_rate"),
        F.col("tests").cast("double").alias("_weight"),
    )
    prepared = RFormula(formula=f"observed_rate ~ {formula}", featuresCol="_features", labelCol="_label").fit(rows)
    table = prepared.transform(rows)
    return table, GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_features", labelCol="_label", weightCol="_weight",
        predictionCol="_rate", tol=1e-10, maxIter=50,
    ).fit(table.select("_features", "_label", "_weight"))


def expected_successes(sites: DataFrame, formula: str) -> DataFrame:
    """Sites with tests, and ``expected``: the successes that the regression on ``formula`` expects of them."""
    table, fitted = _regression(sites, formula)
    return fitted.transform(table).select(*sites.columns, (F.col("tests") * F.col("_rate")).alias("expected"))


def success_factors(sites: DataFrame, formula: str) -> DataFrame:
    """Coefficients, standard errors and p-values of a weighted binomial regression.

    ``formula`` names the explanatory columns, for example ``segment + balance``. A site
    counts with its tests; sites without tests say nothing and are left out. The fit
    passes over the data a few times and sends only cross-product sums to the driver.
    """
    table, fitted = _regression(sites, formula)
    meta = table.schema["_features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for kind in meta.values() for a in kind), key=lambda a: a["idx"])]
    s = fitted.summary
    values = zip(
        [*names, "(intercept)"],
        [*fitted.coefficients.tolist(), fitted.intercept],
        list(s.coefficientStandardErrors),
        list(s.pValues),
    )
    return sites.sparkSession.createDataFrame(
        [(n, float(c), float(e), float(p)) for n, c, e, p in values],
        "factor string, coefficient double, std_error double, p_value double",
    )
