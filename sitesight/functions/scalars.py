"""Column helpers; all are built-in expressions and stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations used in labels such as 'out/24'.
MONTHS_PT = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]

# Fixed value: added to a min-max range so that a constant group divides by it.
RANGE_EPSILON = 1e-8


def successes_from_rate(tests: Column, rate: Column) -> Column:
    """Whole number of successes, halves to the even neighbour."""
    return F.bround(tests * rate).cast("bigint")


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def ratio(top: Column, bottom: Column) -> Column:
    """Plain ratio; null where the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Position inside a range, 0 for a range of one point."""
    return (value - low) / (high - low + F.lit(RANGE_EPSILON))


def interval_text(low: Column, high: Column, digits: int = 3) -> Column:
    """``[lo, hi]`` without trailing zeros."""
    return F.format_string("[%s, %s]", half_even(low, digits), half_even(high, digits))


def parameter_index(name: Column) -> Column:
    """The number inside brackets of a name such as ``rate[12]``."""
    return F.regexp_extract(name, r"\[(\d+)\]", 1).cast("int")


def label(*parts: Column, sep: str = ", ") -> Column:
    return F.concat_ws(sep, *parts)


def clip_low(value: Column, low: float = 0.0) -> Column:
    return F.greatest(value, F.lit(low))


def month_from_label(text: Column) -> Column:
    """First day of the month for a label ``mmm/yy``; null for an unknown name. 69-99 are 1969-1999, 00-68 are 2000-2068."""
    names = F.array(*[F.lit(m) for m in MONTHS_PT])
    number = F.array_position(names, F.lower(F.substring(text, 1, 3))).cast("int")
    short = F.substring(text, 5, 2).cast("int")
    year = short + F.when(short >= 69, 1900).otherwise(2000)
    return F.when(number > 0, F.make_date(year, number, F.lit(1)))


def month_label(month: Column) -> Column:
    """``mmm/yy`` for a date."""
    names = F.array(*[F.lit(m) for m in MONTHS_PT])
    return F.concat(
        F.element_at(names, F.month(month)),
        F.lit("/"),
        F.lpad((F.year(month) % 100).cast("string"), 2, "0"),
    )


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_gamma(x: Column) -> Column:
    """Natural log of the gamma function for x > 0.

    Eight steps of the recurrence move x above 8, where the asymptotic series is exact to
    double precision.
    """
    y = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    t = 1 / (y * y)
    series = (1 / 12 - t * (1 / 360 - t * (1 / 1260 - t * (1 / 1680 - t / 1188)))) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def log_binomial(k: Column, n: Column, p: Column) -> Column:
    """Log probability of k successes in n tests; 0·log 0 counts as 0."""
    choose = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    won = F.when(k > 0, k * F.log(p)).otherwise(0.0)
    lost = F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)
    return choose + won + lost


# Coefficients of Acklam's rational approximation to the normal quantile
# (published, relative error below 1.2e-9).
_TAIL = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838,
         -2.549732539343734, 4.374664141464968, 2.938163982698783]
_TAIL_DEN = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0]
_MID = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
        1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239]
_MID_DEN = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01, 1.0]


def _horner(coefficients: list[float], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function for 0 < p < 1."""
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    return (
        F.when(p < 0.02425, _horner(_TAIL, low) / _horner(_TAIL_DEN, low))
        .when(p > 1 - 0.02425, -_horner(_TAIL, high) / _horner(_TAIL_DEN, high))
        .otherwise(q * _horner(_MID, q * q) / _horner(_MID_DEN, q * q))
    )
