"""Functions on distributions that Spark SQL lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Abramowitz and Stegun's formula 7.1.26 for the error function (fixed values).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """Cumulative normal distribution, to 1e-7; null for null."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(ERF_A[-1])
    for a in ERF_A[-2::-1]:
        poly = poly * t + F.lit(a)
    tail = poly * t * F.exp(-z * z) / F.lit(2.0)
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(F.when(x.isNotNull(), tail))


def normal_cdf_sql(x: str) -> str:
    """The same in SQL."""
    z = f"(abs({x}) / {2.0**0.5!r}::DOUBLE)"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P}::DOUBLE * {z}))"
    poly = f"{ERF_A[-1]}::DOUBLE"
    for a in ERF_A[-2::-1]:
        poly = f"({poly} * {t} + ({a}::DOUBLE))"
    tail = f"({poly} * {t} * exp(-{z} * {z}) / 2.0::DOUBLE)"
    return f"CASE WHEN {x} >= 0 THEN 1.0::DOUBLE - {tail} WHEN {x} IS NOT NULL THEN {tail} END"


def creep_confidence(velocity: Column, sigma: Column, threshold: float = -15.0) -> Column:
    """Probability that the true velocity is beyond the threshold."""
    return normal_cdf(F.try_divide(F.lit(threshold) - velocity, sigma))


def exact_mean(x: Column) -> Column:
    """Aggregate: mean that does not depend on the order of rows: decimals are added, and rounded to a double once.

    Values from 1e20 on, which such decimals do not hold, are averaged as doubles.
    """
    d = x.cast("double").try_cast("decimal(38,18)")
    return F.when(F.count(d) == F.count(x), F.sum(d).cast("double") / F.count(x)).otherwise(F.avg(x))


def any_of(p: Column) -> Column:
    """Aggregate: probability that at least one of independent events holds."""
    return 1.0 - F.product(1.0 - p)


def guarded_corr(x: Column, y: Column) -> Column:
    """Aggregate: correlation over rows that have both; null without spread."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.nullif(F.var_pop(x) * F.var_pop(y), F.lit(0.0))))
