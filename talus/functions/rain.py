"""Column functions on rainfall: thresholds, levels, daily water and freeze-thaw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Intensity-duration thresholds I = a D^-b (mm/h, h); fixed published values.
THRESHOLDS = {"caine1980": (14.82, 0.39), "nwhimalaya": (2.9993, 0.4152)}
DAYS = (1, 2, 3, 5, 7, 10, 15)
HOURS = (0.5, 1.0, 3.0, 6.0, 12.0, 24.0)


def threshold_intensity(hours: Column | float, a: float, b: float) -> Column:
    """Mean intensity (mm/h) that reaches the threshold over a duration."""
    hours = hours if isinstance(hours, Column) else F.lit(float(hours))
    return F.lit(a) * F.pow(hours, F.lit(-b))


def threshold_depth(days: Column | float, a: float, b: float) -> Column:
    """Cumulative rain (mm) over some days that reaches the threshold."""
    hours = (days if isinstance(days, Column) else F.lit(float(days))) * 24.0
    return threshold_intensity(hours, a, b) * hours


def water(rain: Column, snowmelt: Column) -> Column:
    """Rain and snowmelt together; a missing one counts as none."""
    return F.coalesce(rain, F.lit(0.0)) + F.coalesce(snowmelt, F.lit(0.0))


def rolling_sum(value: Column, n: int, series: WindowSpec) -> Column:
    """Sum of the last n rows of an ordered series; null until there are n."""
    frame = series.rowsBetween(-(n - 1), 0)
    return F.when(F.count("*").over(frame) == n, F.sum(value).over(frame))


def antecedent_index(value: Column, series: WindowSpec, k: float = 0.9, n: int = 14) -> Column:
    """Sum of the last n + 1 rows, each weighted with k to the power of its age; short histories count as they are."""
    terms = [F.coalesce(F.lag(value, j).over(series), F.lit(0.0)) * F.lit(k**j) for j in range(1, n + 1)]
    return sum(terms, value)


def freeze_thaw(tmin: Column, tmax: Column, lapse: Column | float = 0.0) -> Column:
    """1 where the day's temperatures, shifted by `lapse`, cross zero; else 0."""
    return F.when((tmin + lapse < 0) & (tmax + lapse > 0), 1).otherwise(0)


def alarm_level(exceedance: Column, alert: float = 2.0, watch: float = 1.0) -> Column:
    """ALERT, WATCH or DORMANT."""
    return F.when(exceedance >= alert, "ALERT").when(exceedance >= watch, "WATCH").otherwise("DORMANT")


def first_largest(values: Sequence[tuple[object, Column]], other: object) -> Column:
    """The name of the largest value, the first of equal ones; `other` if none is above zero."""
    largest = F.greatest(F.lit(0.0), *(F.coalesce(v, F.lit(0.0)) for _, v in values))
    out = F.when(largest <= 0, F.lit(other))
    for name, v in values:
        out = out.when(v == largest, F.lit(name))
    return out
