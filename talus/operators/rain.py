"""Operators on rain series: exceedance of thresholds, bursts, sweeps and events.

Series are DataFrames with the columns of `by` (for example a site), an order column and
values; each series is a window partition of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import rain as R


def spine(df: DataFrame, by: list[str], date: str) -> DataFrame:
    """Every day from a series' first to its last, one row each."""
    ends = df.groupBy(*by).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return ends.select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date))


def wetness(daily: DataFrame, by: list[str], k: float = 0.9, n: int = 14) -> DataFrame:
    """water_mm, api_mm, wetness_0_1 (index over its 95th percentile) and freeze_thaw for each day."""
    series = Window.partitionBy(*by).orderBy("date")
    df = daily.withColumn("water_mm", R.water(F.col("rain_mm"), F.col("snowmelt_mm")))
    df = df.withColumn("api_mm", R.antecedent_index(F.col("water_mm"), series, k, n))
    p95 = df.groupBy(*by).agg(F.percentile("api_mm", F.lit(0.95)).alias("p95"))
    ratio = F.try_divide(F.col("api_mm"), F.col("p95"))
    return df.join(p95, by).withColumns({"wetness_0_1": F.coalesce(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), "freeze_thaw": F.coalesce(R.freeze_thaw(F.col("tmin_c"), F.col("tmax_c")), F.lit(0))}).drop("p95")


def peak_exceedance(daily: DataFrame, by: list[str], a: float, b: float, value: str = "water_mm", durations: tuple[int, ...] = R.DAYS) -> DataFrame:
    """exceedance (largest ratio of a trailing sum to its threshold) and won_duration_d (the shortest that reaches it)."""
    series = Window.partitionBy(*by).orderBy("date")
    ratios = {f"_r{d}": R.rolling_sum(F.col(value), d, series) / R.threshold_depth(d, a, b) for d in durations}
    df = daily.withColumns(ratios)
    each = [(d, F.col(f"_r{d}")) for d in durations]
    largest = F.greatest(F.lit(0.0), *(F.coalesce(c, F.lit(0.0)) for _, c in each))
    return df.withColumns({"exceedance": largest, "won_duration_d": R.first_largest(each, 0).cast("int")}).drop(*ratios)


def exceedance_by_duration(daily: DataFrame, by: list[str], a: float, b: float, value: str = "water_mm", durations: tuple[int, ...] = R.DAYS) -> DataFrame:
    """For each series and duration: days above the threshold, the largest ratio and its first day."""
    series = Window.partitionBy(*by).orderBy("date")
    rows = daily.withColumns({f"_s{d}": R.rolling_sum(F.col(value), d, series) for d in durations})
    each = F.array(*(F.struct(F.lit(d).alias("duration_d"), (F.col(f"_s{d}") / R.threshold_depth(d, a, b)).alias("ratio")) for d in durations))
    long = rows.select(*by, "date", F.explode(each).alias("x")).select(*by, "date", "x.*")
    best = F.min_by("date", F.struct(-F.col("ratio"), F.col("date")))
    return long.filter("ratio is not null").groupBy(*by, "duration_d").agg(F.count_if(F.col("ratio") > 1).alias("n_days"), F.max("ratio").alias("max_ratio"), best.alias("max_date"))


def alarm_calendar(daily: DataFrame, by: list[str], a: float, b: float, alert: float = 2.0, watch: float = 1.0) -> DataFrame:
    """date, water_mm, exceedance, won_duration_d and alarm_level for each day."""
    df = daily.withColumn("water_mm", R.water(F.col("rain_mm"), F.col("snowmelt_mm")))
    return peak_exceedance(df, by, a, b).withColumn("alarm_level", R.alarm_level(F.col("exceedance"), alert, watch))


def bursts(steps: DataFrame, by: list[str], a: float, b: float, hours: tuple[float, ...] = R.HOURS, step_h: float = 0.5, alert: float = 3.0, watch: float = 1.0) -> DataFrame:
    """For each day the largest exceedance of windows of some hours that end in it.

    Windows are counted in rows and run across midnight; at the beginning of a series they are
    shorter but still divided by their duration. Of equal ones the shortest, then the first,
    counts. A day of fewer steps than a whole day has is provisional.
    """
    series = Window.partitionBy(*by).orderBy("ts")
    depth = F.col("rate_mm_h") * step_h
    sums = {f"_s{i}": F.sum(depth).over(series.rowsBetween(-(max(1, round(h / step_h)) - 1), 0)) for i, h in enumerate(hours)}
    each = F.array(*(F.struct((F.col(f"_s{i}") / h / R.threshold_intensity(h, a, b)).alias("e"), F.lit(h).alias("h"), F.col(f"_s{i}").alias("mm")) for i, h in enumerate(hours)))
    best = F.reduce(each, F.element_at(each, 1), lambda x, y: F.when(y["e"] > x["e"], y).otherwise(x))
    rows = steps.withColumns(sums).select(*by, F.to_date("ts").alias("date"), "ts", depth.alias("mm"), best.alias("best"))
    top = F.min_by(F.struct("best", "ts"), F.struct(-F.col("best.e"), F.col("best.h"), F.col("ts")))
    days = rows.groupBy(*by, "date").agg(F.count("*").alias("n_steps"), F.sum("mm").alias("total_mm"), top.alias("t"))
    wet = F.col("t.best.e") > 0
    return days.select(
        *by, "date", "n_steps", (F.col("n_steps") < round(24 / step_h)).alias("provisional"), "total_mm",
        F.when(wet, F.col("t.best.e")).otherwise(0.0).alias("max_e"), R.alarm_level(F.when(wet, F.col("t.best.e")).otherwise(0.0), alert, watch).alias("level"),
        F.when(wet, F.col("t.best.h")).alias("duration_h"), F.when(wet, F.col("t.best.mm")).alias("burst_mm"),
        F.when(wet, F.col("t.best.mm") / F.col("t.best.h")).alias("peak_mmph"), F.when(wet, F.col("t.ts")).alias("window_end"),
    )


def day_exceedance(rates: DataFrame, by: list[str], slot: str, a: float, b: float, hours: tuple[float, ...] = R.HOURS, step_h: float = 0.5) -> DataFrame:
    """max_e of each series and day: the largest exceedance over all durations of windows that lie within the day.

    `slot` is the second at which a step begins; missing steps are dry, so that windows are of time and not of rows.
    """
    day = F.floor(F.col(slot) / 86400)
    line = Window.partitionBy(*by, "_day").orderBy(slot)
    depth = F.col("rate_mm_h") * step_h
    each = [F.sum(depth).over(line.rangeBetween(-int(h * 3600 - step_h * 3600), 0)) / (h * a * h**-b) for h in hours]
    rows = rates.withColumn("_day", day).select(*by, "_day", F.greatest(*each).alias("_e"))
    return rows.groupBy(*by, "_day").agg(F.max("_e").alias("max_e")).select(*by, F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day").cast("int")).alias("date"), "max_e")


def peak_intensity(steps: DataFrame, by: list[str], hours: tuple[float, ...] = R.HOURS, step_h: float = 0.5) -> DataFrame:
    """For each series and duration the largest mean intensity of whole windows, and when the first such window ends."""
    series = Window.partitionBy(*by).orderBy("ts")
    sums = [R.rolling_sum(F.col("rate_mm_h") * step_h, max(1, round(h / step_h)), series) for h in hours]
    rows = steps.withColumns({f"_s{i}": c for i, c in enumerate(sums)})
    each = F.array(*(F.struct(F.lit(h).alias("duration_h"), F.col(f"_s{i}").alias("mm")) for i, h in enumerate(hours)))
    long = rows.select(*by, "ts", F.explode(each).alias("x")).select(*by, "ts", "x.*").filter("mm is not null")
    return long.groupBy(*by, "duration_h").agg((F.max("mm") / F.col("duration_h")).alias("peak_mmph"), F.min_by("ts", F.struct(-F.col("mm"), F.col("ts"))).alias("end_ts"))


def window_totals(steps: DataFrame, ends: DataFrame, by: list[str], hours: float, step_h: float = 0.5) -> DataFrame:
    """Rain in the hours up to each `end_ts` of `ends`: after the begin, up to and with the end.

    Steps are matched to the ends by days, so that each end meets its own days only.
    """
    back = int(hours * 3600)
    days = F.sequence(F.to_date(F.timestamp_seconds(F.unix_timestamp("end_ts") - back)), F.to_date("end_ts"), F.expr("interval 1 day"))
    wanted = ends.withColumn("_day", F.explode(days))
    met = wanted.join(steps.select(*by, F.to_date("ts").alias("_day"), "ts", "rate_mm_h"), [*by, "_day"], "left")
    inside = (F.col("ts") <= F.col("end_ts")) & (F.unix_timestamp("ts") > F.unix_timestamp("end_ts") - back)
    return met.groupBy(*by, "end_ts").agg(F.coalesce(F.sum(F.when(inside, F.col("rate_mm_h") * step_h)), F.lit(0.0)).alias("total_mm"))


def threshold_sweep(days: DataFrame, by: list[str], ks: list[float], value: str = "exceedance") -> DataFrame:
    """For each series and threshold: days at or above it, and their share in per cent."""
    each = days.withColumn("k", F.explode(F.array(*(F.lit(float(k)) for k in ks))))
    return each.groupBy(*by, "k").agg(F.count_if(F.col(value) >= F.col("k")).alias("n_days"), (F.avg(F.when(F.col(value) >= F.col("k"), 1.0).otherwise(0.0)) * 100).alias("pct_days"))


def nearest_alert(events: DataFrame, days: DataFrame, by: list[str], alert: Column) -> DataFrame:
    """For each event (`event_date`) the days to the nearest alert before or after; null without any.

    The last alert before and the first after come from two windows over events and alerts together.
    """
    alerts = days.filter(alert).select(*by, F.col("date").alias("_at")).distinct()
    both = events.select(*by, F.col("event_date").alias("_at")).distinct().withColumn("_alert", F.lit(None).cast("date")).unionByName(alerts.withColumn("_alert", F.col("_at")))
    series = Window.partitionBy(*by).orderBy("_at")
    before = F.last("_alert", ignorenulls=True).over(series.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_alert", ignorenulls=True).over(series.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"_b": before, "_a": after}).filter("_alert is null").select(*by, F.col("_at").alias("event_date"), F.least(F.datediff("_at", "_b"), F.datediff("_a", "_at")).alias("delta_days"))
    return events.join(near, [*by, "event_date"], "left")


def selectivity(days: DataFrame, events: DataFrame, by: list[str], ks: list[float], window_d: int = 1) -> DataFrame:
    """For each series and threshold: alert days, their share, and events with an alert near enough."""
    each = days.select(*by, "date", "exceedance", F.explode(F.array(*(F.lit(float(k)) for k in ks))).alias("k"))
    asked = events.withColumn("k", F.explode(F.array(*(F.lit(float(k)) for k in ks))))
    near = nearest_alert(asked, each, [*by, "k"], F.col("exceedance") >= F.col("k"))
    caught = near.groupBy(*by, "k").agg(F.count("*").alias("n_events"), F.count_if(F.col("delta_days") <= window_d).alias("n_caught"))
    return threshold_sweep(days, by, ks).join(caught, [*by, "k"], "left").fillna(0, ["n_events", "n_caught"])


def percent_rank(days: DataFrame, by: list[str], value: str = "exceedance") -> DataFrame:
    """`pct_rank`: share of the series' days with a value as large or smaller, in per cent."""
    return days.withColumn("pct_rank", F.cume_dist().over(Window.partitionBy(*by).orderBy(value)) * 100)


def event_standing(events: DataFrame, days: DataFrame, by: list[str]) -> DataFrame:
    """Each event with its day's exceedance and level, and the days to the nearest ALERT and WATCH or higher."""
    same = events.join(days.select(*by, F.col("date").alias("event_date"), "exceedance", "alarm_level"), [*by, "event_date"], "left")
    alert = nearest_alert(events.select(*by, "event_date").distinct(), days, by, F.col("alarm_level") == "ALERT").withColumnRenamed("delta_days", "alert_delta")
    watch = nearest_alert(events.select(*by, "event_date").distinct(), days, by, F.col("alarm_level") != "DORMANT").withColumnRenamed("delta_days", "watch_delta")
    return same.join(alert, [*by, "event_date"], "left").join(watch, [*by, "event_date"], "left")


def freeze_thaw_by_band(daily: DataFrame, by: list[str], bands: dict[float, float]) -> DataFrame:
    """Freeze-thaw days for each elevation band: its height (m) and temperature shift (degrees)."""
    each = daily.withColumn("_b", F.explode(F.array(*(F.struct(F.lit(float(h)).alias("band_m"), F.lit(float(t)).alias("shift")) for h, t in bands.items()))))
    crossed = R.freeze_thaw(F.col("tmin_c"), F.col("tmax_c"), F.col("_b.shift"))
    return each.groupBy(*by, F.col("_b.band_m").alias("band_m")).agg(F.sum(crossed).alias("n_days"))


def contiguous_prefix(new: DataFrame, by: list[str], start: str) -> DataFrame:
    """The days that follow `start` (a column) without a gap; what comes after a missing day stays out."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("date"))
    return new.withColumn("_n", n).filter(F.datediff("date", start) == F.col("_n")).drop("_n")


def state_changes(days: DataFrame, by: list[str], level: str = "alarm_level") -> DataFrame:
    """Days whose level differs from the day before, and all ALERT days: notify."""
    before = F.lag(level).over(Window.partitionBy(*by).orderBy("date"))
    return days.withColumn("previous", before).filter(F.col("previous").isNull() | (F.col(level) != F.col("previous")) | (F.col(level) == "ALERT"))


def latest(days: DataFrame, by: list[str], order: str = "date") -> DataFrame:
    """The last row of each series."""
    row = F.struct(*(c for c in days.columns if c not in by))
    return days.groupBy(*by).agg(F.max_by(row, order).alias("r")).select(*by, "r.*")
