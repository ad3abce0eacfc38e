"""Queries on rain: daily exceedance, alarms, sweeps, bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import rain as R
from talus.operators import rain as O
from talus.plans.registry import query, r6
from talus.sources.proxies import PX_BURST, PX_DAILY, px_burst, px_daily

A, B = R.THRESHOLDS["nwhimalaya"]
#: The proxy series seldom doubles the threshold, so that alerts begin lower here.
ALERT_K = 1.15
BY = ["site"]
CALENDAR_COLUMNS = ("water_mm", "exceedance")

_WATER = f"{PX_DAILY}, w AS (SELECT *, coalesce(rain_mm, 0.0) + coalesce(snowmelt_mm, 0.0) AS water_mm FROM px_daily)"
_SUM = lambda d: f"CASE WHEN count(*) OVER w{d} = {d} THEN sum(water_mm) OVER w{d} END"
_FRAMES = ", ".join(f"w{d} AS (PARTITION BY site ORDER BY date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)" for d in R.DAYS)
_DEPTH = lambda d: f"({A}::DOUBLE * pow({d * 24.0}::DOUBLE, -{B}::DOUBLE) * {d * 24.0}::DOUBLE)"
_RATIOS = ", ".join(f"{_SUM(d)} / {_DEPTH(d)} AS r{d}" for d in R.DAYS)
_GREATEST = "greatest(0.0::DOUBLE, " + ", ".join(f"coalesce(r{d}, 0.0)" for d in R.DAYS) + ")"
_WON = f"CASE WHEN {_GREATEST} <= 0 THEN 0 " + " ".join(f"WHEN r{d} = {_GREATEST} THEN {d}" for d in R.DAYS) + " END"
_CALENDAR = f"""{_WATER},
ratios AS (SELECT site, date, water_mm, {_RATIOS} FROM w WINDOW {_FRAMES}),
cal AS (SELECT site, date, water_mm, {_GREATEST} AS exceedance, ({_WON})::INT AS won_duration_d FROM ratios),
calendar AS (SELECT *, CASE WHEN exceedance >= {ALERT_K} THEN 'ALERT' WHEN exceedance >= 1.0 THEN 'WATCH' ELSE 'DORMANT' END AS alarm_level FROM cal)"""


def calendar(spark, sf_dir: str) -> DataFrame:
    return O.alarm_calendar(px_daily(spark, sf_dir), BY, A, B, ALERT_K).select("site", "date", "water_mm", "exceedance", "won_duration_d", "alarm_level")


@query("w03_peak_exceedance", f"WITH {_CALENDAR} SELECT site, date, round(water_mm, 6) AS water_mm, round(exceedance, 6) AS exceedance, won_duration_d, alarm_level FROM calendar")
def peak_exceedance(spark, sf_dir: str) -> DataFrame:
    """The alarm calendar: exceedance, the duration that wins and the level of each day."""
    return calendar(spark, sf_dir).withColumns(r6(*CALENDAR_COLUMNS))


@query("w01_rolling_sum", f"WITH {_WATER} SELECT site, date, round({_SUM(3)}, 6) AS sum3, round({_SUM(15)}, 6) AS sum15 FROM w WINDOW {_FRAMES}")
def rolling(spark, sf_dir: str) -> DataFrame:
    series, x = Window.partitionBy("site").orderBy("date"), R.water(F.col("rain_mm"), F.col("snowmelt_mm"))
    return px_daily(spark, sf_dir).withColumn("x", x).select("site", "date", F.round(R.rolling_sum(F.col("x"), 3, series), 6).alias("sum3"), F.round(R.rolling_sum(F.col("x"), 15, series), 6).alias("sum15"))


_API = "water_mm" + "".join(f" + coalesce(lag(water_mm, {j}) OVER s, 0.0) * {0.9**j!r}::DOUBLE" for j in range(1, 15))


@query(
    "w02_wetness",
    f"""WITH {_WATER}, api AS (SELECT *, {_API} AS api_mm FROM w WINDOW s AS (PARTITION BY site ORDER BY date)),
p AS (SELECT site, quantile_cont(api_mm, 0.95) AS p95 FROM api GROUP BY site)
SELECT api.site, date, round(api_mm, 6) AS api_mm, round(least(greatest(api_mm / p95, 0.0), 1.0), 6) AS wetness_0_1, (CASE WHEN tmin_c < 0 AND tmax_c > 0 THEN 1 ELSE 0 END)::INT AS freeze_thaw FROM api JOIN p ON api.site = p.site""",
)
def wetness(spark, sf_dir: str) -> DataFrame:
    return O.wetness(px_daily(spark, sf_dir), BY).select("site", "date", *(c.alias(k) for k, c in r6("api_mm", "wetness_0_1").items()), "freeze_thaw")


@query(
    "w04_id_trigger_by_duration",
    f"""WITH {_WATER}, ratios AS (SELECT site, date, {_RATIOS} FROM w WINDOW {_FRAMES}),
long AS ({" UNION ALL ".join(f"SELECT site, date, {d} AS duration_d, r{d} AS ratio FROM ratios WHERE r{d} IS NOT NULL" for d in R.DAYS)}),
best AS (SELECT site, duration_d, date, ratio, row_number() OVER (PARTITION BY site, duration_d ORDER BY ratio DESC, date) AS k FROM long)
SELECT l.site, l.duration_d, count(*) FILTER (l.ratio > 1) AS n_days, round(max(l.ratio), 6) AS max_ratio, max(b.date) AS max_date
FROM long l JOIN best b ON l.site = b.site AND l.duration_d = b.duration_d AND b.k = 1 GROUP BY 1, 2""",
)
def by_duration(spark, sf_dir: str) -> DataFrame:
    daily = px_daily(spark, sf_dir).withColumn("water_mm", R.water(F.col("rain_mm"), F.col("snowmelt_mm")))
    return O.exceedance_by_duration(daily, BY, A, B).withColumns(r6("max_ratio"))


@query("a18_threshold_sweep", f"WITH {_CALENDAR}, k AS (SELECT unnest([0.5, 0.8, 1.0, 1.15, 2.0])::DOUBLE AS k) SELECT site, k, count(*) FILTER (exceedance >= k) AS n_days, round(avg(CASE WHEN exceedance >= k THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_days FROM calendar, k GROUP BY site, k")
def sweep(spark, sf_dir: str) -> DataFrame:
    return O.threshold_sweep(calendar(spark, sf_dir), BY, [0.5, 0.8, 1.0, 1.15, 2.0]).withColumns(r6("pct_days"))


#: An order of so many times its site's mean price is an event.
LARGE = 1.97


def big_orders(spark, sf_dir: str) -> DataFrame:
    """Dated events: the days of a site's very large orders."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("event_date"), cents.alias("cents"))
    mean = o.groupBy("site").agg((F.sum("cents").cast("double") / F.count("cents")).alias("mean"))
    return o.join(mean, "site").filter(F.col("cents").cast("double") > LARGE * F.col("mean")).select("site", "event_date").distinct()


_EVENTS = f"""big AS (
  SELECT o_orderpriority AS site, CAST(o_orderdate AS DATE) AS event_date, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
ev AS (
  SELECT DISTINCT big.site, event_date
  FROM big JOIN (SELECT site, sum(cents)::BIGINT::DOUBLE / count(cents) AS mean FROM big GROUP BY site) m ON m.site = big.site
  WHERE cents::DOUBLE > {LARGE}::DOUBLE * mean)"""
_NEAR = lambda cond, name: f"SELECT e.site, e.event_date, min(abs(date_diff('day', c.date, e.event_date)))::INT AS {name} FROM ev e LEFT JOIN calendar c ON c.site = e.site AND {cond} GROUP BY 1, 2"


@query("j11_nearest_alert_delta", f"WITH {_CALENDAR}, {_EVENTS} {_NEAR("c.alarm_level = 'ALERT'", 'delta_days')}")
def nearest(spark, sf_dir: str) -> DataFrame:
    return O.nearest_alert(big_orders(spark, sf_dir), calendar(spark, sf_dir), BY, F.col("alarm_level") == "ALERT")


@query(
    "j17_event_standing",
    f"""WITH {_CALENDAR}, {_EVENTS}, a AS ({_NEAR("c.alarm_level = 'ALERT'", "alert_delta")}), b AS ({_NEAR("c.alarm_level <> 'DORMANT'", "watch_delta")})
SELECT e.site, e.event_date, round(c.exceedance, 6) AS exceedance, c.alarm_level, a.alert_delta, b.watch_delta
FROM ev e LEFT JOIN calendar c ON c.site = e.site AND c.date = e.event_date JOIN a ON a.site = e.site AND a.event_date = e.event_date JOIN b ON b.site = e.site AND b.event_date = e.event_date""",
)
def standing(spark, sf_dir: str) -> DataFrame:
    return O.event_standing(big_orders(spark, sf_dir), calendar(spark, sf_dir), BY).withColumns(r6("exceedance"))


@query(
    "a19_selectivity_score",
    f"""WITH {_CALENDAR}, {_EVENTS}, k AS (SELECT unnest([0.8, 1.0, 1.15])::DOUBLE AS k),
near AS (SELECT e.site, e.event_date, k.k, min(abs(date_diff('day', c.date, e.event_date))) AS d FROM ev e CROSS JOIN k LEFT JOIN calendar c ON c.site = e.site AND c.exceedance >= k.k GROUP BY 1, 2, 3),
caught AS (SELECT site, k, count(*) AS n_events, count(*) FILTER (d <= 1) AS n_caught FROM near GROUP BY 1, 2),
sw AS (SELECT site, k, count(*) FILTER (exceedance >= k) AS n_days, round(avg(CASE WHEN exceedance >= k THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_days FROM calendar, k GROUP BY 1, 2)
SELECT s.site, s.k, n_days, pct_days, coalesce(n_events, 0) AS n_events, coalesce(n_caught, 0) AS n_caught FROM sw s LEFT JOIN caught c ON c.site = s.site AND c.k = s.k""",
)
def selectivity(spark, sf_dir: str) -> DataFrame:
    """For thresholds, the days flagged against the events caught."""
    return O.selectivity(calendar(spark, sf_dir), big_orders(spark, sf_dir), BY, [0.8, 1.0, 1.15]).withColumns(r6("pct_days"))


@query("w15_percent_rank", f"WITH {_CALENDAR} SELECT site, date, round(cume_dist() OVER (PARTITION BY site ORDER BY exceedance) * 100, 6) AS pct_rank FROM calendar")
def pct_rank(spark, sf_dir: str) -> DataFrame:
    return O.percent_rank(calendar(spark, sf_dir).withColumn("exceedance", F.col("exceedance")), BY).select("site", "date", F.round("pct_rank", 6).alias("pct_rank"))


@query("p33_freeze_thaw_bands", f"WITH {PX_DAILY}, b AS (SELECT unnest([1500.0, 2500.0, 3500.0])::DOUBLE AS band_m, unnest([3.0, -3.0, -9.0])::DOUBLE AS shift) SELECT site, band_m, sum(CASE WHEN tmin_c + shift < 0 AND tmax_c + shift > 0 THEN 1 ELSE 0 END)::BIGINT AS n_days FROM px_daily, b GROUP BY 1, 2")
def freeze_bands(spark, sf_dir: str) -> DataFrame:
    """Freeze-thaw days by elevation band."""
    return O.freeze_thaw_by_band(px_daily(spark, sf_dir), BY, {1500: 3.0, 2500: -3.0, 3500: -9.0})


@query("w14_state_changes", f"WITH {_CALENDAR}, p AS (SELECT site, date, alarm_level, lag(alarm_level) OVER (PARTITION BY site ORDER BY date) AS previous FROM calendar) SELECT * FROM p WHERE previous IS NULL OR alarm_level <> previous OR alarm_level = 'ALERT'")
def changes(spark, sf_dir: str) -> DataFrame:
    return O.state_changes(calendar(spark, sf_dir), BY).select("site", "date", "alarm_level", "previous")


@query("w12_latest_row", f"WITH {_CALENDAR}, k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date DESC) AS k FROM calendar) SELECT site, date, round(exceedance, 6) AS exceedance, alarm_level FROM k WHERE k = 1")
def latest(spark, sf_dir: str) -> DataFrame:
    """The standing of each site."""
    return O.latest(calendar(spark, sf_dir), BY).select("site", "date", F.round("exceedance", 6).alias("exceedance"), "alarm_level")


@query(
    "w13_contiguous_prefix",
    f"""WITH {PX_DAILY}, wet AS (SELECT site, date FROM px_daily WHERE rain_mm IS NOT NULL), f AS (SELECT site, min(date) - 1 AS start FROM wet GROUP BY site),
n AS (SELECT wet.site, date, start, row_number() OVER (PARTITION BY wet.site ORDER BY date) AS k FROM wet JOIN f ON f.site = wet.site)
SELECT site, date FROM n WHERE date_diff('day', start, date) = k""",
)
def prefix(spark, sf_dir: str) -> DataFrame:
    wet = px_daily(spark, sf_dir).filter("rain_mm is not null").select("site", "date")
    start = wet.groupBy("site").agg(F.date_sub(F.min("date"), 1).alias("start"))
    return O.contiguous_prefix(wet.join(start, "site"), BY, "start").select("site", "date")


@query("a08_monthly_totals", f"WITH {_WATER} SELECT site, year(date)::INT AS year, month(date)::INT AS month, round(sum(water_mm), 6) AS total_mm, round(max(water_mm), 6) AS max_mm, round(min(tmin_c), 6) AS tmin_c FROM w GROUP BY 1, 2, 3")
def monthly(spark, sf_dir: str) -> DataFrame:
    """Totals and extremes of each month."""
    x = R.water(F.col("rain_mm"), F.col("snowmelt_mm"))
    return px_daily(spark, sf_dir).groupBy("site", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.round(F.sum(x), 6).alias("total_mm"), F.round(F.max(x), 6).alias("max_mm"), F.round(F.min("tmin_c"), 6).alias("tmin_c"))


# -- bursts ---------------------------------------------------------------------------------

_BF = ", ".join(f"h{i} AS (PARTITION BY site ORDER BY ts ROWS BETWEEN {max(1, round(h / 0.5)) - 1} PRECEDING AND CURRENT ROW)" for i, h in enumerate(R.HOURS))
_BURST = f"""{PX_BURST},
bs AS (SELECT site, ts, CAST(ts AS DATE) AS date, rate_mm_h * 0.5 AS mm, {", ".join(f"sum(rate_mm_h * 0.5) OVER h{i} AS s{i}, count(*) OVER h{i} AS c{i}" for i in range(len(R.HOURS)))} FROM px_burst WINDOW {_BF}),
bl AS ({" UNION ALL ".join(f"SELECT site, ts, date, {h}::DOUBLE AS h, s{i} AS acc, c{i} = {max(1, round(h / 0.5))} AS whole, s{i} / {h}::DOUBLE / ({A}::DOUBLE * pow({h}::DOUBLE, -{B}::DOUBLE)) AS e FROM bs" for i, h in enumerate(R.HOURS))}),
bk AS (SELECT *, row_number() OVER (PARTITION BY site, date ORDER BY e DESC, h, ts) AS k FROM bl),
bd AS (SELECT site, date, count(*) AS n_steps, sum(mm) AS total_mm FROM bs GROUP BY 1, 2)"""


@query(
    "w05_burst_daily",
    f"""WITH {_BURST}
SELECT d.site, d.date, n_steps, n_steps < 48 AS provisional, round(total_mm, 6) AS total_mm, round(e, 6) AS max_e, CASE WHEN e >= 3.0 THEN 'ALERT' WHEN e >= 1.0 THEN 'WATCH' ELSE 'DORMANT' END AS level,
       h AS duration_h, round(acc, 6) AS burst_mm, round(acc / h, 6) AS peak_mmph, k.ts AS window_end
FROM bd d JOIN bk k ON d.site = k.site AND d.date = k.date AND k.k = 1""",
)
def burst_daily(spark, sf_dir: str) -> DataFrame:
    """The largest short burst of each day."""
    return O.bursts(px_burst(spark, sf_dir), BY, A, B).withColumns(r6("total_mm", "max_e", "burst_mm", "peak_mmph"))


@query(
    "w06_peak_intensity",
    f"""WITH {_BURST}, r AS (SELECT *, row_number() OVER (PARTITION BY site, h ORDER BY acc DESC, ts) AS j FROM bl WHERE whole)
SELECT site, h AS duration_h, round(acc / h, 6) AS peak_mmph, ts AS end_ts FROM r WHERE j = 1""",
)
def intensity(spark, sf_dir: str) -> DataFrame:
    """Peak intensities of whole windows."""
    return O.peak_intensity(px_burst(spark, sf_dir), BY).withColumns(r6("peak_mmph"))


@query(
    "f11_window_total",
    f"""WITH {PX_BURST}, ends AS (SELECT DISTINCT site, date_trunc('day', ts) + INTERVAL 3 HOUR AS end_ts FROM px_burst)
SELECT e.site, e.end_ts, round(coalesce(sum(rate_mm_h * 0.5), 0.0), 6) AS total_mm
FROM ends e LEFT JOIN px_burst b ON b.site = e.site AND b.ts > e.end_ts - INTERVAL 24 HOUR AND b.ts <= e.end_ts GROUP BY 1, 2""",
)
def totals(spark, sf_dir: str) -> DataFrame:
    """Rain in the 24 hours up to 3 o'clock, as a gauge reads it."""
    steps = px_burst(spark, sf_dir)
    ends = steps.select("site", F.expr("date_trunc('day', ts) + interval 3 hours").alias("end_ts")).distinct()
    return O.window_totals(steps, ends, BY, 24.0).withColumns(r6("total_mm"))


@query("t03_provisional_days", f"WITH {PX_BURST} SELECT site, count(*) FILTER (n < 48) AS n_provisional, count(*) AS n_days, max(date) AS last_date FROM (SELECT site, CAST(ts AS DATE) AS date, count(*) AS n FROM px_burst GROUP BY 1, 2) GROUP BY site")
def provisional(spark, sf_dir: str) -> DataFrame:
    days = px_burst(spark, sf_dir).groupBy("site", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    return days.groupBy("site").agg(F.count_if(F.col("n") < 48).alias("n_provisional"), F.count("*").alias("n_days"), F.max("date").alias("last_date"))


@query(
    "o09_top_burst_days",
    f"""WITH {_BURST}, r AS (SELECT d.site, d.date, round(e, 6) AS max_e, row_number() OVER (PARTITION BY d.site ORDER BY round(e, 6) DESC, d.date DESC) AS place FROM bd d JOIN bk k ON d.site = k.site AND d.date = k.date AND k.k = 1)
SELECT site, date, max_e, place::INT AS place FROM r WHERE place <= 5""",
)
def top_days(spark, sf_dir: str) -> DataFrame:
    """The five strongest days of each site, later ones first among equals."""
    days = O.bursts(px_burst(spark, sf_dir), BY, A, B).select("site", "date", F.round("max_e", 6).alias("max_e"))
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("max_e"), F.desc("date")))
    return days.withColumn("place", place).filter("place <= 5")
