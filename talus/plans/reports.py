"""Reports composed of several operators: thresholds by duration, two dials, ranked zones, soils scored."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import physics as P
from talus.functions import rain as R
from talus.functions.stats import any_of, creep_confidence, normal_cdf_sql
from talus.operators import raster, validation, zones
from talus.operators import rain as O
from talus.plans.pixels import _W, _ZONES, KAPPA, SOIL, zone_pixels
from talus.plans.places import BUFFERS, GREEDY_SQL, KM_SQL
from talus.plans.rain import _CALENDAR, _DEPTH, _EVENTS, _FRAMES, _SUM, _WATER, BY, A, B, big_orders, calendar
from talus.plans.regions import DEGREE
from talus.plans.registry import query, r6
from talus.sources.proxies import PX_PIXELS, PX_POINTS, px_daily, px_pixels, px_points
from talus.sources.storage import stored

# -- rain -------------------------------------------------------------------------------------


@query(
    "m08_threshold_report",
    f"""WITH {_WATER}, c AS (SELECT site, date, {", ".join(f"{_SUM(d)} AS c{d}" for d in R.DAYS)} FROM w WINDOW {_FRAMES}),
l AS ({" UNION ALL ".join(f"SELECT site, date, {d} AS duration_d, c{d} AS mm, {_DEPTH(d)} AS threshold_mm FROM c" for d in R.DAYS)}),
any_d AS (SELECT site, count(DISTINCT date) AS n_trigger_days FROM l WHERE mm > threshold_mm GROUP BY site),
s AS (SELECT site, sum(rain_mm) AS rain, sum(snowmelt_mm) AS melt, count(*) FILTER (tmin_c < 0 AND tmax_c > 0) AS frost FROM w GROUP BY site)
SELECT l.site, duration_d::INT AS duration_d, round(max(threshold_mm), 6) AS threshold_mm, count(*) FILTER (mm > threshold_mm) AS n_days, min(date) FILTER (mm > threshold_mm) AS first_day,
       round(max(mm), 6) AS most_mm, min_by(date, {{'a': -round(mm, 6), 'b': date}}) FILTER (mm IS NOT NULL) AS most_day, coalesce(max(n_trigger_days), 0) AS n_trigger_days,
       round(max(rain), 6) AS rain_mm, round(max(melt), 6) AS snowmelt_mm, max(frost) AS n_frost_days
FROM l JOIN s ON s.site = l.site LEFT JOIN any_d ON any_d.site = l.site GROUP BY l.site, duration_d""",
)
def threshold_report(spark, sf_dir: str) -> DataFrame:
    """For each duration how often the threshold is passed, the most that fell and when; the season's totals beside it."""
    daily = px_daily(spark, sf_dir)
    series = Window.partitionBy("site").orderBy("date")
    water = daily.withColumn("water_mm", R.water(F.col("rain_mm"), F.col("snowmelt_mm")))
    sums = water.withColumns({f"_c{d}": R.rolling_sum(F.col("water_mm"), d, series) for d in R.DAYS})
    each = F.array(*(F.struct(F.lit(d).alias("duration_d"), F.col(f"_c{d}").alias("mm"), R.threshold_depth(d, A, B).alias("threshold_mm")) for d in R.DAYS))
    rows = sums.select("site", "date", F.explode(each).alias("x")).select("site", "date", "x.*")
    over = F.col("mm") > F.col("threshold_mm")
    most = F.min_by("date", F.when(F.col("mm").isNotNull(), F.struct(-F.round("mm", 6), F.col("date"))))
    by_duration = rows.groupBy("site", "duration_d").agg(
        F.round(F.max("threshold_mm"), 6).alias("threshold_mm"), F.count_if(over).alias("n_days"), F.min(F.when(over, F.col("date"))).alias("first_day"),
        F.round(F.max("mm"), 6).alias("most_mm"), most.alias("most_day"),
    )
    days = rows.groupBy("site", "date").agg(F.bool_or(over).alias("hit")).groupBy("site").agg(F.count_if("hit").alias("n_trigger_days"))
    frost = R.freeze_thaw(F.col("tmin_c"), F.col("tmax_c"))
    season = daily.groupBy("site").agg(F.round(F.sum("rain_mm"), 6).alias("rain_mm"), F.round(F.sum("snowmelt_mm"), 6).alias("snowmelt_mm"), F.sum(frost).alias("n_frost_days"))
    return by_duration.join(days, "site").join(season, "site")


STRINGENCY, FLOORS = [1.0, 1.05, 1.1, 1.2, 1.4], [0, 50, 75, 90, 95]
_API = "water_mm" + "".join(f" + coalesce(lag(water_mm, {j}) OVER s, 0.0) * {0.9**j!r}::DOUBLE" for j in range(1, 15))


@query(
    "m09_two_dials",
    f"""WITH {_CALENDAR}, {_EVENTS}, ap AS (SELECT site, date, {_API} AS api FROM w WINDOW s AS (PARTITION BY site ORDER BY date)),
fl AS (SELECT site, q, CASE WHEN q > 0 THEN f ELSE -1.0 END AS floor FROM (SELECT site, unnest({FLOORS}) AS q, unnest(quantile_cont(api, {[q / 100 for q in FLOORS]})) AS f FROM ap GROUP BY site)),
al AS (
  SELECT c.site, 'stringency' AS dial, k::DOUBLE AS setting, c.date, exceedance >= k AS alert FROM calendar c, (SELECT unnest({STRINGENCY}) AS k)
  UNION ALL SELECT c.site, 'antecedent', q::DOUBLE, c.date, exceedance >= 1.0 AND api >= floor FROM calendar c JOIN ap ON ap.site = c.site AND ap.date = c.date JOIN fl ON fl.site = c.site),
n AS (SELECT site, dial, setting, count(*) FILTER (alert) AS n_alert_days, count(*) AS n FROM al GROUP BY ALL),
hit AS (
  SELECT n.site, n.dial, n.setting, e.event_date, min(abs(date_diff('day', a.date, e.event_date))) AS d
  FROM n JOIN ev e ON e.site = n.site LEFT JOIN al a ON a.site = n.site AND a.dial = n.dial AND a.setting = n.setting AND a.alert GROUP BY ALL),
h AS (SELECT site, dial, setting, count(*) AS n_events, count(*) FILTER (d <= 1) AS n_caught FROM hit GROUP BY ALL)
SELECT n.site, n.dial, n.setting, n_alert_days, round(n_alert_days * 100.0::DOUBLE / n, 6) AS pct_days, n_events, n_caught,
       n_alert_days * 100.0::DOUBLE / n < 20.0 AND n_caught * 2 >= n_events AS selective
FROM n JOIN h ON h.site = n.site AND h.dial = n.dial AND h.setting = n.setting""",
)
def two_dials(spark, sf_dir: str) -> DataFrame:
    """Alert days and events caught as the threshold is raised, and as wet ground is asked for; settings that are selective and catch half."""
    events = big_orders(spark, sf_dir)
    days = stored(calendar(spark, sf_dir).select("site", "date", "exceedance"), "dial-days")
    api = O.wetness(px_daily(spark, sf_dir), BY).select("site", "date", "api_mm")
    floors = api.groupBy("site").agg(F.percentile("api_mm", F.array(*(F.lit(q / 100) for q in FLOORS))).alias("f"))
    dial = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("setting"), (F.get("f", F.lit(i)) if q else F.lit(-1.0)).alias("floor")) for i, q in enumerate(FLOORS))))
    wet = days.join(api, ["site", "date"]).join(floors, "site").withColumn("d", dial)
    wet = wet.select("site", "d.setting", "date", F.when(F.col("api_mm") >= F.col("d.floor"), F.col("exceedance")).alias("exceedance"))
    asked = events.withColumn("setting", F.explode(F.array(*(F.lit(float(q)) for q in FLOORS))))
    by_floor = O.selectivity(wet, asked, ["site", "setting"], [1.0]).select("site", F.lit("antecedent").alias("dial"), "setting", "n_days", "pct_days", "n_events", "n_caught")
    by_k = O.selectivity(days, events, BY, STRINGENCY).select("site", F.lit("stringency").alias("dial"), F.col("k").alias("setting"), "n_days", "pct_days", "n_events", "n_caught")
    selective = (F.col("pct_days") < 20.0) & (F.col("n_caught") * 2 >= F.col("n_events"))
    both = by_floor.unionByName(by_k).filter("n_events > 0").withColumn("selective", selective)
    return both.withColumnRenamed("n_days", "n_alert_days").withColumns(r6("pct_days"))


# -- zones ------------------------------------------------------------------------------------

#: Degrees within which zones of several looks are one, and the deviation of their velocities.
MERGE_DEG, SIGMA = 0.05, 8.0
_TIERS = "CASE WHEN m_star < 0.4 THEN 'dry' WHEN m_star < 0.7 THEN 'wet' ELSE 'very wet' END"


@query(
    "m13_watch_triage",
    f"""{_W}, {_ZONES},
zd AS (SELECT stack, zone, avg(row) AS r, avg(col) AS c, avg(velocity) AS v, avg(fs_sat) AS fs FROM zpx SEMI JOIN big USING (stack, zone) GROUP BY 1, 2),
ms AS (
  SELECT stack, row, col, CASE WHEN fs_sat - fs_dry < 0 THEN least(greatest(least(greatest((1.0 - fs_dry) / (fs_sat - fs_dry), 0.0), 1.0)
           - {KAPPA}::DOUBLE * (twi - avg(twi) OVER (PARTITION BY stack)), 0.0), 1.0) END AS m FROM px_pixels),
zz AS (
  SELECT zd.stack, zone, 75.0::DOUBLE + (c + 0.5::DOUBLE) * 0.02::DOUBLE AS lon, 34.0::DOUBLE + (r + 0.5::DOUBLE) * (-1.0::DOUBLE / 60.0::DOUBLE) AS lat, v, fs, coalesce(m, 1.0) AS m
  FROM zd LEFT JOIN ms ON ms.stack = zd.stack AND ms.row = round_even(r, 0)::INT AND ms.col = round_even(c, 0)::INT),
mo AS (SELECT 'all' AS place, *, {normal_cdf_sql(f"((-15.0 - v) / {SIGMA}::DOUBLE)")} AS p, row_number() OVER (ORDER BY stack, zone) AS k FROM zz), {GREEDY_SQL.format(deg=MERGE_DEG)},
g AS (
  SELECT seed, avg(lon) AS lon, avg(lat) AS lat, CASE WHEN bool_or(v <= -50 OR fs <= 0.7) THEN 'CRITICAL' ELSE 'HIGH' END AS severity, count(DISTINCT stack) AS n_looks,
         min(v) AS creep, min(m) AS m_star, 1.0 - product(1.0 - p) AS confidence FROM taken GROUP BY seed)
SELECT round(lon, 9) AS lon, round(lat, 9) AS lat, severity, n_looks, round(creep, 6) AS strongest_creep, round(m_star, 6) AS m_star, {_TIERS} AS tier, round(confidence, 6) AS confidence,
       round((1.0 - m_star) * confidence, 6) AS priority FROM g""",
)
def watch_triage(spark, sf_dir: str) -> DataFrame:
    """Zones of all looks with the saturation of their middle pixel, merged where near, and how soon and surely they fail."""
    px = px_pixels(spark, sf_dir)
    z = zones.describe(zone_pixels(spark, sf_dir).withColumn("fs", F.col("fs_sat")), ["stack"], 80.0)
    m = P.effective_critical_saturation(P.critical_saturation(F.col("fs_dry"), F.col("fs_sat")), F.col("twi"), F.col("twi_mean"), KAPPA)
    cells = px.join(px.groupBy("stack").agg(F.avg("twi").alias("twi_mean")), "stack").withColumn("m", m)
    placed = zones.zone_pixels(z, cells, ["stack"], ["m"]).withColumns({"lon": DEGREE.x(F.col("centre_col")), "lat": DEGREE.y(F.col("centre_row")), "m": F.coalesce("m", F.lit(1.0))})
    placed = placed.select(F.lit("all").alias("site"), "stack", "zone", "lon", "lat", "severity", F.col("mean_velocity").alias("v"), "m", creep_confidence(F.col("mean_velocity"), F.lit(SIGMA)).alias("p"))
    g = zones.merge_groups(placed, ["site"], ["stack", "zone"], MERGE_DEG).groupBy("seed").agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.when(F.bool_or(F.col("severity") == "CRITICAL"), "CRITICAL").otherwise("HIGH").alias("severity"),
        F.count_distinct("stack").alias("n_looks"), F.min("v").alias("creep"), F.min("m").alias("m_star"), any_of(F.col("p")).alias("confidence"),
    )
    ranked = zones.triage(g)
    return ranked.select(
        F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "severity", "n_looks", F.round("creep", 6).alias("strongest_creep"), F.round("m_star", 6).alias("m_star"),
        P.banded(F.col("m_star"), [(0.4, "dry"), (0.7, "wet"), (9.0, "very wet")], below=True).alias("tier"), F.round("confidence", 6).alias("confidence"), F.round("priority", 6).alias("priority"),
    )


# -- soils ------------------------------------------------------------------------------------

#: One property at a time around the site's soil, and the two corners where all of them weaken or strengthen it.
SOILS = {
    "baseline": {}, "phi30": {"phi": 30.0}, "phi33": {"phi": 33.0}, "phi41": {"phi": 41.0}, "dry9": {"cohesion_dry": 9.0}, "dry24": {"cohesion_dry": 24.0}, "wet2": {"cohesion_wet": 2.0},
    "wet9": {"cohesion_wet": 9.0}, "depth1.5": {"depth": 1.5}, "depth5": {"depth": 5.0}, "gamma16": {"gamma": 16.0}, "gamma22": {"gamma": 22.0},
    "weak": {"phi": 30.0, "cohesion_dry": 9.0, "cohesion_wet": 2.0, "gamma": 22.0, "depth": 5.0}, "strong": {"phi": 41.0, "cohesion_dry": 24.0, "cohesion_wet": 9.0, "gamma": 16.0, "depth": 1.5},
}
SOIL_M = 0.6
_SOIL = {name: replace(SOIL, **changes) for name, changes in SOILS.items()}
_SOIL_ROWS = ", ".join(f"('{n}', {s.cohesion_dry}::DOUBLE, {s.cohesion_wet}::DOUBLE, {s.phi}::DOUBLE, {s.gamma}::DOUBLE, {s.depth}::DOUBLE)" for n, s in _SOIL.items())
_END = lambda c, m: f"""CASE WHEN slope_deg < 2.0 THEN 5.0 WHEN gamma * depth * sin(radians(slope_deg)) * cos(radians(slope_deg)) > 1e-6 THEN
    least(greatest(({c} + (gamma - {m}::DOUBLE * 9.81::DOUBLE) * depth * cos(radians(slope_deg)) * cos(radians(slope_deg)) * tan(radians(phi)))
      / (gamma * depth * sin(radians(slope_deg)) * cos(radians(slope_deg))), 0.0), 5.0) END"""  # noqa: E731


@query(
    "m05_soils_scored",
    f"""WITH RECURSIVE {PX_PIXELS}, {PX_POINTS}, soils(soil, cd, cw, phi, gamma, depth) AS (VALUES {_SOIL_ROWS}),
fs AS (SELECT soil, stack, row, col, row::BIGINT * 1000000000 + col AS k, {_END("cd", 0.0)} AS fd, {_END("cw", 1.0)} AS fw FROM px_pixels, soils WHERE velocity < -15.0),
t0 AS (SELECT * FROM fs WHERE fw < fd AND (1.0 - {SOIL_M}::DOUBLE) * fd + {SOIL_M}::DOUBLE * fw < 1.0),
te AS (SELECT a.soil, a.stack, a.k AS a, b.k AS b FROM t0 a JOIN t0 b ON a.soil = b.soil AND a.stack = b.stack AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
tr(soil, stack, a, b) AS (
  SELECT soil, stack, k, k FROM t0 UNION SELECT r.soil, r.stack, r.a, e.b FROM tr r JOIN te e ON e.soil = r.soil AND e.stack = r.stack AND e.a = r.b),
tl AS (SELECT soil, stack, a AS k, min(b) AS zone FROM tr GROUP BY ALL),
z AS (
  SELECT soil, stack, zone, count(*) AS n, 75.0::DOUBLE + (avg(col) + 0.5::DOUBLE) * 0.02::DOUBLE AS lon, 34.0::DOUBLE + (avg(row) + 0.5::DOUBLE) * (-1.0::DOUBLE / 60.0::DOUBLE) AS lat
  FROM t0 JOIN tl USING (soil, stack, k) GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT soil, count(*) AS n_zones, sum(n)::BIGINT AS n_cells FROM z GROUP BY soil), b AS (SELECT unnest({BUFFERS})::DOUBLE AS buffer_km),
dist AS (SELECT soil, point, label, min({KM_SQL}) AS km FROM px_points p, z GROUP BY ALL),
rate AS (
  SELECT soil, buffer_km, avg(CASE WHEN km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS t, avg(CASE WHEN km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS f
  FROM dist, b GROUP BY ALL),
e AS (SELECT soil, f AS x, t AS y, buffer_km AS o FROM rate UNION ALL SELECT soil, 0.0, 0.0, -1.0 FROM r UNION ALL SELECT soil, 1.0, 1.0, 1e9 FROM r),
l AS (SELECT soil, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM e WINDOW w AS (PARTITION BY soil ORDER BY x, o)),
auc AS (SELECT soil, sum(a) AS auc FROM l GROUP BY soil)
SELECT s.soil, coalesce(r.n_zones, 0) AS n_zones, coalesce(r.n_cells, 0) AS n_cells, round(auc, 6) AS auc,
       coalesce(r.n_zones, 0) - coalesce(base.n_zones, 0) AS more_zones, coalesce(r.n_cells, 0) - coalesce(base.n_cells, 0) AS more_cells
FROM soils s LEFT JOIN r ON r.soil = s.soil LEFT JOIN auc ON auc.soil = s.soil LEFT JOIN (SELECT n_zones, n_cells FROM r WHERE soil = 'baseline') base ON true""",
)
def soils_scored(spark, sf_dir: str) -> DataFrame:
    """Zones of fourteen soils at the operational saturation, with the corners, scored by distance to the inventory and against the baseline."""
    px = px_pixels(spark, sf_dir).filter(P.creeping(F.col("velocity")))
    ends = F.array(*(
        F.struct(P.factor_of_safety(F.col("slope_deg"), s.cohesion_dry, 0.0, s).alias("dry"), P.factor_of_safety(F.col("slope_deg"), s.cohesion_wet, 1.0, s).alias("wet"))
        for s in _SOIL.values()
    ))
    each = px.select("stack", "row", "col", ends.alias("ends"))
    end = lambda k, which: F.get("ends", F.lit(k))[which]
    weak = [(end(k, "wet") < end(k, "dry")) & (P.safety_at(F.lit(SOIL_M), end(k, "dry"), end(k, "wet")) < 1.0) for k in range(len(_SOIL))]
    z = raster.zones_of_masks(each, ["stack"], weak)
    soil = F.get(F.array(*map(F.lit, _SOIL)), F.col("mask")).alias("soil")
    z = stored(z.select(soil, F.struct("stack", "zone").alias("zone"), "n", DEGREE.x(F.col("col")).alias("lon"), DEGREE.y(F.col("row")).alias("lat")), "soil-zones")
    n = spark.createDataFrame([(s,) for s in SOILS], "soil string").join(z.groupBy("soil").agg(F.count("*").alias("n_zones"), F.sum("n").alias("n_cells")), "soil", "left").fillna(0)
    near = validation.nearest_zone(px_points(spark, sf_dir), z, ["soil"], "point", "zone").filter("nearest_km is not null")
    rows = stored(validation.distance_roc(near, ["soil"], BUFFERS, digits=None), "soil-rates")
    base = n.filter("soil = 'baseline'").first()
    more = {f"more_{c}": F.col(f"n_{c}") - F.lit(base[f"n_{c}"]) for c in ("zones", "cells")}
    return n.join(validation.roc_area(rows, ["soil"]), "soil", "left").withColumns(more).withColumns(r6("auc"))
