"""Whole analyses of a site: scored sweeps, back-tests, exposure, runout, flags, the live cycle and the status board."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import physics as P
from talus.operators import exposure, raster, tables, validation, zones
from talus.operators import rain as O
from talus.plans.pixels import _RUNOUT, _W, _ZONES, SOIL, W, runout, zone_pixels
from talus.plans.places import _DENSE, _KM, BUFFERS, KM_SQL, _read, _route
from talus.plans.rain import _BURST, _CALENDAR, _EVENTS, A, B, BY, big_orders, calendar
from talus.plans.regions import DEGREE, NULL_SQL, null_sample
from talus.plans.registry import query, r6
from talus.sources.proxies import PX_DAILY, PX_PIXELS, PX_POINTS, PX_ZONES, SITES, px_burst, px_daily, px_pixels, px_points, px_zones
from talus.sources.storage import stored

CELL_KM2 = 0.0064

# -- soils ----------------------------------------------------------------------------------------

#: Soils of the sweep: name, friction angle (degrees), cohesion when wet (kPa), depth (m), unit weight (kN/m3).
SOILS = [("baseline", SOIL.phi, SOIL.cohesion_wet, SOIL.depth, SOIL.gamma)]
SOILS += [(f"phi{p:g}", p, SOIL.cohesion_wet, SOIL.depth, SOIL.gamma) for p in (28.0, 32.0, 34.0, 38.0, 40.0)]
SOILS += [(f"cohesion{c:g}", SOIL.phi, c, SOIL.depth, SOIL.gamma) for c in (2.0, 8.0, 12.0)]
SOILS += [(f"depth{d:g}", SOIL.phi, SOIL.cohesion_wet, d, SOIL.gamma) for d in (1.5, 2.0, 5.0)]
SOILS += [(f"gamma{g:g}", SOIL.phi, SOIL.cohesion_wet, SOIL.depth, g) for g in (17.0, 21.0)]
_SOILS = "soils(soil, phi, c, depth, gamma) AS (VALUES " + ", ".join(f"('{n}', {p}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {g}::DOUBLE)" for n, p, c, d, g in SOILS) + ")"


@query(
    "m05_soil_combinations",
    f"""{W}, {_SOILS},
fs AS (
  SELECT soil, stack, velocity < -15 AS creeps, CASE WHEN slope_deg < 2.0 THEN 5.0 WHEN gamma * depth * sin(radians(slope_deg)) * cos(radians(slope_deg)) > 1e-6 THEN
    least(greatest((c + (gamma - 9.81::DOUBLE) * depth * cos(radians(slope_deg)) * cos(radians(slope_deg)) * tan(radians(phi))) / (gamma * depth * sin(radians(slope_deg)) * cos(radians(slope_deg))), 0.0), 5.0) END < 1.0 AS fails
  FROM px_pixels, soils),
n AS (
  SELECT stack, soil, count(*) FILTER (fails) AS n_unstable, count(*) FILTER (fails AND creeps) AS n_both, count(*) FILTER (fails OR creeps) AS n_any FROM fs GROUP BY ALL)
SELECT n.stack, n.soil, n.n_unstable, round(n.n_both::DOUBLE / nullif(n.n_any, 0), 6) AS iou, n.n_unstable - b.n_unstable AS more_than_baseline,
       round(n.n_both::DOUBLE / nullif(n.n_any, 0) - b.n_both::DOUBLE / nullif(b.n_any, 0), 6) AS iou_gain
FROM n JOIN n b ON b.stack = n.stack AND b.soil = 'baseline'""",
)
def soil_combinations(spark, sf_dir: str) -> DataFrame:
    """Fourteen soils crossed with the pixels in one pass, scored by overlap with creep and against the baseline.

    The baseline goes through the same operator; it must give what the site's own soil gives (the gate).
    """
    px = px_pixels(spark, sf_dir)
    fails = F.when(F.lit(False), F.lit(False))
    for name, phi, c, depth, gamma in SOILS:
        soil = P.Soil(SOIL.cohesion_dry, c, phi, gamma, depth)
        fails = fails.when(F.col("soil") == name, P.factor_of_safety(F.col("slope_deg"), c, 1.0, soil) < 1.0)
    each = px.select("stack", "slope_deg", "velocity", F.explode(F.array(*(F.lit(s[0]) for s in SOILS))).alias("soil"))
    each = each.withColumns({"fails": F.coalesce(fails, F.lit(False)), "creeps": P.creeping(F.col("velocity"))})
    n = stored(each.groupBy("stack", "soil").agg(F.count_if("fails").alias("n_unstable"), F.count_if(F.col("fails") & F.col("creeps")).alias("n_both"), F.count_if(F.col("fails") | F.col("creeps")).alias("n_any")), "soils")
    own = px.groupBy("stack").agg(F.count_if(P.factor_of_safety(F.col("slope_deg"), SOIL.cohesion_wet, 1.0, SOIL) < 1.0).alias("own"))
    if not n.filter("soil = 'baseline'").join(own, "stack").filter("own <> n_unstable").isEmpty():
        raise ValueError("the sweep's baseline does not give the site's own zones")
    base = n.filter("soil = 'baseline'").select("stack", F.col("n_unstable").alias("b"), F.try_divide("n_both", "n_any").alias("b_iou"))
    iou = F.try_divide(F.col("n_both"), F.col("n_any"))
    return n.join(base, "stack").select("stack", "soil", "n_unstable", F.round(iou, 6).alias("iou"), (F.col("n_unstable") - F.col("b")).alias("more_than_baseline"), F.round(iou - F.col("b_iou"), 6).alias("iou_gain"))


# -- scored sweeps and back-tests --------------------------------------------------------------------

KAPPAS, WETNESS = [0.0, 0.03, 0.06, 0.1], [0.25, 0.5, 0.75, 1.0]


#: Level above which a cell is unstable: its critical saturation, less what its wetness adds to the mean; always below 0, never from 1 on.
_LEVEL = """CASE WHEN fs_sat < fs_dry AND velocity < -15.0 AND (fs_dry - 1.0) / (fs_dry - fs_sat) < 1.0
  THEN CASE WHEN fs_dry < 1.0 THEN -1.0 ELSE (fs_dry - 1.0) / (fs_dry - fs_sat) - kappa * (twi - twi_mean) END END"""


@query(
    "m04_kappa_sweep",
    f"""WITH RECURSIVE {PX_PIXELS}, {PX_POINTS}, ks AS (SELECT unnest({KAPPAS})::DOUBLE AS kappa), ms AS (SELECT unnest({WETNESS})::DOUBLE AS m),
wet AS (
  SELECT kappa, m, stack, row, col, row::BIGINT * 1000000000 + col AS k, velocity, fs_dry, fs_sat, least(greatest(m + kappa * (twi - avg(twi) OVER (PARTITION BY stack, kappa, m)), 0.0), 1.0) AS w
  FROM px_pixels, ks, ms),
t0 AS (SELECT * FROM wet WHERE (1.0 - w) * fs_dry + w * fs_sat < 1.0 AND fs_sat < fs_dry AND velocity < -15.0),
te AS (SELECT a.kappa, a.m, a.stack, a.k AS a, b.k AS b FROM t0 a JOIN t0 b ON a.kappa = b.kappa AND a.m = b.m AND a.stack = b.stack AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
tr(kappa, m, stack, a, b) AS (
  SELECT kappa, m, stack, k, k FROM t0 UNION SELECT r.kappa, r.m, r.stack, r.a, e.b FROM tr r JOIN te e ON e.kappa = r.kappa AND e.m = r.m AND e.stack = r.stack AND e.a = r.b),
tl AS (SELECT kappa, m, stack, a AS k, min(b) AS zone FROM tr GROUP BY ALL),
z AS (
  SELECT kappa, m, stack, zone, count(*) AS n, 75.0::DOUBLE + (avg(col) + 0.5::DOUBLE) * 0.02::DOUBLE AS lon, 34.0::DOUBLE + (avg(row) + 0.5::DOUBLE) * (-1.0::DOUBLE / 60.0::DOUBLE) AS lat
  FROM t0 JOIN tl USING (kappa, m, stack, k) GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT kappa, m, count(*) AS n_zones, sum(n)::BIGINT AS n_cells, max(n) AS largest FROM z GROUP BY ALL), b AS (SELECT unnest({BUFFERS})::DOUBLE AS buffer_km),
dist AS (SELECT kappa, m, point, label, min({KM_SQL}) AS km FROM px_points p, z GROUP BY ALL),
rate AS (
  SELECT kappa, m, buffer_km, avg(CASE WHEN km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS t, avg(CASE WHEN km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS f
  FROM dist, b GROUP BY ALL),
e AS (SELECT kappa, m, f AS x, t AS y, buffer_km AS o FROM rate UNION ALL SELECT kappa, m, 0.0, 0.0, -1.0 FROM r UNION ALL SELECT kappa, m, 1.0, 1.0, 1e9 FROM r),
l AS (SELECT kappa, m, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM e WINDOW w AS (PARTITION BY kappa, m ORDER BY x, o)),
auc AS (SELECT kappa, m, sum(a) AS auc FROM l GROUP BY ALL)
SELECT auc.kappa, auc.m, n_zones, n_cells, largest, round(auc, 6) AS auc FROM auc JOIN r ON r.kappa = auc.kappa AND r.m = auc.m""",
)
def kappa_sweep(spark, sf_dir: str) -> DataFrame:
    """Zones redrawn from the pixels at each redistribution and wetness, labelled all at once by tiles, and scored by one protocol."""
    px = px_pixels(spark, sf_dir).select("stack", "row", "col", "velocity", "fs_dry", "fs_sat", "twi")
    px = stored(px, "kappa-pixels")  # their means are needed before their levels
    px = px.join(px.groupBy("stack").agg(F.avg("twi").alias("twi_mean")), "stack")
    each = [(kappa, m) for kappa in KAPPAS for m in WETNESS]
    levels = {kappa: F.expr(_LEVEL.replace("kappa", f"{kappa!r}D")) for kappa in KAPPAS}
    z = raster.zones_of_masks(px, ["stack"], [levels[kappa] < m for kappa, m in each])
    at = lambda k: F.get(F.array(*(F.lit(x[k]) for x in each)), F.col("mask"))
    z = z.select(at(0).alias("kappa"), at(1).alias("m"), F.struct("stack", "zone").alias("zone"), "n", DEGREE.x(F.col("col")).alias("lon"), DEGREE.y(F.col("row")).alias("lat"))
    z = stored(z, "kappa-zones")
    n = z.groupBy("kappa", "m").agg(F.count("*").alias("n_zones"), F.sum("n").alias("n_cells"), F.max("n").alias("largest"))
    near = validation.nearest_zone(px_points(spark, sf_dir), z, ["kappa", "m"], "point", "zone").filter("nearest_km is not null")
    rows = validation.distance_roc(near, ["kappa", "m"], BUFFERS, digits=None)
    return validation.roc_area(stored(rows, "kappa-rates"), ["kappa", "m"]).join(n, ["kappa", "m"]).withColumns(r6("auc"))


@query(
    "m06_scored_backtest",
    f"""WITH {_CALENDAR}, {_EVENTS}, {_KM}, {NULL_SQL}, b AS (SELECT unnest({BUFFERS})::DOUBLE AS buffer_km),
near AS (SELECT e.site, e.event_date, min(abs(date_diff('day', c.date, e.event_date))) AS d FROM ev e LEFT JOIN calendar c ON c.site = e.site AND c.alarm_level = 'ALERT' GROUP BY 1, 2),
chance AS (
  SELECT x.site, x.date, min(abs(date_diff('day', c.date, x.date))) AS d FROM calendar x LEFT JOIN calendar c ON c.site = x.site AND c.alarm_level = 'ALERT' AND abs(date_diff('day', c.date, x.date)) <= 3 GROUP BY 1, 2),
t AS (SELECT site, count(*) AS n_events, avg(CASE WHEN d <= 3 THEN 1.0 ELSE 0.0 END) AS hit FROM near GROUP BY site),
k AS (SELECT site, avg(CASE WHEN d <= 3 THEN 1.0 ELSE 0.0 END) AS null_hit FROM chance GROUP BY site),
nd AS (SELECT p.k, min({KM_SQL}) AS km FROM nulls p, px_zones z GROUP BY p.k),
s AS (SELECT buffer_km, avg(CASE WHEN nearest_km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS tpr FROM dist, b GROUP BY 1),
f AS (SELECT buffer_km, avg(CASE WHEN km <= buffer_km THEN 1.0 ELSE 0.0 END) AS fpr FROM nd, b GROUP BY 1),
m AS (SELECT median(km) AS null_median FROM nd)
SELECT t.site, s.buffer_km, n_events, round(hit, 6) AS share_near_alert, round(null_hit, 6) AS share_of_all_days, round(hit / nullif(null_hit, 0), 6) AS temporal_lift,
       round(tpr, 6) AS tpr, round(fpr, 6) AS null_rate, round(tpr / nullif(fpr, 0), 6) AS spatial_lift, round(null_median, 6) AS null_median_km
FROM t JOIN k ON k.site = t.site, s JOIN f ON f.buffer_km = s.buffer_km, m""",
)
def scored_backtest(spark, sf_dir: str) -> DataFrame:
    """Events against alert days and against all days; inventory places against points drawn in the area, at every distance."""
    days = stored(calendar(spark, sf_dir).select("site", "date", "alarm_level"), "backtest-days")
    alert, near = F.col("alarm_level") == "ALERT", F.avg(F.when(F.col("delta_days") <= 3, 1.0).otherwise(0.0))
    t = O.nearest_alert(big_orders(spark, sf_dir), days, BY, alert).groupBy("site").agg(F.count("*").alias("n_events"), near.alias("hit"))
    k = O.nearest_alert(days.select("site", F.col("date").alias("event_date")), days, BY, alert).groupBy("site").agg(near.alias("null_hit"))
    places = px_points(spark, sf_dir).filter("label = 1").select(F.struct(F.lit("place").alias("kind"), F.col("point").alias("k")).alias("point"), "lon", "lat", F.lit(1).alias("label"))
    drawn = null_sample(spark).select(F.struct(F.lit("null").alias("kind"), "k").alias("point"), "lon", "lat", F.lit(0).alias("label"))
    d = stored(validation.nearest_zone(places.unionByName(drawn), px_zones(spark, sf_dir), [], "point", "zone"), "backtest-distances")
    rates = validation.distance_roc(d, [], BUFFERS, digits=None).select("buffer_km", "tpr", "fpr")
    middle = d.filter("label = 0").agg(F.median("nearest_km")).first()[0]
    both = t.join(k, "site").withColumn("buffer_km", F.explode(F.array(*map(F.lit, BUFFERS)))).join(rates, "buffer_km").withColumn("null_median", F.lit(middle))
    return both.select(
        "site", "buffer_km", "n_events", F.round("hit", 6).alias("share_near_alert"), F.round("null_hit", 6).alias("share_of_all_days"), F.round(F.try_divide("hit", "null_hit"), 6).alias("temporal_lift"),
        F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("null_rate"), F.round(F.try_divide("tpr", "fpr"), 6).alias("spatial_lift"), F.round("null_median", 6).alias("null_median_km"),
    )


# -- exposure and runout ------------------------------------------------------------------------------


@query(
    "m16_route_exposure",
    f"""WITH {_DENSE}, {PX_ZONES}, p AS (SELECT way, seq, 75.0::DOUBLE + x / 1000.0 AS lon, 33.0::DOUBLE + y / 1000.0 AS lat FROM smp),
d AS (
  SELECT way, seq, min({KM_SQL} - sqrt(area_km2 / {3.141592653589793!r}::DOUBLE)) FILTER (severity = 'CRITICAL') AS core, min({KM_SQL} - sqrt(area_km2 / {3.141592653589793!r}::DOUBLE)) AS any_zone
  FROM p, px_zones z GROUP BY way, seq),
c AS (SELECT way, seq, any_zone, CASE WHEN core <= 1.0 THEN 'CORE' WHEN any_zone <= 1.0 THEN 'WATCH' ELSE 'CLEAR' END AS cls FROM d),
f AS (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY way ORDER BY seq) = cls THEN 0 ELSE 1 END AS ch FROM c),
s AS (SELECT *, sum(ch) OVER (PARTITION BY way ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM f),
g AS (SELECT way, segment, cls, min(seq) AS start, count(*) AS n_samples, count(*) * 100.0::DOUBLE AS length_m, round(min(any_zone), 6) AS nearest_km FROM s WHERE cls <> 'CLEAR' GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY way ORDER BY cls, nearest_km, length_m DESC, start)::INT AS place FROM g""",
)
def route_exposure(spark, sf_dir: str) -> DataFrame:
    """Route samples by their distance to the edges of zones, as ranked stretches.

    A zone's edge is its middle less the radius of a disc of its area. Critical zones and all zones are searched in one run.
    """
    samples = exposure.densify(_route(spark, sf_dir), ["way"], "seq0", 100.0).withColumns({"lon": 75.0 + F.col("x") / 1000.0, "lat": 33.0 + F.col("y") / 1000.0})
    samples = stored(samples.select("way", "seq", "lon", "lat").withColumn("sample", F.struct("way", "seq")), "route-samples")
    z = px_zones(spark, sf_dir).withColumn("radius", F.sqrt(F.col("area_km2") / 3.141592653589793))
    scenario = lambda core: F.explode(F.array(*map(F.lit, ("core", "any_zone") if core else ("any_zone",))))
    both = z.filter("severity = 'CRITICAL'").withColumn("of", scenario(True)).unionByName(z.filter("severity <> 'CRITICAL'").withColumn("of", scenario(False)))
    edges = validation.nearest_edge(samples, both, ["of"], "sample", "radius")
    of = lambda name: F.min(F.when(F.col("of") == name, F.col("edge_km"))).alias(name)
    d = edges.groupBy("sample").agg(of("core"), of("any_zone")).select("sample.*", "core", "any_zone")
    d = d.withColumn("cls", exposure.exposure_class(F.col("core"), {"WATCH": F.col("any_zone")}, 1.0))
    out = exposure.segments(d, ["way"], "seq", "cls", 100.0, keep={"nearest_km": F.round(F.min("any_zone"), 6)})
    return tables.ranked(out, ["way"], [F.col("cls"), F.col("nearest_km"), F.desc("length_m"), F.col("start")])


@query(
    "m17_rockfall_screen",
    f"""{_RUNOUT}, houses AS (SELECT (c_custkey % 60)::INT AS row, (c_custkey * 7 % 50)::INT AS col, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT stack, band, count(*) AS n_cells, round(count(*) * 0.0064::DOUBLE, 6) AS area_km2, coalesce(sum(n), 0)::BIGINT AS n_buildings,
       round(max(angle_deg), 6) AS steepest_deg, count(DISTINCT r.row) * 80.0::DOUBLE AS length_m
FROM runout r LEFT JOIN houses h ON h.row = r.row AND h.col = r.col GROUP BY stack, band""",
)
def rockfall_screen(spark, sf_dir: str) -> DataFrame:
    """Cells, buildings and crossed lines in each band of the reach angle."""
    k = F.col("c_custkey")
    houses = _read(spark, sf_dir, "customer").groupBy((k % 60).cast("int").alias("row"), (k * 7 % 50).cast("int").alias("col")).agg(F.count("*").alias("n"))
    met = runout(spark, sf_dir).join(houses, ["row", "col"], "left")
    return met.groupBy("stack", "band").agg(
        F.count("*").alias("n_cells"), F.round(F.count("*") * CELL_KM2, 6).alias("area_km2"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_buildings"),
        F.round(F.max("angle_deg"), 6).alias("steepest_deg"), (F.count_distinct("row") * 80.0).alias("length_m"),
    )


_STEPS = " UNION ALL ".join(f"SELECT {i} AS i, {r} AS dr, {c} AS dc, {'1.0' if r == 0 or c == 0 else 'sqrt(2.0)'}::DOUBLE AS d" for i, (r, c) in enumerate(raster.EIGHT))
_NEAR = lambda of: f"EXISTS (SELECT 1 FROM {of} v WHERE v.stack = z.stack AND v.row BETWEEN r0 - 5 AND r1 + 5 AND v.col BETWEEN c0 - 5 AND c1 + 5)"


@query(
    "m27_flag_agreement",
    f"""{_W}, {_ZONES}, st AS ({_STEPS}),
dr AS MATERIALIZED (
  SELECT a.stack, a.row, a.col, b.row AS to_row, b.col AS to_col, row_number() OVER (PARTITION BY a.stack, a.row, a.col ORDER BY (a.dem - b.dem) / d DESC, i) AS k
  FROM px_pixels a, st JOIN px_pixels b ON b.stack = a.stack AND b.row = a.row + dr AND b.col = a.col + dc WHERE a.dem > b.dem),
rv AS MATERIALIZED (SELECT * FROM dr WHERE k = 1),
walk(stack, tr, tc) AS (SELECT stack, row, col FROM px_pixels UNION ALL SELECT w.stack, r.to_row, r.to_col FROM walk w JOIN rv r ON r.stack = w.stack AND r.row = w.tr AND r.col = w.tc),
flow AS (SELECT stack, tr AS row, tc AS col, count(*) AS accum FROM walk GROUP BY ALL),
cut AS (SELECT p.stack, quantile_cont(twi, 0.9) AS q, quantile_cont(accum, 0.9) AS qf FROM px_pixels p JOIN flow USING (stack, row, col) GROUP BY p.stack),
vt AS (SELECT p.stack, row, col FROM px_pixels p JOIN cut ON cut.stack = p.stack WHERE twi >= q),
vf AS (SELECT p.stack, row, col FROM flow p JOIN cut ON cut.stack = p.stack WHERE accum >= qf),
z AS (SELECT stack, zone, count(*) AS n_pixels, avg(slope_deg) AS slope, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM zpx SEMI JOIN big USING (stack, zone) GROUP BY 1, 2),
flags AS (SELECT stack, slope > 25 AND n_pixels > 4 AND {_NEAR("vt")} AS proxy, slope > 25 AND n_pixels > 4 AND {_NEAR("vf")} AS routed FROM z)
SELECT stack, count(*) AS n_zones, count(*) FILTER (proxy = routed) AS n_agree, count(*) FILTER (proxy AND NOT routed) AS proxy_only, count(*) FILTER (routed AND NOT proxy) AS routed_only FROM flags GROUP BY stack""",
)
def flag_agreement(spark, sf_dir: str) -> DataFrame:
    """Valley flags of zones by the wetness index against those by routed flow."""
    px = stored(px_pixels(spark, sf_dir).select("stack", "row", "col", "dem", "twi"), "flag-pixels")
    z = stored(zones.describe(zone_pixels(spark, sf_dir).withColumn("fs", F.col("fs_sat")), ["stack"], 80.0), "flag-zones")
    flow = raster.flow_accumulation(px, ["stack"], "dem").withColumn("accum", F.col("accum").cast("double"))
    proxy = zones.valley_flag(z, px, ["stack"]).select("stack", "zone", F.col("llof_potential").alias("proxy"))
    routed = zones.valley_flag(z, flow, ["stack"], twi="accum").select("stack", "zone", F.col("llof_potential").alias("routed"))
    p, r = F.col("proxy"), F.col("routed")
    return proxy.join(routed, ["stack", "zone"]).groupBy("stack").agg(F.count("*").alias("n_zones"), F.count_if(p == r).alias("n_agree"), F.count_if(p & ~r).alias("proxy_only"), F.count_if(r & ~p).alias("routed_only"))


# -- bursts, the live cycle and the board -----------------------------------------------------------------


@query(
    "m20_burst_calibration",
    f"""WITH {_BURST}, ends AS (SELECT DISTINCT site, date_trunc('day', ts) + INTERVAL 3 HOUR AS end_ts FROM px_burst),
gauge AS (SELECT e.site, sum(rate_mm_h * 0.5) AS mm FROM ends e JOIN px_burst b ON b.site = e.site AND b.ts > e.end_ts - INTERVAL 24 HOUR AND b.ts <= e.end_ts GROUP BY 1),
day AS (SELECT d.site, d.date, e AS max_e, total_mm FROM bd d JOIN bk k ON d.site = k.site AND d.date = k.date AND k.k = 1),
total AS (SELECT site, sum(total_mm) AS mm FROM day GROUP BY 1), ks AS (SELECT unnest([1.0, 2.0, 3.0, 5.0, 8.0])::DOUBLE AS k)
SELECT day.site, ks.k, count(*) FILTER (max_e >= ks.k) AS n_days, round(avg(CASE WHEN max_e >= ks.k THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_days,
       round(max(gauge.mm / total.mm), 6) AS gauge_ratio, count(*) FILTER (max_e >= ks.k AND total_mm >= 40.0) AS n_wet_days
FROM day JOIN gauge ON gauge.site = day.site JOIN total ON total.site = day.site, ks GROUP BY 1, 2""",
)
def burst_calibration(spark, sf_dir: str) -> DataFrame:
    """Burst days at each threshold, how many of them are wet days too, and the gauge day's total against the calendar day's."""
    steps = px_burst(spark, sf_dir)
    days = stored(O.bursts(steps, BY, A, B).select("site", "date", "max_e", "total_mm"), "burst-days")
    ends = steps.select("site", F.expr("date_trunc('day', ts) + interval 3 hours").alias("end_ts")).distinct()
    gauge = O.window_totals(steps, ends, BY, 24.0).groupBy("site").agg(F.sum("total_mm").alias("gauge_mm"))
    ratio = days.groupBy("site").agg(F.sum("total_mm").alias("mm")).join(gauge, "site").select("site", F.round(F.col("gauge_mm") / F.col("mm"), 6).alias("gauge_ratio"))
    ks = [1.0, 2.0, 3.0, 5.0, 8.0]
    swept = O.threshold_sweep(days, BY, ks, "max_e").withColumns(r6("pct_days"))
    wet = O.threshold_sweep(days.withColumn("max_e", F.when(F.col("total_mm") >= 40.0, F.col("max_e"))), BY, ks, "max_e").select("site", "k", F.col("n_days").alias("n_wet_days"))
    return swept.join(wet, ["site", "k"]).join(ratio, "site")


_API = "water_mm" + "".join(f" + coalesce(lag(water_mm, {j}) OVER s, 0.0) * {0.9**j!r}::DOUBLE" for j in range(1, 15))
_CYCLE = f"""{_CALENDAR}, {PX_ZONES}, api AS (SELECT *, {_API} AS api_mm FROM w WINDOW s AS (PARTITION BY site ORDER BY date)),
p AS (SELECT site, quantile_cont(api_mm, 0.95) AS p95 FROM api GROUP BY site),
wet AS (SELECT api.site, date, least(greatest(api_mm / p95, 0.0), 1.0) AS m FROM api JOIN p ON api.site = p.site),
eff AS (SELECT site, zone, least(greatest(m_star - 0.06::DOUBLE * (twi - avg(twi) OVER (PARTITION BY site)), 0.0), 1.0) AS m_eff FROM px_zones),
act AS (SELECT wet.site, wet.date, m, count(zone) AS n FROM wet LEFT JOIN eff ON eff.site = wet.site AND eff.m_eff <= wet.m GROUP BY ALL),
cycle AS (
  SELECT c.site, c.date, exceedance, m, alarm_level, CASE WHEN alarm_level = 'DORMANT' THEN 0 ELSE n END AS n_active, lag(alarm_level) OVER (PARTITION BY c.site ORDER BY c.date) AS previous
  FROM calendar c JOIN act ON act.site = c.site AND act.date = c.date)"""


def cycle(spark, sf_dir: str) -> DataFrame:
    """Each day's level, wetness, active zones and previous level."""
    daily = px_daily(spark, sf_dir)
    m = O.wetness(daily, BY).select("site", "date", F.col("wetness_0_1").alias("m"))
    z = px_zones(spark, sf_dir)
    eff = z.join(z.groupBy("site").agg(F.avg("twi").alias("twi_mean")), "site")
    eff = eff.select("site", P.effective_critical_saturation(F.col("m_star"), F.col("twi"), F.col("twi_mean"), 0.06).alias("m"))
    days = zones.counts_up_to(eff, calendar(spark, sf_dir).join(m, ["site", "date"]), BY, "m", "n_active")
    armed = F.when(F.col("alarm_level") == "DORMANT", 0).otherwise(F.col("n_active")).cast("long")
    return days.withColumns({"n_active": armed, "previous": F.lag("alarm_level").over(Window.partitionBy("site").orderBy("date"))})


@query(
    "m31_live_cycle",
    f"""WITH {_CYCLE} SELECT site, date, round(exceedance, 6) AS exceedance, round(m, 6) AS wetness, alarm_level, previous, n_active::BIGINT AS n_active
FROM cycle WHERE previous IS NULL OR alarm_level <> previous OR alarm_level = 'ALERT'""",
)
def live_cycle(spark, sf_dir: str) -> DataFrame:
    """Rain to wetness to the gate of zones to the alarm: the days that notify, with the zones they activate."""
    told = cycle(spark, sf_dir).filter(F.col("previous").isNull() | (F.col("alarm_level") != F.col("previous")) | (F.col("alarm_level") == "ALERT"))
    return told.select("site", "date", F.round("exceedance", 6).alias("exceedance"), F.round("m", 6).alias("wetness"), "alarm_level", "previous", "n_active")


#: Stages in order: name, and the SQL that tells which sites have it done.
STAGES = (
    ("polygon", "SELECT DISTINCT site FROM px_zones"),
    ("soil", "SELECT site FROM px_zones GROUP BY site HAVING count(mean_fs) >= 3"),
    ("radar", "SELECT site FROM px_zones GROUP BY site HAVING count(DISTINCT stack) >= 2"),
    ("dem", "SELECT site FROM px_zones GROUP BY site HAVING max(twi) > 8.0"),
    ("hazard", "SELECT site FROM px_zones GROUP BY site HAVING bool_or(severity = 'CRITICAL')"),
    ("inventory", "SELECT site FROM big GROUP BY site HAVING count(*) >= 100"),
    ("validation", "SELECT site FROM ev GROUP BY site HAVING count(*) >= 20"),
    ("tuned", "SELECT site FROM calendar GROUP BY site HAVING count(*) FILTER (alarm_level = 'ALERT') >= 5"),
    ("baseline", "SELECT site FROM px_daily GROUP BY site HAVING count(rain_mm) >= 365"),
    ("live", "SELECT site FROM calendar, (SELECT max(date) AS today FROM calendar) GROUP BY site HAVING date_diff('day', max(date), max(today)) <= 7"),
)


@query(
    "m30_stage_board",
    f"""WITH {_CALENDAR}, {PX_ZONES}, {_EVENTS}, sites AS (SELECT unnest({list(SITES)}) AS site),
done AS ({" UNION ALL ".join(f"SELECT site, {i} AS k FROM ({sql})" for i, (_, sql) in enumerate(STAGES))}),
flags AS (SELECT s.site, list_sort(list(k) FILTER (k IS NOT NULL)) AS ks FROM sites s LEFT JOIN done ON done.site = s.site GROUP BY s.site)
SELECT site, len(ks)::INT AS n_done, {[name for name, _ in STAGES] + ["routine"]}[coalesce(list_min(list_filter(range({len(STAGES)}), lambda i: NOT list_contains(ks, i))), {len(STAGES)}) + 1] AS next_step FROM flags""",
)
def stage_board(spark, sf_dir: str) -> DataFrame:
    """Ten ordered stages of each site; the first that is not done is the next step."""
    z, days = px_zones(spark, sf_dir), stored(calendar(spark, sf_dir).select("site", "date", "alarm_level"), "board-days")
    each = z.groupBy("site").agg(F.count("mean_fs").alias("n"), F.count_distinct("stack").alias("looks"), F.max("twi").alias("twi"), F.bool_or(F.col("severity") == "CRITICAL").alias("critical"))
    orders = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("site")).agg(F.count("*").alias("n_orders"))
    events = big_orders(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n_events"))
    alerts = days.groupBy("site").agg(F.count_if(F.col("alarm_level") == "ALERT").alias("n_alert"), F.max("date").alias("last"))
    rain = px_daily(spark, sf_dir).groupBy("site").agg(F.count("rain_mm").alias("n_rain"))
    today = days.agg(F.max("date")).first()[0]
    sites = spark.createDataFrame([(s,) for s in SITES], "site string")
    board = reduce(lambda a, b: a.join(b, "site", "left"), [each, orders, events, alerts, rain], sites)
    done = [
        F.col("n").isNotNull(), F.col("n") >= 3, F.col("looks") >= 2, F.col("twi") > 8.0, F.col("critical"), F.col("n_orders") >= 100, F.col("n_events") >= 20,
        F.col("n_alert") >= 5, F.col("n_rain") >= 365, F.datediff(F.lit(today), "last") <= 7,
    ]
    flags = F.array(*(F.coalesce(c, F.lit(False)) for c in done))
    first = F.array_position(flags, F.lit(False))
    names = F.array(*(F.lit(name) for name, _ in STAGES), F.lit("routine"))
    return board.select("site", F.size(F.filter(flags, lambda x: x)).alias("n_done"), F.element_at(names, F.when(first == 0, len(STAGES) + 1).otherwise(first).cast("int")).alias("next_step"))
