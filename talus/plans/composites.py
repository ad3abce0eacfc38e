"""Named analytics made of several operators, and the remaining small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import geo
from talus.functions import physics as P
from talus.functions import rain as R
from talus.functions.stats import normal_cdf, normal_cdf_sql
from talus.operators import crosscheck, network, raster, tables, validation, zones
from talus.operators import rain as O
from talus.plans.pixels import _W, _ZONES, W, zone_pixels
from talus.plans.places import _KM, BUFFERS, GREEDY_SQL, KM_SQL, _distances, _read
from talus.plans.rain import _CALENDAR, _WATER, BY, calendar
from talus.plans.registry import query, r6
from talus.sources.files import json_payload
from talus.sources.storage import stored
from talus.sources.proxies import PX_DAILY, PX_PAIRS, PX_PIXELS, PX_POINTS, PX_ZONES, px_daily, px_pairs, px_pixels, px_points, px_zones

#: Saturations at which alerts are drawn.
SCENARIOS = {"dry": 0.0, "operational": 0.5, "watch": 0.7, "monsoon": 1.0}


# -- scans and projections ------------------------------------------------------------------------


@query("s04_series_vectors", "SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids, count(*) AS n FROM events GROUP BY 1")
def vectors(spark, sf_dir: str) -> DataFrame:
    """Each series as one ordered vector."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("r"), F.count("*").alias("n")).select("user_id", F.array_join(F.transform("r", lambda x: x["event_id"].cast("string")), ",").alias("ids"), "n")


@query(
    "s19_cell_means",
    f"""WITH {PX_POINTS}
SELECT floor((lon - 75.0) * 10.0)::BIGINT AS cx, floor((lat - 33.0) * 10.0)::BIGINT AS cy, count(*) AS n_points,
       round(sum(CAST(round(score * 100) AS BIGINT)) / 100.0::DOUBLE / count(*), 6) AS mean
FROM px_points GROUP BY 1, 2""",
)
def cell_means(spark, sf_dir: str) -> DataFrame:
    """Places to rain cells of 0.1 degrees, and the mean of each cell."""
    cx, cy = F.floor((F.col("lon") - 75.0) * 10.0), F.floor((F.col("lat") - 33.0) * 10.0)
    cents = F.sum(F.round(F.col("score") * 100).cast("long"))
    cells = px_points(spark, sf_dir).groupBy(cx.alias("cx"), cy.alias("cy"))
    return cells.agg(F.count("*").alias("n_points"), F.round(cents / 100.0 / F.count("*"), 6).alias("mean"))


@query("s33_calendar_spine", f"WITH {PX_DAILY} SELECT site, count(*) AS n_days, count(rain_mm) AS n_known, min(date) AS first, max(date) AS last FROM px_daily GROUP BY 1")
def calendar_spine(spark, sf_dir: str) -> DataFrame:
    """Every day of a site, and how many of them have rain."""
    wet = px_daily(spark, sf_dir).filter("rain_mm is not null").select("site", "date", "rain_mm")
    days = O.spine(wet, BY, "date").join(wet, ["site", "date"], "left")
    return days.groupBy("site").agg(F.count("*").alias("n_days"), F.count("rain_mm").alias("n_known"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "p21_threshold_curve",
    f"""WITH {PX_DAILY},
wet AS (SELECT site, rain_mm, date_diff('day', DATE '1970-01-01', date) - row_number() OVER (PARTITION BY site ORDER BY date) AS spell FROM px_daily WHERE rain_mm >= 6.0),
spells AS (SELECT site, spell, count(*) AS days, sum(rain_mm) AS mm FROM wet GROUP BY 1, 2),
curve AS (SELECT days, mm, {R.THRESHOLDS['caine1980'][0]} * pow(days * 24.0::DOUBLE, -{R.THRESHOLDS['caine1980'][1]}::DOUBLE) AS intensity FROM spells)
SELECT days, round(intensity, 6) AS intensity, round(intensity * days * 24.0, 6) AS depth, count(*) AS n, count(*) FILTER (mm > intensity * days * 24.0) AS n_above
FROM curve GROUP BY 1, 2, 3""",
)
def curve(spark, sf_dir: str) -> DataFrame:
    """Threshold intensity and depth at the lengths of the sites' spells of wet days, and how many spells exceed it."""
    a, b = R.THRESHOLDS["caine1980"]
    place = F.row_number().over(Window.partitionBy("site").orderBy("date"))
    wet = px_daily(spark, sf_dir).filter("rain_mm >= 6.0").select("site", "rain_mm", (F.unix_date("date") - place).alias("spell"))
    spells = wet.groupBy("site", "spell").agg(F.count("*").alias("days"), F.sum("rain_mm").alias("mm"))
    d = F.col("days").cast("double")
    intensity, depth = R.threshold_intensity(d * 24.0, a, b), R.threshold_depth(d, a, b)
    counted = spells.groupBy("days").agg(F.count("*").alias("n"), F.count_if(F.col("mm") > depth).alias("n_above"))
    return counted.select("days", F.round(intensity, 6).alias("intensity"), F.round(depth, 6).alias("depth"), "n", "n_above")


@query("p25_pixel_world", f"{W} SELECT stack, row, col, round((500000.0 + (col + 0.5) * 80.0)::DOUBLE, 6) AS x, round((3650000.0 + (row + 0.5) * -80.0)::DOUBLE, 6) AS y, floor((500000.0 + (col + 0.5) * 80.0 - 500000.0) / 80.0)::INT AS col_back FROM px_pixels")
def pixel_world(spark, sf_dir: str) -> DataFrame:
    """P25: pixels to places and back."""
    x, y = geo.pixel_centre(F.col("col"), 500_000, 80.0), geo.pixel_centre(F.col("row"), 3_650_000, -80.0)
    return px_pixels(spark, sf_dir).select("stack", "row", "col", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), geo.pixel_of(x, 500_000, 80.0).alias("col_back"))


@query(
    "p25_lonlat",
    f"""{W},
k AS (SELECT 0.00669438::DOUBLE AS e, 6378137.0::DOUBLE AS a),
k2 AS (SELECT e, a, e / (1 - e) AS ep, (1 - sqrt(1 - e)) / (1 + sqrt(1 - e)) AS f, a * (1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) AS m FROM k),
u AS (SELECT stack, row, col, e, a, ep, f, (col + 0.5::DOUBLE) * 80.0::DOUBLE AS x, (3650000.0::DOUBLE - (row + 0.5::DOUBLE) * 80.0::DOUBLE) / 0.9996::DOUBLE / m AS mu FROM px_pixels, k2),
v AS (SELECT *, mu + (3 * f / 2 - 27 * pow(f, 3) / 32) * sin(2 * mu) + (21 * f * f / 16 - 55 * pow(f, 4) / 32) * sin(4 * mu) + 151 * pow(f, 3) / 96 * sin(6 * mu) + 1097 * pow(f, 4) / 512 * sin(8 * mu) AS p FROM u),
z AS (SELECT *, a / sqrt(1 - e * sin(p) * sin(p)) AS n, a * (1 - e) / pow(1 - e * sin(p) * sin(p), 1.5::DOUBLE) AS r, tan(p) * tan(p) AS t, ep * cos(p) * cos(p) AS c FROM v),
q AS (SELECT *, x / (n * 0.9996::DOUBLE) AS d FROM z)
SELECT stack, row, col,
       round(75.0::DOUBLE + degrees((d - pow(d, 3) / 6 * (1 + 2 * t + c) + pow(d, 5) / 120 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t)) / cos(p)), 7) AS lon,
       round(degrees(p - n * tan(p) / r * (d * d / 2 - pow(d, 4) / 24 * (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) + pow(d, 6) / 720 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c))), 7) AS lat
FROM q""",
)
def lonlat(spark, sf_dir: str) -> DataFrame:
    """P25: longitude and latitude of pixels, by a series for the transverse projection."""
    lon, lat = geo.utm_to_lonlat(geo.pixel_centre(F.col("col"), 500_000, 80.0), geo.pixel_centre(F.col("row"), 3_650_000, -80.0), 43)
    return px_pixels(spark, sf_dir).select("stack", "row", "col", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("p26_slant_delay", f"{W} SELECT stack, row, col, round((phase + 4.0) / 10.0 / sin(0.6 + twi / 100.0) * 1000.0, 6) AS delay_mm FROM px_pixels")
def slant(spark, sf_dir: str) -> DataFrame:
    """Delay along the line of sight."""
    return px_pixels(spark, sf_dir).select("stack", "row", "col", F.round(P.slant_delay_mm((F.col("phase") + 4.0) / 10.0, 0.6 + F.col("twi") / 100.0), 6).alias("delay_mm"))


@query("p30_safe_cast", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 1 THEN '' ELSE o_custkey::VARCHAR END AS DOUBLE) AS v FROM orders")
def safe_cast(spark, sf_dir: str) -> DataFrame:
    """Numbers where the text is one."""
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select("o_orderkey", geo.number(F.when(k % 3 == 0, "n/a").when(k % 3 == 1, "").otherwise(F.col("o_custkey").cast("string"))).alias("v"))


@query("p38_ndvi", f"{W} SELECT stack, round(median(CASE WHEN q NOT IN (3, 8, 9, 10, 11) THEN (slope_deg - twi) / (slope_deg + twi) END), 6) AS ndvi, count(*) FILTER (q NOT IN (3, 8, 9, 10, 11)) AS n_clear FROM (SELECT *, (row + col) % 12 AS q FROM px_pixels) GROUP BY stack")
def ndvi(spark, sf_dir: str) -> DataFrame:
    """Median vegetation index of clear pixels."""
    clear = P.clear_pixel((F.col("row") + F.col("col")) % 12)
    return px_pixels(spark, sf_dir).groupBy("stack").agg(F.round(F.median(F.when(clear, P.ndvi(F.col("slope_deg"), F.col("twi")))), 6).alias("ndvi"), F.count_if(clear).alias("n_clear"))


@query("a20_elevation_bands", f"{W}, b AS (SELECT unnest([1100.0, 1300.0, 1500.0])::DOUBLE AS band_m) SELECT stack, band_m, count(*) FILTER (abs(dem - band_m) <= 100.0) AS n, round(avg(CASE WHEN abs(dem - band_m) <= 100.0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct FROM px_pixels, b GROUP BY 1, 2")
def bands(spark, sf_dir: str) -> DataFrame:
    """Share of the area near some heights."""
    each = px_pixels(spark, sf_dir).withColumn("band_m", F.explode(F.array(*(F.lit(b) for b in (1100.0, 1300.0, 1500.0)))))
    near = F.abs(F.col("dem") - F.col("band_m")) <= 100.0
    return each.groupBy("stack", "band_m").agg(F.count_if(near).alias("n"), F.round(F.avg(F.when(near, 1.0).otherwise(0.0)) * 100, 6).alias("pct"))


@query("f03_box_filter", "SELECT c_custkey FROM customer WHERE 75.0 + ((c_custkey * 7919) % 10007)::DOUBLE / 10007.0 BETWEEN 75.2 AND 75.6 AND 33.0 + ((c_custkey * 104729) % 10009)::DOUBLE / 10009.0 BETWEEN 33.3 AND 33.9")
def box(spark, sf_dir: str) -> DataFrame:
    """places within a box."""
    return px_points(spark, sf_dir).filter("lon between 75.2 and 75.6 and lat between 33.3 and 33.9").select(F.col("point").alias("c_custkey"))


@query("f07_min_looks", "WITH s AS (SELECT s_suppkey AS zone, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 4 END AS n_looks FROM supplier) SELECT zone, coalesce(n_looks, 1)::BIGINT AS n_looks FROM s WHERE coalesce(n_looks, 1) >= 2")
def looks(spark, sf_dir: str) -> DataFrame:
    """zones of two looks or more; an unknown number is one."""
    k = F.col("s_suppkey")
    z = _read(spark, sf_dir, "supplier").select(k.alias("zone"), F.coalesce(F.when(k % 4 != 0, k % 4), F.lit(1)).cast("long").alias("n_looks"))
    return z.filter("n_looks >= 2")


# -- joins ------------------------------------------------------------------------------------------


@query("j03_layer_join", f"{W}, h AS (SELECT stack, row, col, coh FROM px_pixels WHERE coh IS NOT NULL) SELECT p.stack, count(*) AS n, round(avg(p.dem), 6) AS dem, round(avg(h.coh), 6) AS coh FROM px_pixels p JOIN h ON h.stack = p.stack AND h.row = p.row AND h.col = p.col GROUP BY 1")
def layers(spark, sf_dir: str) -> DataFrame:
    """Two layers on one grid, where both are known."""
    px = px_pixels(spark, sf_dir)
    h = px.filter("coh is not null").select("stack", "row", "col", "coh")
    return px.drop("coh").join(h, ["stack", "row", "col"]).groupBy("stack").agg(F.count("*").alias("n"), F.round(F.avg("dem"), 6).alias("dem"), F.round(F.avg("coh"), 6).alias("coh"))


@query(
    "j12_sample_points",
    f"""{W}, pt AS (SELECT c_custkey AS point, (c_custkey % 60)::INT AS row, (c_custkey * 7 % 50)::INT AS col FROM customer),
m AS (
  SELECT point, p.stack, fs_sat, row_number() OVER (PARTITION BY point ORDER BY p.stack) AS k
  FROM pt JOIN px_pixels p ON p.row = pt.row AND p.col = pt.col WHERE fs_sat IS NOT NULL) SELECT point, stack, round(fs_sat, 6) AS fs_sat FROM m WHERE k = 1""",
)
def sampled(spark, sf_dir: str) -> DataFrame:
    """Each place's value from the first stack that has one."""
    k = F.col("c_custkey")
    pts = _read(spark, sf_dir, "customer").select(k.alias("point"), (k % 60).cast("int").alias("row"), (k * 7 % 50).cast("int").alias("col"))
    return raster.sample_points(pts, px_pixels(spark, sf_dir), ["stack"], "fs_sat", "point", "stack").withColumns(r6("fs_sat"))


@query(
    "j19_baseline_difference",
    f"WITH {PX_PAIRS}, sc AS (SELECT DISTINCT stack, ref AS scene FROM px_pairs), b AS (SELECT stack, scene, ((stack * 31 + scene * 17) % 400)::DOUBLE AS bperp FROM sc WHERE (stack * 31 + scene * 17) % 400 >= 80) SELECT p.stack, product, abs(y.bperp - x.bperp) AS bperp FROM px_pairs p LEFT JOIN b x ON x.stack = p.stack AND x.scene = p.ref LEFT JOIN b y ON y.stack = p.stack AND y.scene = p.sec",
)
def baselines(spark, sf_dir: str) -> DataFrame:
    """Baseline between a pair's ends."""
    p = px_pairs(spark, sf_dir).drop("bperp")
    scenes = p.select("stack", F.col("ref").alias("scene")).distinct().withColumn("bperp", ((F.col("stack") * 31 + F.col("scene") * 17) % 400).cast("double")).filter("bperp >= 80")
    return network.baseline_difference(p, scenes, ["stack"]).select("stack", "product", "bperp")


@query(
    "j16_zone_pixels",
    f"""{_W}, {_ZONES}, z AS (SELECT stack, zone, avg(row) AS r, avg(col) AS c FROM zpx SEMI JOIN big USING (stack, zone) GROUP BY 1, 2)
SELECT z.stack, z.zone, round(p.fs_dry, 6) AS fs_dry, round(p.twi, 6) AS twi FROM z LEFT JOIN px_pixels p ON p.stack = z.stack AND p.row = round_even(r, 0)::INT AND p.col = round_even(c, 0)::INT""",
)
def middle_pixels(spark, sf_dir: str) -> DataFrame:
    """Each zone with the layers at its middle."""
    z = zone_pixels(spark, sf_dir).groupBy("stack", "zone").agg(F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"))
    return zones.zone_pixels(z, px_pixels(spark, sf_dir), ["stack"], ["fs_dry", "twi"]).select("stack", "zone", F.round("fs_dry", 6).alias("fs_dry"), F.round("twi", 6).alias("twi"))


# -- composites ---------------------------------------------------------------------------------------


@query(
    "m03_scenario_union",
    f"""{_W}, sc AS (SELECT unnest({list(SCENARIOS)}) AS scenario, unnest({list(SCENARIOS.values())})::DOUBLE AS m),
t0 AS (
  SELECT scenario, stack, row, col, row::BIGINT * 1000000000 + col AS k, velocity, (1.0 - m) * fs_dry + m * fs_sat AS fs, slope_deg
  FROM px_pixels, sc WHERE (1.0 - m) * fs_dry + m * fs_sat < 1.0 AND velocity < -15.0),
te AS (SELECT a.scenario, a.stack, a.k AS a, b.k AS b FROM t0 a JOIN t0 b ON a.scenario = b.scenario AND a.stack = b.stack AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
tr(scenario, stack, a, b) AS (
  SELECT scenario, stack, k, k FROM t0 UNION SELECT r.scenario, r.stack, r.a, e.b FROM tr r JOIN te e ON e.scenario = r.scenario AND e.stack = r.stack AND e.a = r.b),
tl AS (SELECT scenario, stack, a AS k, min(b) AS zone FROM tr GROUP BY ALL),
tz AS (
  SELECT scenario, stack, zone, count(*) AS n, avg(row) AS r, avg(col) AS c, avg(velocity) AS v, avg(fs) AS fs FROM t0 JOIN tl USING (scenario, stack, k) GROUP BY ALL HAVING count(*) >= 3),
mo AS (
  SELECT scenario AS place, stack, zone, 75.0 + c * 0.0009 AS lon, 33.0 - r * 0.0007 AS lat, CASE WHEN v <= -50 OR fs <= 0.7 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, fs, v, n * 0.0064::DOUBLE AS area,
         row_number() OVER (PARTITION BY scenario ORDER BY stack, zone) AS k FROM tz), {GREEDY_SQL.format(deg=0.0015)}
SELECT place AS scenario, round(avg(lon), 9) AS lon, round(avg(lat), 9) AS lat, array_to_string(list_sort(list(DISTINCT stack)), ',') AS looks, count(DISTINCT stack) AS n_looks,
       CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'HIGH' END AS severity, round(min(fs), 6) AS min_fs, round(min(v), 6) AS strongest_creep, round(max(area), 6) AS max_area_km2, false AS llof
FROM taken GROUP BY place, seed""",
)
def scenario_union(spark, sf_dir: str) -> DataFrame:
    """Zones of each scenario and stack, merged over stacks where their middles are near."""
    px = px_pixels(spark, sf_dir)
    each = px.withColumn("s", F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(m).alias("m")) for k, m in SCENARIOS.items())))).select("s.scenario", "s.m", *px.columns)
    each = each.withColumn("fs", P.safety_at(F.col("m"), F.col("fs_dry"), F.col("fs_sat")))
    lab = raster.label_zones(each, ["scenario", "stack"], P.unstable(F.col("fs")) & P.creeping(F.col("velocity")))
    z = zones.describe(lab, ["scenario", "stack"], 80.0)
    placed = z.select("scenario", "stack", "zone", (75.0 + F.col("centre_col") * 0.0009).alias("lon"), (33.0 - F.col("centre_row") * 0.0007).alias("lat"), "severity", "mean_fs", F.col("mean_velocity").alias("velocity"), "area_km2", F.lit(False).alias("llof"))
    merged = zones.merge_groups(placed, ["scenario"], ["stack", "zone"])
    out = zones.merge_union(merged, ["scenario"], "seed").drop("seed").withColumns(r6("min_fs", "strongest_creep", "max_area_km2"))
    return out.withColumns({c: F.round(c, 9) for c in ("lon", "lat")})


@query("m10_alarm_report", f"WITH {_CALENDAR} SELECT site, count(*) FILTER (alarm_level = 'ALERT') AS n_alert, count(*) FILTER (alarm_level = 'WATCH') AS n_watch, count(*) AS n_days, round(max(exceedance), 6) AS max_exceedance, min(date) FILTER (alarm_level = 'ALERT') AS first_alert, max(date) FILTER (alarm_level = 'ALERT') AS last_alert FROM calendar GROUP BY site")
def report(spark, sf_dir: str) -> DataFrame:
    """What a season's calendar comes to."""
    alert = F.col("alarm_level") == "ALERT"
    return calendar(spark, sf_dir).groupBy("site").agg(F.count_if(alert).alias("n_alert"), F.count_if(F.col("alarm_level") == "WATCH").alias("n_watch"), F.count("*").alias("n_days"), F.round(F.max("exceedance"), 6).alias("max_exceedance"), F.min(F.when(alert, F.col("date"))).alias("first_alert"), F.max(F.when(alert, F.col("date"))).alias("last_alert"))


@query(
    "m11_zone_gate",
    f"""WITH {PX_ZONES}, {_CALENDAR},
e AS (SELECT site, zone, m_star, least(greatest(m_star - 0.06::DOUBLE * (twi - avg(twi) OVER (PARTITION BY site)), 0.0), 1.0) AS m_eff FROM px_zones),
d AS (SELECT site, date, least(water_mm / 40.0, 1.0) AS m FROM calendar WHERE alarm_level <> 'DORMANT')
SELECT e.site, zone, round(m_star, 6) AS m_star, round(m_eff, 6) AS m_star_eff, count(d.date) AS n_days
FROM e LEFT JOIN d ON d.site = e.site AND d.m >= e.m_eff GROUP BY e.site, zone, m_star, m_eff""",
)
def zone_gate(spark, sf_dir: str) -> DataFrame:
    """On how many armed days of its site each zone is active, by running counts over zones and days on one scale."""
    z = px_zones(spark, sf_dir)
    e = z.join(z.groupBy("site").agg(F.avg("twi").alias("twi_mean")), "site")
    e = e.select("site", "zone", "m_star", P.effective_critical_saturation(F.col("m_star"), F.col("twi"), F.col("twi_mean"), 0.06).alias("m"))
    d = calendar(spark, sf_dir).filter("alarm_level <> 'DORMANT'").select("site", F.least(F.col("water_mm") / 40.0, F.lit(1.0)).alias("m"))
    n = zones.counts_up_to(d, e, BY, "m", "n_days", descending=True)
    return n.select("site", "zone", F.round("m_star", 6).alias("m_star"), F.round("m", 6).alias("m_star_eff"), "n_days")


@query(
    "m12_confidence_tiers",
    f"""WITH {PX_ZONES}, x AS (SELECT floor((lon - 75.0) * 20) * 100 + floor((lat - 33.0) * 20) AS place, (-15.0::DOUBLE - velocity) / 8.0 AS x FROM px_zones),
c AS (SELECT place, 1.0 - product(1.0 - p) AS confidence FROM (SELECT place, {normal_cdf_sql("x")} AS p FROM x) GROUP BY place),
tau AS (SELECT unnest([0.0, 0.7, 0.9])::DOUBLE AS tau)
SELECT tau, count(*) AS n_zones, round(avg(confidence), 6) AS mean_confidence FROM c, tau WHERE confidence >= tau GROUP BY tau""",
)
def tiers(spark, sf_dir: str) -> DataFrame:
    """Confidence of each zone, and how many zones are left at cuts of it."""
    z = px_zones(spark, sf_dir).withColumn("p", normal_cdf((F.lit(-15.0) - F.col("velocity")) / 8.0)).withColumn("place", F.floor((F.col("lon") - 75.0) * 20) * 100 + F.floor((F.col("lat") - 33.0) * 20))
    c = zones.combined_confidence(z, [], "place")
    return c.withColumn("tau", F.explode(F.array(F.lit(0.0), F.lit(0.7), F.lit(0.9)))).filter("confidence >= tau").groupBy("tau").agg(F.count("*").alias("n_zones"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


#: Masks of the ladder; each is an expression on the zones that Spark and SQL both read.
RUNGS = {"all": "true", "steep": "mean_fs < 0.8", "fast": "velocity < -40", "both": "mean_fs < 0.8 AND velocity < -40"}
_RUNGS = " UNION ALL ".join(f"SELECT '{name}' AS rung, zone, lon, lat FROM px_zones WHERE {mask}" for name, mask in RUNGS.items())


@query(
    "m07_ablation_ladder",
    f"""WITH {PX_POINTS}, {PX_ZONES}, z AS ({_RUNGS}), r AS (SELECT DISTINCT rung FROM z), b AS (SELECT unnest({BUFFERS})::DOUBLE AS buffer_km),
dist AS (SELECT rung, point, label, min({KM_SQL}) AS km FROM px_points p, z GROUP BY ALL),
rate AS (
  SELECT rung, buffer_km, avg(CASE WHEN km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS t, avg(CASE WHEN km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS f
  FROM dist, b GROUP BY ALL),
e AS (SELECT rung, f AS x, t AS y, buffer_km AS o FROM rate UNION ALL SELECT rung, 0.0, 0.0, -1.0 FROM r UNION ALL SELECT rung, 1.0, 1.0, 1e9 FROM r),
l AS (SELECT rung, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM e WINDOW w AS (PARTITION BY rung ORDER BY x, o)),
auc AS (SELECT rung, sum(a) AS auc FROM l GROUP BY rung),
best AS (
  SELECT rung, buffer_km, t / nullif(f, 0) AS lift, row_number() OVER (PARTITION BY rung ORDER BY t / nullif(f, 0) DESC NULLS LAST, buffer_km) AS k FROM rate)
SELECT auc.rung, round(auc, 6) AS auc, buffer_km AS best_km, round(lift, 6) AS best_lift FROM auc JOIN best ON best.rung = auc.rung AND k = 1""",
)
def ladder(spark, sf_dir: str) -> DataFrame:
    """Several masks scored by one protocol, each with its best buffer."""
    z, points = px_zones(spark, sf_dir), px_points(spark, sf_dir)
    rungs = F.explode(F.array(*(F.when(F.expr(mask), F.lit(name)) for name, mask in RUNGS.items())))
    out = stored(validation.nearest_zone(points, z.withColumn("rung", rungs).filter("rung is not null"), ["rung"], "point", "zone"), "ladder")
    rows = validation.distance_roc(out, ["rung"], BUFFERS, digits=None)
    best = tables.first_of(rows, ["rung"], [F.desc_nulls_last("lift"), F.col("buffer_km")]).select("rung", F.col("buffer_km").alias("best_km"), F.round("lift", 6).alias("best_lift"))
    return validation.roc_area(rows, ["rung"]).join(best, "rung").withColumns(r6("auc"))


@query("m26_rank_ensemble", f"{W}, r AS (SELECT stack, row, col, percent_rank() OVER (PARTITION BY stack ORDER BY -fs_sat) AS a, percent_rank() OVER (PARTITION BY stack ORDER BY slope_deg) AS b FROM px_pixels WHERE fs_sat IS NOT NULL) SELECT stack, row, col, round((a + b) / 2, 6) AS ensemble FROM r")
def ensemble(spark, sf_dir: str) -> DataFrame:
    """Mean of the ranks of physics and terrain."""
    rank = lambda c: F.percent_rank().over(Window.partitionBy("stack").orderBy(c))
    return px_pixels(spark, sf_dir).filter("fs_sat is not null").select("stack", "row", "col", F.round((rank(-F.col("fs_sat")) + rank(F.col("slope_deg"))) / 2, 6).alias("ensemble"))


@query("m26_kfold_auc")
def kfold(spark, sf_dir: str) -> DataFrame:
    """Areas of folds that a regression did not see."""
    p = px_points(spark, sf_dir).withColumns({"x": (F.col("lon") - 75.5) * 3, "y": (F.col("lat") - 33.5) * 3, "s": F.col("score") / 10000})
    return validation.kfold_auc(p, ["x", "y", "s"], "label", "point").withColumns(r6("auc"))


@query("m06_backtest", f"WITH {_KM} SELECT label, count(*) AS n, round(median(nearest_km), 6) AS median_km, round(avg(CASE WHEN nearest_km <= 10.0 THEN 1.0 ELSE 0.0 END), 6) AS share_10km FROM dist GROUP BY label")
def backtest(spark, sf_dir: str) -> DataFrame:
    """Distances of the inventory against those of other places."""
    d = stored(_distances(spark, sf_dir).select("label", "nearest_km"), "backtest-distances")
    rates = d.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("nearest_km") <= 10.0, 1.0).otherwise(0.0)), 6).alias("share_10km"))
    middle = crosscheck.exact_quantiles(d, ["label"], "nearest_km", {"median_km": 0.5}).withColumns(r6("median_km"))
    return rates.join(middle, "label", "left").select("label", "n", "median_km", "share_10km")


@query("w07_three_day_rain", f"WITH {_WATER} SELECT site, date, round(sum(water_mm) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rain_72h FROM w")
def three_days(spark, sf_dir: str) -> DataFrame:
    """Rain of three days, or as many as there are."""
    w = Window.partitionBy("site").orderBy("date").rowsBetween(-2, 0)
    x = R.water(F.col("rain_mm"), F.col("snowmelt_mm"))
    return px_daily(spark, sf_dir).select("site", "date", F.round(F.sum(x).over(w), 6).alias("rain_72h"))


@query(
    "k04_payload",
    f"""WITH {PX_ZONES}, z AS (
  SELECT stack, zone, severity, round(velocity, 3) AS velocity, (row_number() OVER (PARTITION BY stack ORDER BY zone) - 1) // 20 AS part FROM px_zones)
SELECT stack, part, '{{"n_zones":' || count(*) || ',"n_critical":' || count(*) FILTER (severity = 'CRITICAL') || ',"rows":['
  || string_agg('{{"zone":' || zone || ',"severity":"' || severity || '","velocity":' || velocity::VARCHAR || '}}', ',' ORDER BY zone) || ']}}' AS payload FROM z GROUP BY stack, part""",
)
def payload(spark, sf_dir: str) -> DataFrame:
    """JSON texts for each look, of twenty zones in order, each with a summary."""
    z = px_zones(spark, sf_dir).select("stack", "zone", "severity", F.round("velocity", 3).alias("velocity"))
    return json_payload(z, ["stack"], {"n_zones": F.count("*"), "n_critical": F.count_if(F.col("severity") == "CRITICAL")}, "zone", most=20)


@query("p37_explanations", f"WITH {PX_ZONES} SELECT zone, 'fs ' || printf('%.2f', round(mean_fs, 2)) || ' under ' || severity || ' with ' || (floor(-velocity))::BIGINT || ' mm a year' AS reason FROM px_zones")
def explanations(spark, sf_dir: str) -> DataFrame:
    """Why a zone is there, in words."""
    return px_zones(spark, sf_dir).select("zone", F.format_string("fs %.2f under %s with %d mm a year", F.round("mean_fs", 2), F.col("severity"), F.floor(-F.col("velocity"))).alias("reason"))


@query("u02_union_all", f"{W} SELECT 'h' AS src, stack, count(*) AS n FROM px_pixels WHERE coh >= 0.7 GROUP BY 2 UNION ALL SELECT 'l', stack, count(*) FROM px_pixels WHERE coh < 0.35 GROUP BY 2")
def union_all(spark, sf_dir: str) -> DataFrame:
    """Tagged tables put together."""
    px = px_pixels(spark, sf_dir)
    part = lambda name, c: px.filter(c).groupBy("stack").agg(F.count("*").alias("n")).select(F.lit(name).alias("src"), "stack", "n")
    return part("h", F.col("coh") >= 0.7).unionByName(part("l", F.col("coh") < 0.35))


@query("a03_group_correlation", f"WITH {PX_PIXELS}, s AS (SELECT stack, row, count(*) AS n, covar_pop(dem, velocity) AS c, var_pop(dem) * var_pop(velocity) AS v FROM px_pixels WHERE coh IS NOT NULL GROUP BY 1, 2) SELECT stack, row, round(CASE WHEN v > 0 THEN c / sqrt(v) END, 6) AS r FROM s")
def correlations(spark, sf_dir: str) -> DataFrame:
    """Correlation in each line, null without spread."""
    from talus.functions.stats import guarded_corr

    px = px_pixels(spark, sf_dir).filter("coh is not null")
    return px.groupBy("stack", "row").agg(F.round(guarded_corr(F.col("dem"), F.col("velocity")), 6).alias("r"))


@query("a31_exposed_length", f"{W} SELECT stack, row, CASE WHEN slope_deg >= 35 THEN 'NEAR' WHEN slope_deg >= 20 THEN 'FAR' ELSE 'CLEAR' END AS band, count(*) * 80.0::DOUBLE AS length_m FROM px_pixels GROUP BY 1, 2, 3")
def exposed(spark, sf_dir: str) -> DataFrame:
    """Length of each band along lines."""
    from talus.operators.exposure import exposed_length

    band = P.banded(F.col("slope_deg"), [(35.0, "NEAR"), (20.0, "FAR"), (0.0, "CLEAR")])
    return exposed_length(px_pixels(spark, sf_dir).withColumn("band", band), ["stack", "row"], "band", 80.0)


@query("f10_valid_fraction", f"{W} SELECT stack, row, round(CASE WHEN count(coh)::DOUBLE / count(*) >= 0.9 THEN avg(coh) END, 6) AS coh, round(count(coh)::DOUBLE / count(*), 6) AS valid_share FROM px_pixels GROUP BY 1, 2")
def fractions(spark, sf_dir: str) -> DataFrame:
    """means of lines with enough known pixels."""
    from talus.operators.exposure import valid_fraction

    return valid_fraction(px_pixels(spark, sf_dir), ["stack", "row"], "coh", 0.9).withColumns(r6("coh", "valid_share"))


@query("m30_status_board", f"WITH {_CALENDAR}, l AS (SELECT site, max(date) AS last FROM calendar GROUP BY site), m AS (SELECT max(last) AS today FROM l) SELECT site, last, date_diff('day', last, today)::INT AS age_d, CASE WHEN date_diff('day', last, today) <= 7 THEN 'fresh' WHEN date_diff('day', last, today) <= 14 THEN 'amber' ELSE 'unknown' END AS state FROM l, m")
def status(spark, sf_dir: str) -> DataFrame:
    """How old each site's newest day is."""
    last = calendar(spark, sf_dir).groupBy("site").agg(F.max("date").alias("last"))
    age = F.datediff(F.lit(last.agg(F.max("last")).first()[0]), "last")
    return last.select("site", "last", age.alias("age_d"), F.when(age <= 7, "fresh").when(age <= 14, "amber").otherwise("unknown").alias("state"))


@query(
    "g16_shared_grids",
    f"""{W}, g AS (
  SELECT split_part(stack, '-', 2) AS path, stack, min(col) AS x, min(row) AS y, max(col) - min(col) + 1 AS w, max(row) - min(row) + 1 AS h
  FROM px_pixels GROUP BY 1, 2)
SELECT path, count(DISTINCT (x, y, w, h)) = 1 AS shared FROM g GROUP BY 1""",
)
def shared(spark, sf_dir: str) -> DataFrame:
    """Whether all stacks of a path cover one grid."""
    size = lambda c: F.max(c) - F.min(c) + 1
    grids = px_pixels(spark, sf_dir).groupBy(F.split_part("stack", F.lit("-"), F.lit(2)).alias("path"), "stack").agg(
        F.min("col").alias("left"), F.min("row").alias("top"), F.lit(80.0).alias("res"), size("col").alias("width"), size("row").alias("height")
    )
    return raster.shares_grid(grids, ["path"])

