"""Reports that check one product with another: velocities, delays, methods, optical change, catalogues, manifests, tiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import physics as P
from talus.operators import audit, crosscheck, raster, validation, zones
from talus.plans.pixels import _ENDS, _GRADS, _K, _KERNEL, BY, W
from talus.plans.places import BUFFERS, GREEDY_SQL, KM_SQL, _read
from talus.plans.regions import DEGREE
from talus.plans.registry import query, r6
from talus.sources import manifest
from talus.sources.proxies import PX_POINTS, PX_ZONES, px_pixels, px_points, px_zones
from talus.sources.storage import shared_folder, stored


def _corr(x: str, y: str) -> str:
    """Correlation over rows that have both; null without spread."""
    only = lambda a, b: f"CASE WHEN {b} IS NOT NULL THEN {a} END"
    return f"covar_pop({x}, {y}) / nullif(sqrt(var_pop({only(x, y)}) * var_pop({only(y, x)})), 0.0)"


# -- velocities down the slope ----------------------------------------------------------------


@query(
    "m32_slope_velocity_report",
    f"""{W}, {_GRADS}, u AS (SELECT g.*, p.velocity, p.twi, sqrt(d_row * d_row + d_col * d_col) AS t FROM g JOIN px_pixels p USING (stack, row, col)),
v AS (SELECT *, atan(t) AS s, 0.6 + twi / 100.0 AS th, 1.0::DOUBLE + twi / 50.0 AS ph FROM u),
c AS (
  SELECT *, CASE WHEN t > 0 THEN cos(s) * (-d_col) / t ELSE 0 END * cos(th) * cos(ph) + CASE WHEN t > 0 THEN cos(s) * d_row / t ELSE 0 END * cos(th) * sin(ph) - sin(s) * sin(th) AS c FROM v),
w AS (SELECT stack, velocity, abs(c) AS sens, CASE WHEN abs(c) >= 0.3 AND degrees(s) >= 5.0 THEN velocity / c END AS along FROM c WHERE c IS NOT NULL AND velocity IS NOT NULL)
SELECT stack, count(*) AS n_valid, count(along) AS n_observed, round(1.0 - count(along)::DOUBLE / count(*), 6) AS blind_share, round(median(sens), 6) AS median_sensitivity,
       count(*) FILTER (velocity < -15.0) AS n_los_creep, count(*) FILTER (along > 15.0) AS n_slope_creep,
       round(median(abs(along) / greatest(abs(velocity), 1e-6)) FILTER (velocity < -15.0 AND along IS NOT NULL), 6) AS median_amplification, round(max(abs(along)), 6) AS max_v_slope
FROM w GROUP BY stack""",
)
def slope_velocity_report(spark, sf_dir: str) -> DataFrame:
    """What of a stack the line of sight sees, and creep along it against creep down the slope."""
    g = raster.gradients(px_pixels(spark, sf_dir).select("stack", "row", "col", "dem", "velocity", "twi"), BY, "dem", 80.0)
    down, los = P.downslope_unit(F.col("d_row"), F.col("d_col")), P.los_unit(0.6 + F.col("twi") / 100.0, 1.0 + F.col("twi") / 50.0)
    seen = g.select("stack", "velocity", (down[0] * los[0] + down[1] * los[1] + down[2] * los[2]).alias("c"), F.degrees(F.atan(F.hypot("d_row", "d_col"))).alias("s"))
    out = crosscheck.slope_velocity_report(stored(seen, "slope-velocity"), BY, "velocity", "c", "s", least_slope=5.0)
    return out.withColumns(r6("blind_share", "median_sensitivity", "median_amplification", "max_v_slope"))


@query(
    "m34_velocity_inspection",
    f"""{W}, e AS (SELECT stack, 'all' AS set, velocity AS v FROM px_pixels UNION ALL SELECT stack, 'coherent', velocity FROM px_pixels WHERE coh >= 0.7)
SELECT stack, set, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most, count(*) FILTER (abs(v) > 60.0) AS n_fast,
       round(quantile_cont(v, 0.02), 6) AS p02, round(median(v), 6) AS median, round(quantile_cont(v, 0.98), 6) AS p98 FROM e WHERE v IS NOT NULL GROUP BY 1, 2""",
)
def velocity_inspection(spark, sf_dir: str) -> DataFrame:
    """Velocities of all pixels and of the coherent ones, and those too fast to be trusted."""
    out = crosscheck.velocity_inspection(px_pixels(spark, sf_dir), BY, "velocity", "coh", 0.7, 60.0)
    return out.withColumns(r6("mean", "std", "least", "most", "p02", "median", "p98"))


# -- delays of pairs --------------------------------------------------------------------------

_SITE_EPOCH = "split_part(stack, '-', 1) AS site, split_part(stack, '-', 2)::INT AS epoch"


def _epochs(spark, sf_dir: str) -> DataFrame:
    """The pixels of px_pixels as looks (epochs) of a site."""
    part = lambda i: F.split("stack", "-")[i]
    return px_pixels(spark, sf_dir).withColumns({"site": part(0), "epoch": part(1).cast("int")})


@query(
    "m25_delay_crosscheck",
    f"""{W}, lay AS (SELECT {_SITE_EPOCH}, row, col, (phase + 4.0) / 10.0 AS zenith, 0.6 + twi / 100.0 AS theta, dem, CASE WHEN coh >= 0.4 THEN -phase * {_K!r}::DOUBLE * 1000.0 END AS obs FROM px_pixels),
co AS (SELECT site, epoch, row // 4 AS r2, col // 4 AS c2, avg(zenith) AS zenith, avg(theta) AS theta, avg(dem) AS dem, avg(obs) AS obs FROM lay GROUP BY 1, 2, 3, 4),
st AS (SELECT site, epoch AS sec, lag(epoch) OVER (PARTITION BY site ORDER BY epoch) AS ref FROM (SELECT DISTINCT site, epoch FROM lay)),
b AS (
  SELECT st.site, ref, sec, l.dem, l.obs, -((l.zenith / sin(l.theta) * 1000.0 - e.zenith / sin(l.theta) * 1000.0) / 1000.0) * {_K!r}::DOUBLE * 1000.0 AS pred
  FROM st JOIN co l ON l.site = st.site AND l.epoch = st.sec JOIN co e ON e.site = st.site AND e.epoch = st.ref AND e.r2 = l.r2 AND e.c2 = l.c2),
x AS (
  SELECT site, ref, sec, count(*) AS n_elev, {_corr("pred", "dem")} AS r_elev, count(obs) AS n_obs, {_corr("pred", "obs")} AS r_obs, min(pred) AS least_mm, max(pred) AS most_mm FROM b GROUP BY 1, 2, 3),
au AS (SELECT site, epoch, count(*) AS n, max(dem) - min(dem) AS span, {_corr("dem", "obs")} AS r FROM lay WHERE obs IS NOT NULL GROUP BY 1, 2)
SELECT x.site, ref, sec, n_elev, round(r_elev, 6) AS r_elev, round(r_elev * r_elev, 6) AS r2_elev, n_obs, round(r_obs, 6) AS r_obs, round(r_obs * r_obs, 6) AS r2_obs,
       round(least_mm, 6) AS least_mm, round(most_mm, 6) AS most_mm, round(r * r, 6) AS audit_r2,
       CASE WHEN n < 1000 OR span < 50.0 THEN 'INSUFFICIENT_DATA' WHEN r * r >= 0.5 THEN 'QUARANTINE' WHEN r * r >= 0.3 THEN 'CONCERN' WHEN n IS NOT NULL THEN 'CLEAN' END AS audit_class
FROM x LEFT JOIN au ON au.site = x.site AND au.epoch = x.sec""",
)
def delay_crosscheck(spark, sf_dir: str) -> DataFrame:
    """The motion that delays of neighbouring looks predict against height and observed motion, beside the audit of the later look."""
    observed = P.coherence_masked(P.los_displacement(F.col("phase")), F.col("coh")) * 1000.0
    px = _epochs(spark, sf_dir).select(
        "site", "epoch", "row", "col", ((F.col("phase") + 4.0) / 10.0).alias("zenith_m"), (0.6 + F.col("twi") / 100.0).alias("theta"), "dem", observed.alias("observed_mm"))
    px = stored(px, "delay-layers")
    pairs = crosscheck.delay_crosscheck(px, ["site"], "epoch", 4)
    looks = audit.regression_audit(px, ["site", "epoch"], "observed_mm", "dem")
    looks = looks.select("site", F.col("epoch").alias("sec"), F.col("r_squared").alias("audit_r2"), F.col("classification").alias("audit_class"))
    squares = {f"r2_{k}": F.col(f"r_{k}") * F.col(f"r_{k}") for k in ("elev", "obs")}
    return pairs.join(looks, ["site", "sec"], "left").withColumns(squares).withColumns(r6("r_elev", "r2_elev", "r_obs", "r2_obs", "least_mm", "most_mm", "audit_r2"))


# -- methods side by side ---------------------------------------------------------------------


def _smoothed(cells: str, by: str) -> str:
    """p2: sums of the Gaussian's weights over `held` of a table of cells, first down columns, then along rows."""
    return f"""k AS (SELECT unnest(range({-(len(_KERNEL) // 2)}, {len(_KERNEL) // 2 + 1})) AS o, unnest({_KERNEL}::DOUBLE[]) AS w),
groups AS (SELECT DISTINCT {by} FROM {cells}),
lattice AS (SELECT {", ".join(f"groups.{c.strip()}" for c in by.split(","))}, r.row, c.col, r0, r1, c0, c1 FROM groups JOIN ends USING (stack), unnest(generate_series(r0, r1)) AS r(row), unnest(generate_series(c0, c1)) AS c(col)),
x AS (SELECT s.*, coalesce(held, 0.0) AS n, CASE WHEN held IS NULL THEN 0.0 ELSE 1.0 END AS d FROM lattice s LEFT JOIN {cells} USING ({by}, row, col)),
p1 AS (
  SELECT {", ".join(f"x.{c.strip()}" for c in by.split(","))}, x.row, x.col, x.c0, x.c1, sum(w * y.n) AS n, sum(w * y.d) AS d
  FROM x, k, x y WHERE {" AND ".join(f"y.{c.strip()} = x.{c.strip()}" for c in by.split(","))} AND y.col = x.col AND y.row = least(greatest(x.row + o, x.r0), x.r1) GROUP BY ALL),
p2 AS (
  SELECT {", ".join(f"x.{c.strip()}" for c in by.split(","))}, x.row, x.col, sum(w * y.n) AS n, sum(w * y.d) AS d
  FROM p1 x, k, p1 y WHERE {" AND ".join(f"y.{c.strip()} = x.{c.strip()}" for c in by.split(","))} AND y.row = x.row AND y.col = least(greatest(x.col + o, x.c0), x.c1) GROUP BY ALL)"""


@query(
    "m24_method_comparison",
    f"""{W}, {_ENDS}, sl AS (SELECT stack, regr_slope(velocity, dem) AS by_dem, regr_slope(velocity, row) AS by_row FROM px_pixels GROUP BY stack),
bx AS (
  SELECT p.stack, row, col, coalesce(coh >= 0.4, false) AS ok, velocity AS m0, velocity - by_dem * dem AS m1, velocity - by_row * row AS m2, CASE WHEN coh >= 0.4 THEN -phase * {_K!r}::DOUBLE * 1000.0 END AS ref
  FROM px_pixels p JOIN sl ON sl.stack = p.stack),
by_m AS (
  SELECT stack, row, col, ok, ok AND m0 IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL AND ref IS NOT NULL AS al,
         unnest(['none', 'height', 'ramp', '_reference']) AS method, unnest([m0, m1, m2, ref]) AS v FROM bx),
mv AS (SELECT *, CASE WHEN ok THEN v END AS held FROM by_m), {_smoothed("mv", "stack, method")},
hp AS (SELECT mv.*, held - CASE WHEN d > 1e-3 THEN n / d END AS hp FROM mv JOIN p2 USING (stack, method, row, col)),
rf AS (SELECT stack, row, col, v AS rv, hp AS rhp FROM hp WHERE method = '_reference' AND al AND hp IS NOT NULL),
cm AS (
  SELECT stack, method, count(*) AS n, stddev_pop(v) AS std, {_corr("v", "rv")} AS r_raw, {_corr("v", "rhp")} AS r_hp, {_corr("hp", "rhp")} AS r_hp_hp, stddev_pop(v - rv) AS rms
  FROM hp JOIN rf USING (stack, row, col) WHERE method <> '_reference' AND al GROUP BY 1, 2)
SELECT stack, method, n, round(std, 6) AS std, round(r_raw, 6) AS r_raw, round(r_hp, 6) AS r_hp, round(r_hp_hp, 6) AS r_hp_hp, round(rms, 6) AS rms,
       round(100.0 * (max(std) FILTER (method = 'none') OVER g - std) / nullif(max(std) FILTER (method = 'none') OVER g, 0.0), 6) AS reduction_pct,
       row_number() OVER (PARTITION BY stack ORDER BY round(std, 6), method) = 1 AS lowest_scatter,
       row_number() OVER (PARTITION BY stack ORDER BY round(r_raw, 6) DESC NULLS LAST, method) = 1 AS best_agreement
FROM cm WINDOW g AS (PARTITION BY stack)""",
)
def method_comparison(spark, sf_dir: str) -> DataFrame:
    """Velocities without and with two corrections against the phase's motion, on the same pixels, raw and high-passed."""
    px = px_pixels(spark, sf_dir).select("stack", "row", "col", "coh", "velocity", "dem", "phase")
    px = stored(px, "method-pixels")
    slopes = px.groupBy("stack").agg(F.regr_slope("velocity", "dem").alias("by_dem"), F.regr_slope("velocity", "row").alias("by_row"))
    v = F.col("velocity")
    methods = {"none": v, "height": v - F.col("by_dem") * F.col("dem"), "ramp": v - F.col("by_row") * F.col("row")}
    reference = P.coherence_masked(P.los_displacement(F.col("phase")) * 1000.0, F.col("coh"))
    out = crosscheck.compare_methods(px.join(slopes, "stack"), BY, methods, "none", reference, F.coalesce(F.col("coh") >= 0.4, F.lit(False)), 2.0)
    return out.withColumns(r6("std", "r_raw", "r_hp", "r_hp_hp", "rms", "reduction_pct"))


@query(
    "m24_hazard_delta",
    f"""{W.replace("WITH", "WITH RECURSIVE", 1)}, {_ENDS}, mv AS (SELECT stack, row, col, CASE WHEN coh >= 0.4 THEN velocity END AS held FROM px_pixels), {_smoothed("mv", "stack")},
t AS (
  SELECT stack, row, col, p.fs_sat, held AS a, held - CASE WHEN d > 1e-3 THEN p2.n / d END AS b FROM px_pixels p JOIN mv USING (stack, row, col) JOIN p2 USING (stack, row, col)),
f AS (
  SELECT *, coalesce(a < -15.0, false) AS ca, coalesce(b < -15.0, false) AS cb, coalesce(fs_sat < 1.0 AND a < -15.0, false) AS ha, coalesce(fs_sat < 1.0 AND b < -15.0, false) AS hb FROM t),
on_cells AS (SELECT 'a' AS variant, stack, row, col, row::BIGINT * 1000000000 + col AS i FROM f WHERE ha UNION ALL SELECT 'b', stack, row, col, row::BIGINT * 1000000000 + col FROM f WHERE hb),
e AS (SELECT p.variant, p.stack, p.i AS a, q.i AS b FROM on_cells p JOIN on_cells q ON q.variant = p.variant AND q.stack = p.stack AND abs(p.row - q.row) + abs(p.col - q.col) = 1),
reach(variant, stack, a, b) AS (
  SELECT variant, stack, i, i FROM on_cells UNION SELECT r.variant, r.stack, r.a, e.b FROM reach r JOIN e ON e.variant = r.variant AND e.stack = r.stack AND e.a = r.b),
lab AS (SELECT variant, stack, a, min(b) AS zone FROM reach GROUP BY 1, 2, 3),
z AS (SELECT variant, stack, zone FROM lab GROUP BY 1, 2, 3 HAVING count(*) >= 3),
nz AS (SELECT stack, count(*) FILTER (variant = 'a') AS zones_a, count(*) FILTER (variant = 'b') AS zones_b FROM z GROUP BY 1),
s AS (
  SELECT stack, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_common, {_corr("a", "b")} AS r, count(*) FILTER (ca) AS creep_a, count(*) FILTER (cb) AS creep_b,
         count(*) FILTER (ca AND cb)::DOUBLE / nullif(count(*) FILTER (ca OR cb), 0) AS creep_iou, count(*) FILTER (ha) AS high_a, count(*) FILTER (hb) AS high_b,
         count(*) FILTER (ha AND hb)::DOUBLE / nullif(count(*) FILTER (ha OR hb), 0) AS high_iou FROM f GROUP BY 1)
SELECT s.stack, n_common, round(r, 6) AS r, creep_a, creep_b, round(creep_iou, 6) AS creep_iou, high_a, high_b, round(high_iou, 6) AS high_iou,
       coalesce(zones_a, 0) AS zones_a, coalesce(zones_b, 0) AS zones_b FROM s LEFT JOIN nz ON nz.stack = s.stack""",
)
def hazard_delta(spark, sf_dir: str) -> DataFrame:
    """Creep, the highest class and its zones by raw and by high-passed velocities on the same stability."""
    px = px_pixels(spark, sf_dir).select("stack", "row", "col", "fs_sat", P.coherence_masked(F.col("velocity"), F.col("coh")).alias("velocity"))
    px = stored(px, "hazard-pixels")
    both = stored(raster.gaussian_highpass(px, BY, "velocity", 2.0), "hazard-velocities")
    return crosscheck.hazard_delta(both, BY, "fs_sat", "velocity", "highpass").withColumns(r6("r", "creep_iou", "high_iou"))


# -- optical change ---------------------------------------------------------------------------

#: Cells around a scar that are looked at, nearest first.
RADII = [2, 4, 8]


@query(
    "m29_optical_change",
    f"""{W}, {PX_POINTS}, im AS (
  SELECT {_SITE_EPOCH}, row, col, CASE WHEN (row + col + split_part(stack, '-', 2)::INT) % 12 NOT IN (3, 8, 9, 10, 11) THEN (slope_deg - twi) / (slope_deg + twi) END AS v FROM px_pixels),
mx AS (SELECT site, max(epoch) AS m, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM im GROUP BY 1),
ch AS (SELECT im.site, row, col, round(median(v) FILTER (2 * epoch >= m) - median(v) FILTER (2 * epoch < m), 9) AS change FROM im JOIN mx ON mx.site = im.site GROUP BY 1, 2, 3),
st AS (SELECT site, count(*) AS n_cells, avg(CASE WHEN change < -0.15 THEN 1.0 ELSE 0.0 END) * 100 AS strong, median(change) AS median, quantile_cont(change, 0.05) AS p05 FROM ch WHERE change IS NOT NULL GROUP BY 1),
sc AS (
  SELECT st.site, point, floor((lat - 34.0::DOUBLE) / (-1.0::DOUBLE / 60.0::DOUBLE))::INT AS row, floor((lon - 75.0::DOUBLE) / 0.02::DOUBLE)::INT AS col FROM px_points, st WHERE label = 1),
ne AS (
  SELECT sc.site, point, {", ".join(f"min(change) FILTER (greatest(abs(ch.row - sc.row), abs(ch.col - sc.col)) <= {r}) AS m{r}" for r in RADII)}
  FROM sc JOIN mx ON mx.site = sc.site LEFT JOIN ch ON ch.site = sc.site AND abs(ch.row - sc.row) <= {RADII[-1]} AND abs(ch.col - sc.col) <= {RADII[-1]} AND sc.row BETWEEN r0 AND r1 AND sc.col BETWEEN c0 AND c1
  GROUP BY 1, 2),
us AS (SELECT site, point, CASE {" ".join(f"WHEN m{r} IS NOT NULL THEN {r}" for r in RADII)} END AS radius, coalesce({", ".join(f"m{r}" for r in RADII)}) AS s FROM ne),
bl AS (SELECT u.site, u.s, count(*) FILTER (c.change < u.s) AS n_below FROM (SELECT DISTINCT site, s FROM us WHERE s IS NOT NULL) u JOIN ch c ON c.site = u.site GROUP BY 1, 2)
SELECT us.site, point, radius * 80 AS radius_m, round(us.s, 6) AS scar_change, round(100.0::DOUBLE * n_below / n_cells, 6) AS percentile,
       CASE WHEN us.s IS NULL THEN 'NO DATA' WHEN 100.0::DOUBLE * n_below / n_cells <= 5.0 THEN 'DETECTED' WHEN 100.0::DOUBLE * n_below / n_cells <= 10.0 THEN 'MARGINAL' ELSE 'NOT DETECTED' END AS grade,
       round(median - us.s, 6) AS deficit, n_cells, round(median, 6) AS median, round(p05, 6) AS p05, round(strong, 6) AS strong_loss_pct
FROM us JOIN st ON st.site = us.site LEFT JOIN bl ON bl.site = us.site AND bl.s = us.s""",
)
def optical_change(spark, sf_dir: str) -> DataFrame:
    """The loss of vegetation between early and late looks around each place of the inventory, and where it stands in its site."""
    px = _epochs(spark, sf_dir)
    clear = P.clear_pixel((F.col("row") + F.col("col") + F.col("epoch")) % 12)
    images = px.select("site", "epoch", "row", "col", F.when(clear, P.ndvi(F.col("slope_deg"), F.col("twi"))).alias("ndvi"))
    last = images.groupBy("site").agg(F.max("epoch").alias("_last"))
    change = stored(crosscheck.composite_change(images.join(last, "site"), ["site"], "ndvi", 2 * F.col("epoch") < F.col("_last")), "optical-change")
    places = px_points(spark, sf_dir).filter("label = 1").select("point", DEGREE.row_of(F.col("lat")).alias("row"), DEGREE.col_of(F.col("lon")).alias("col"))
    scars = places.withColumn("site", F.explode(F.array(*map(F.lit, "ANR"))))  # the return flags
    out = crosscheck.scar_standing(change, scars, ["site"], "point", RADII).withColumns(r6("scar_change", "percentile", "deficit", "median", "p05", "strong_loss_pct"))
    return out.withColumn("radius_m", F.col("radius") * 80).drop("radius")


# -- catalogues and manifests -----------------------------------------------------------------

KNOWN_THROUGH = "2024-01-20"


@query(
    "m33_radar_watch",
    f"""WITH sc AS (SELECT user_id AS site, CAST(ts AS DATE) AS d, event_type AS unit, hour(ts)::INT AS path, value FROM events),
lib AS (SELECT site, max(d) AS edge FROM sc WHERE unit = 'view' GROUP BY 1),
pp AS (SELECT site, path, max(d) AS newest FROM sc GROUP BY 1, 2),
pl AS (SELECT site, string_agg(path::VARCHAR || ':' || newest::VARCHAR, ',' ORDER BY path) AS per_path FROM pp GROUP BY 1),
s AS (
  SELECT sc.site, max(edge) AS library_through, max(d) AS newest, count(*) FILTER (edge IS NULL OR d > edge) AS n_new, coalesce(string_agg(DISTINCT unit, '/' ORDER BY unit) FILTER (edge IS NULL OR d > edge), '') AS new_units
  FROM sc LEFT JOIN lib ON lib.site = sc.site GROUP BY 1),
pr AS (
  SELECT site, count(*) AS n_products, count(*) FILTER (value >= 50.0) AS n_wanted, max(d) AS newest_product, count(DISTINCT CASE WHEN d > DATE '{KNOWN_THROUGH}' THEN d END) AS n_new_dates
  FROM sc WHERE unit = 'purchase' GROUP BY 1)
SELECT s.site, library_through, newest, n_new, new_units, per_path,
       CASE WHEN n_new > 0 THEN 'rebuild unblocked: ' || n_new || ' scene(s) of ' || new_units || ' through ' || newest::VARCHAR ELSE 'waiting' END AS verdict,
       coalesce(n_products, 0) AS n_products, coalesce(n_wanted, 0) AS n_wanted, newest_product, coalesce(n_new_dates, 0) AS n_new_dates, coalesce(n_new_dates > 0, false) AS stream_started
FROM s JOIN pl ON pl.site = s.site LEFT JOIN pr ON pr.site = s.site""",
)
def radar_watch(spark, sf_dir: str) -> DataFrame:
    """Scenes beyond each site's library by unit and path, and whether a second mission's stream has begun."""
    kind = F.col("event_type")
    scenes = _read(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.to_date("ts").alias("d"), kind.alias("unit"), F.hour("ts").alias("path"), "value")
    watch = crosscheck.library_watch(scenes, scenes.filter("unit = 'view'"), ["site"], "d", "path", "unit")
    level = F.when(F.col("value") >= 50.0, "wanted").otherwise("other")
    products = crosscheck.product_stream(scenes.filter("unit = 'purchase'").withColumn("level", level), ["site"], "d", "level", "wanted", KNOWN_THROUGH)
    units = F.array_join("new_units", "/")
    per_path = F.array_join(F.transform("per_path", lambda p: F.concat_ws(":", p["path"].cast("string"), p["newest"].cast("string"))), ",")
    verdict = F.when(F.col("n_new") > 0, F.concat(F.lit("rebuild unblocked: "), F.col("n_new").cast("string"), F.lit(" scene(s) of "), units, F.lit(" through "), F.col("newest").cast("string"))).otherwise("waiting")
    both = watch.withColumns({"verdict": verdict, "new_units": units, "per_path": per_path}).join(products, "site", "left")
    return both.fillna(0, ["n_products", "n_wanted", "n_new_dates"]).withColumn("stream_started", F.coalesce("stream_started", F.lit(False)))


#: Spans of the day and the stack whose scenes fall into them.
HOURS = [("000000", "060000", "DESC_path34_frame1"), ("060000", "120000", "DESC_path34_frame2"), ("120000", "180000", "ASC_path27_frame1")]
_LEGACY = "CASE " + " ".join(f"WHEN hms >= '{a}' AND hms < '{b}' THEN '{c}'" for a, b, c in HOURS) + " ELSE 'unknown' END"


@query(
    "s23_manifest",
    f"""WITH ev AS (
  SELECT 'S1AA_' || strftime(ts, '%Y%m%dT%H%M%S') || '_' || strftime(ts + INTERVAL 12 DAY, '%Y%m%dT%H%M%S') || '_' || event_id AS product, strftime(ts, '%H%M%S') AS hms,
         CAST(ts AS DATE) AS ref, CAST(ts + INTERVAL 12 DAY AS DATE) AS sec, event_type, user_id, value FROM events),
j AS (
  SELECT product, ref, sec, {_LEGACY} AS legacy,
         CASE WHEN event_type NOT IN ('view', 'error') AND value >= 10.0 THEN CASE WHEN event_type = 'click' THEN 'ASC' ELSE 'DESC' END || '_path' || user_id || '_frame' || floor(value)::INT END AS told FROM ev),
m AS (SELECT product, ref, sec, coalesce(told, legacy) AS stack, CASE WHEN told IS NULL THEN 'legacy_bootstrap' ELSE 'metadata' END AS source FROM j)
SELECT product, stack, source, CASE WHEN stack LIKE 'ASC%' THEN 'ASCENDING' WHEN stack LIKE 'DESC%' THEN 'DESCENDING' ELSE 'unknown' END AS direction,
       try_cast(regexp_extract(stack, '_path([0-9]+)_', 1) AS INT) AS path, try_cast(regexp_extract(stack, '_frame([0-9]+)$', 1) AS INT) AS frame,
       EXISTS (SELECT 1 FROM m o WHERE o.stack = m.stack AND o.ref = m.sec) AS covered
FROM m""",
)
def manifest_of_products(spark, sf_dir: str) -> DataFrame:
    """A manifest begun from times of the day, brought up to date from jobs, and the products whose two dates are at hand."""
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    product = F.concat(F.lit("S1AA_"), stamp(F.col("ts")), F.lit("_"), stamp(F.col("ts") + F.expr("interval 12 days")), F.lit("_"), F.col("event_id").cast("string"))
    e = _read(spark, sf_dir, "events").withColumn("product", product)
    kind, value = F.col("event_type"), F.col("value")
    told = F.concat(F.when(kind == "click", "ASCENDING").otherwise("desc"), F.lit("_path"), F.col("user_id").cast("string"), F.lit("_frame"), F.floor(value).cast("string"))
    name = F.concat(F.when(kind == "error", "Trial_").otherwise("Site_"), F.when(value >= 10.0, told).otherwise("unlabelled"))
    jobs = e.filter(kind != "view").select(name.alias("name"), F.concat("product", F.lit(".zip")).alias("file"))
    held = manifest.Manifest(spark, f"{shared_folder(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}")
    held.update(manifest.bootstrap(e.select("product"), HOURS))
    held.update(manifest.entries_of_jobs(jobs, "Site"))
    entries = held.load()
    epochs = entries.select("stack", F.to_date(manifest.pair_dates(F.col("product"))[0]).alias("date")).distinct()
    whole = manifest.covered(entries, epochs).select("product", F.lit(True).alias("covered"))
    return entries.join(whole, "product", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


# -- tier cards -------------------------------------------------------------------------------

#: Saturations at which footprints are drawn, those for which scores were made anew later, and the reach within which zones of several looks are one.
TIERS = {"dry": 0.3, "operational": 0.5, "monsoon": 1.0}
RESCORED = ("operational", "monsoon")
TIER_DEG, AT_KM, LIFT_KM = 0.05, 20.0, 10.0
_TIER_ROWS = ", ".join(f"('{n}', {m}::DOUBLE, {str(n in RESCORED).lower()})" for n, m in TIERS.items())


def _scored_sql(name: str, where: str) -> str:
    """<name>: area, rates at AT_KM and lift at LIFT_KM of a footprint's zones; <name>r: the area by ranks of distances."""
    return f"""{name}d AS (SELECT place, point, label, min({KM_SQL}) AS km FROM px_points p, (SELECT * FROM foot WHERE {where}) z GROUP BY ALL),
{name}b AS (
  SELECT place, buffer_km, avg(CASE WHEN km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS t, avg(CASE WHEN km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS f
  FROM {name}d, (SELECT unnest({BUFFERS})::DOUBLE AS buffer_km) GROUP BY ALL),
{name}e AS (SELECT place, f AS x, t AS y, buffer_km AS o FROM {name}b UNION ALL SELECT DISTINCT place, 0.0, 0.0, -1.0 FROM {name}b UNION ALL SELECT DISTINCT place, 1.0, 1.0, 1e9 FROM {name}b),
{name}l AS (SELECT place, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM {name}e WINDOW w AS (PARTITION BY place ORDER BY x, o)),
{name}a AS (SELECT place, sum(a) AS auc FROM {name}l GROUP BY place),
{name} AS (
  SELECT b.place, max(auc) AS auc, max(t) FILTER (buffer_km = {AT_KM}) AS recall, max(1 - f) FILTER (buffer_km = {AT_KM}) AS specificity, max(CASE WHEN f > 0 THEN t / f END) FILTER (buffer_km = {LIFT_KM}) AS lift
  FROM {name}b b JOIN {name}a a ON a.place = b.place GROUP BY b.place)"""


@query(
    "j22_tier_card",
    f"""WITH RECURSIVE {PX_POINTS}, {PX_ZONES}, tiers(scenario, m, rescored) AS (VALUES {_TIER_ROWS}),
mo AS (
  SELECT site || '/' || scenario AS place, lon, lat, stack, severity, row_number() OVER (PARTITION BY site, scenario ORDER BY stack, zone) AS k FROM px_zones, tiers WHERE m_star <= m), {GREEDY_SQL.format(deg=TIER_DEG)},
foot AS (SELECT place, seed, avg(lon) AS lon, avg(lat) AS lat, bool_or(severity = 'CRITICAL') AS crit, count(DISTINCT stack) AS n_looks FROM taken GROUP BY 1, 2),
c AS (SELECT place, count(*) AS n_zones, count(*) FILTER (crit) AS n_crit, count(*) FILTER (n_looks >= 2) AS n_multi FROM foot GROUP BY 1),
{_scored_sql("sc", "true")}, {_scored_sql("co", "n_looks >= 2")},
rk AS (SELECT place, label, row_number() OVER (PARTITION BY place ORDER BY -km, point) AS i FROM scd),
ra AS (
  SELECT place, (sum(i) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / nullif((count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE, 0) AS auc FROM rk GROUP BY 1)
SELECT s.site, t.scenario, m, coalesce(n_zones, 0) AS n_zones, coalesce(n_crit, 0) AS n_crit, coalesce(n_multi, 0) AS n_multi,
       round(CASE WHEN rescored THEN coalesce(ra.auc, sc.auc) ELSE sc.auc END, 6) AS auc, round(sc.recall, 6) AS recall, round(sc.specificity, 6) AS specificity, round(sc.lift, 6) AS lift,
       round(co.auc, 6) AS core_auc, round(co.lift, 6) AS core_lift
FROM (SELECT DISTINCT site FROM px_zones) s CROSS JOIN tiers t LEFT JOIN c ON c.place = site || '/' || scenario LEFT JOIN sc ON sc.place = site || '/' || scenario
LEFT JOIN co ON co.place = site || '/' || scenario LEFT JOIN ra ON ra.place = site || '/' || scenario""",
)
def tier_card(spark, sf_dir: str) -> DataFrame:
    """Each site's footprint at some saturations with its back-test, scores made later in place of earlier ones, and the core of zones that two looks see."""
    by = ["site", "scenario"]
    z = px_zones(spark, sf_dir)
    tiers = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("m")) for n, m in TIERS.items())))
    cards = z.select("site").distinct().withColumn("t", tiers).select("site", "t.*")
    shown = z.withColumn("t", tiers).filter("m_star <= t.m").withColumn("scenario", F.col("t.scenario"))
    seeds = zones.merge_groups(shown, by, ["stack", "zone"], TIER_DEG).groupBy(*by, "seed")
    foot = seeds.agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.bool_or(F.col("severity") == "CRITICAL").alias("crit"), F.count_distinct("stack").alias("n_looks"))
    foot = stored(foot.withColumnRenamed("seed", "zone"), "tier-footprint")
    counts = foot.groupBy(*by).agg(F.count("*").alias("n_zones"), F.count_if("crit").alias("n_crit"), F.count_if(F.col("n_looks") >= 2).alias("n_multi"))
    # all zones and the core are asked of in one search, with the places of all sites
    sets = F.explode(F.when(F.col("n_looks") >= 2, F.array(F.lit("all"), F.lit("core"))).otherwise(F.array(F.lit("all"))))
    both = validation.nearest_zone(px_points(spark, sf_dir).select("point", "lon", "lat", "label"), foot.withColumn("of", sets), [*by, "of"], "point", "zone")
    both = stored(both.filter("nearest_km is not null").select(*by, "of", "point", "label", "nearest_km"), "tier-distances")
    near, core = both.filter("of = 'all'"), both.filter("of = 'core'")

    def scored(distances: DataFrame) -> DataFrame:
        rows = stored(validation.distance_roc(distances, by, BUFFERS, digits=None), "tier-rates")
        at = lambda km, c: F.max(F.when(F.col("buffer_km") == km, F.col(c)))
        rates = rows.groupBy(*by).agg(at(AT_KM, "tpr").alias("recall"), at(AT_KM, "specificity").alias("specificity"), at(LIFT_KM, "lift").alias("lift"))
        return rates.join(validation.roc_area(rows, by), by)

    later = near.filter(F.col("scenario").isin(*RESCORED)).withColumn("closeness", -F.col("nearest_km"))
    later = validation.rank_auc(later, by, "closeness", "label", "point").select(*by, F.col("auc").alias("_later"))
    second = scored(core).select(*by, F.col("auc").alias("core_auc"), F.col("lift").alias("core_lift"))
    card = cards.join(counts, by, "left").join(scored(near), by, "left").join(later, by, "left").join(second, by, "left")
    card = card.withColumn("auc", F.coalesce("_later", "auc")).drop("_later").fillna(0, ["n_zones", "n_crit", "n_multi"])
    return card.withColumns(r6("auc", "recall", "specificity", "lift", "core_auc", "core_lift"))
