"""Queries on pixel tables: masks, audits, physics, neighbourhoods, zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import physics as P
from talus.functions.stats import creep_confidence, normal_cdf_sql
from talus.operators import audit, inversion, raster, zones
from talus.plans.registry import query, r6
from talus.sources.proxies import PX_PIXELS, px_pixels

BY = ["stack"]
SOIL, SUCTION = P.Soil(), P.Suction()
W = f"WITH {PX_PIXELS}"
_K = P.WAVELENGTH_M / (4 * 3.141592653589793)


@query("p01_displacement", f"{W} SELECT stack, row, col, round(-phase * {_K!r}::DOUBLE, 9) AS disp_m, round(CASE WHEN coh >= 0.4 THEN -phase * {_K!r}::DOUBLE END, 9) AS masked_m, round(CASE WHEN dem BETWEEN -100 AND 1200 THEN dem END, 6) AS dem_ok FROM px_pixels")
def displacement(spark, sf_dir: str) -> DataFrame:
    """Phase to displacement, masked by coherence; heights within limits."""
    d = P.los_displacement(F.col("phase"))
    return px_pixels(spark, sf_dir).select("stack", "row", "col", F.round(d, 9).alias("disp_m"), F.round(P.coherence_masked(d, F.col("coh")), 9).alias("masked_m"), F.round(P.plausible(F.col("dem"), high=1200.0), 6).alias("dem_ok"))


@query(
    "p02_mask_stats",
    f"""{W} SELECT stack, count(*) AS total_pixels, count(*) FILTER (coh IS NULL) AS null_in_coh, count(*) FILTER (coh < 0.4) AS masked_below_threshold, count(*) FILTER (coh >= 0.4) AS surviving_pixels,
round(count(*) FILTER (coh >= 0.4) * 100.0::DOUBLE / count(*), 6) AS surviving_pct, round(avg(coh), 6) AS mean_coherence_all, round(avg(coh) FILTER (coh >= 0.4), 6) AS mean_coherence_survivors FROM px_pixels GROUP BY stack""",
)
def mask_stats(spark, sf_dir: str) -> DataFrame:
    return audit.mask_statistics(px_pixels(spark, sf_dir), BY, "phase", "coh").withColumns(r6("surviving_pct", "mean_coherence_all", "mean_coherence_survivors"))


_LINES = "l AS (SELECT l_suppkey AS product, CAST(l_quantity AS DOUBLE) AS x, l_quantity * (l_suppkey % 4) * 100.0::DOUBLE + (l_extendedprice / 100.0 - floor(l_extendedprice / 100.0)) * 5000.0 AS y FROM lineitem)"


def _lines(spark, sf_dir: str) -> DataFrame:
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("product"), q.cast("double").alias("x"), (q * (F.col("l_suppkey") % 4) * 100.0 + (e / 100.0 - F.floor(e / 100.0)) * 5000.0).alias("y"))


_AUDIT = f"""{_LINES}, s AS (SELECT product, count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(y, x) AS c FROM l GROUP BY product),
au AS (SELECT product, n AS n_valid_pixels, lo AS elev_min, hi AS elev_max, hi - lo AS elev_range, CASE WHEN vx > 0 AND vy > 0 THEN c / sqrt(vx * vy) END AS pearson_r, CASE WHEN vx > 0 THEN c / vx END AS slope, my, mx FROM s),
aud AS (SELECT product, n_valid_pixels, elev_min, elev_max, elev_range, pearson_r, pearson_r * pearson_r AS r_squared, slope, my - slope * mx AS intercept,
  CASE WHEN n_valid_pixels < 100 OR elev_range < 40 THEN 'INSUFFICIENT_DATA' WHEN pearson_r * pearson_r >= 0.5 THEN 'QUARANTINE' WHEN pearson_r * pearson_r >= 0.3 THEN 'CONCERN' ELSE 'CLEAN' END AS classification FROM au)"""


def _audited(spark, sf_dir: str) -> DataFrame:
    return audit.regression_audit(_lines(spark, sf_dir), ["product"], "y", "x", 100, 40.0)


@query("a02_regression_audit", f"WITH {_AUDIT} SELECT product, n_valid_pixels, elev_min, elev_max, elev_range, round(pearson_r, 6) AS pearson_r, round(r_squared, 6) AS r_squared, round(slope, 4) AS slope, round(intercept, 4) AS intercept, classification FROM aud")
def regression_audit(spark, sf_dir: str) -> DataFrame:
    """Displacement against height for each product."""
    return _audited(spark, sf_dir).withColumns(r6("pearson_r", "r_squared") | {c: F.round(c, 4) for c in ("slope", "intercept")})


_STATS = "st AS (SELECT l_suppkey AS product, CASE WHEN l_suppkey % 13 = 0 THEN 'skipped' ELSE 'ok' END AS status, avg(l_discount) * 1000 AS surviving_pct, 0.4::DOUBLE + avg(l_tax) * 6 AS coh FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal >= 0 GROUP BY 1)"
_DECIDED = f"""{_AUDIT}, {_STATS}, half AS (SELECT * FROM aud SEMI JOIN (SELECT s_suppkey AS product FROM supplier WHERE s_acctbal < 9000) USING (product)),
j AS (SELECT coalesce(st.product, half.product) AS product, CASE WHEN st.product IS NULL THEN 'missing' ELSE status END AS coh_status, surviving_pct, coh, r_squared, coalesce(classification, 'missing') AS atmos_class FROM st FULL JOIN half ON st.product = half.product),
dec AS (SELECT *, CASE WHEN atmos_class = 'QUARANTINE' OR (coh_status = 'ok' AND coalesce(coh, 0) < 0.6) THEN 'QUARANTINE' WHEN atmos_class = 'CONCERN' THEN 'CONCERN' ELSE 'KEEP' END AS decision,
  array_to_string(list_filter([CASE WHEN coh_status <> 'ok' THEN 'coh_status=' || coh_status END, CASE WHEN coh_status = 'ok' AND coalesce(coh, 0) < 0.6 THEN 'low_coh_surv' END,
    CASE WHEN coh_status = 'ok' AND coalesce(surviving_pct, 0) < 30 THEN 'low_surv_pct' END, CASE WHEN atmos_class = 'QUARANTINE' THEN 'atmos_R2' END, CASE WHEN atmos_class = 'CONCERN' THEN 'atmos_concern_R2' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM j)"""


def _decided(spark, sf_dir: str) -> DataFrame:
    """Statistics are missing for suppliers in debt, audits for those with most money."""
    k, money = F.col("l_suppkey"), spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("product"), "s_acctbal")
    solvent = money.filter("s_acctbal >= 0").select(F.col("product").alias("l_suppkey"))
    st = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(solvent, "l_suppkey", "left_semi").groupBy(k.alias("product"), F.when(k % 13 == 0, "skipped").otherwise("ok").alias("status")).agg((F.avg("l_discount") * 1000).alias("surviving_pct"), (0.4 + F.avg("l_tax") * 6).alias("mean_coherence_survivors"))
    return audit.decide(st, _audited(spark, sf_dir).join(money.filter("s_acctbal < 9000"), "product", "left_semi"), "product")


@query("j01_full_outer_decision", f"WITH {_DECIDED} SELECT product, coh_status, round(surviving_pct, 4) AS surviving_pct, round(coh, 6) AS mean_coh_survivors, round(r_squared, 6) AS atmos_r_squared, atmos_class, decision, reasons FROM dec")
def decisions(spark, sf_dir: str) -> DataFrame:
    """Outer join of the two tables, with decision and reasons."""
    return _decided(spark, sf_dir).withColumns(r6("mean_coh_survivors", "atmos_r_squared") | {"surviving_pct": F.round("surviving_pct", 4)})


@query("a06_decision_pivot", f"WITH {_DECIDED} SELECT (product % 3)::BIGINT AS stack, count(*) FILTER (decision = 'KEEP') AS n_keep, count(*) FILTER (decision = 'CONCERN') AS n_concern, count(*) FILTER (decision = 'QUARANTINE') AS n_quarantine, count(*) AS n_all FROM dec GROUP BY 1")
def decision_pivot(spark, sf_dir: str) -> DataFrame:
    d = _decided(spark, sf_dir).withColumn("stack", (F.col("product") % 3).cast("long"))
    return audit.group_counts(d, ["stack"], "decision", ["KEEP", "CONCERN", "QUARANTINE"])


@query("k05_contamination_flags", f"WITH {_AUDIT} SELECT product, CASE WHEN product IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 7000) THEN 'job' || product END AS job_id, round_even(r_squared, 4) AS r_squared, coalesce(round_even(r_squared, 4) > 0.5, false) AS is_contaminated FROM aud")
def flags(spark, sf_dir: str) -> DataFrame:
    """The exported flags with the ids of jobs."""
    a = _audited(spark, sf_dir)
    poor = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal < 7000").select(F.col("s_suppkey").alias("product"))
    jobs = a.join(poor, "product", "left_semi").select("product", F.concat(F.lit("job"), F.col("product").cast("string")).alias("job_id"))
    return audit.contamination_flags(a, jobs, "product")


@query(
    "j06_apply_rescues",
    f"""WITH {_DECIDED}, d2 AS (SELECT *, product IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 6000) AS hit FROM dec)
SELECT product, CASE WHEN hit AND decision <> 'KEEP' THEN 'KEEP' ELSE decision END AS decision, CASE WHEN hit AND decision <> 'KEEP' THEN 'promoted' WHEN hit THEN 'already_keep' END AS outcome,
CASE WHEN hit AND decision <> 'KEEP' THEN concat_ws('; ', nullif(reasons, ''), 'RESCUED_FOR_CONNECTIVITY (was ' || decision || ', bridges: b' || product || ')') ELSE reasons END AS reasons FROM d2""",
)
def rescues(spark, sf_dir: str) -> DataFrame:
    """Rescued products are kept and say why."""
    d = _decided(spark, sf_dir).select("product", "decision", "reasons")
    rich = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal >= 6000").select(F.col("s_suppkey").alias("product"))
    r = d.join(rich, "product", "left_semi").select("product", F.concat(F.lit("b"), F.col("product").cast("string")).alias("bridges"))
    return audit.apply_rescues(d, r, "product")


@query("a07_group_summary", f"{W} SELECT stack, count(velocity) AS n, round(min(velocity), 6) AS min, round(quantile_cont(velocity, 0.05), 6) AS p5, round(median(velocity), 6) AS median, round(quantile_cont(velocity, 0.95), 6) AS p95, round(max(velocity), 6) AS max, round(avg(velocity), 6) AS mean, round(stddev_pop(velocity), 6) AS std FROM px_pixels GROUP BY stack")
def summary(spark, sf_dir: str) -> DataFrame:
    """Distribution of each stack's velocities."""
    return audit.distribution(px_pixels(spark, sf_dir), BY, "velocity").withColumns(r6("min", "p5", "median", "p95", "max", "mean", "std"))


@query("a05_mad_noise", f"{W}, m AS (SELECT stack, median(velocity) AS m, count(velocity) AS nv FROM px_pixels GROUP BY stack) SELECT p.stack, max(nv) AS n, round(CASE WHEN max(nv) >= 100 THEN median(abs(velocity - m)) * 1.4826 END, 6) AS sigma FROM px_pixels p JOIN m ON p.stack = m.stack GROUP BY p.stack")
def noise(spark, sf_dir: str) -> DataFrame:
    return audit.robust_noise(px_pixels(spark, sf_dir), BY, "velocity").withColumns(r6("sigma"))


@query(
    "p17_confidence",
    f"""{W}, m AS (SELECT stack, median(velocity) AS m, count(velocity) AS nv FROM px_pixels GROUP BY stack),
s AS (SELECT p.stack, CASE WHEN max(nv) >= 100 THEN median(abs(velocity - m)) * 1.4826 END AS sigma FROM px_pixels p JOIN m ON p.stack = m.stack GROUP BY p.stack),
x AS (SELECT p.stack, row, col, CASE WHEN sigma <> 0 THEN (-15.0 - velocity) / sigma END AS x FROM px_pixels p JOIN s ON s.stack = p.stack),
c AS (SELECT stack, row, col, {normal_cdf_sql("x")} AS c FROM x)
SELECT stack, row, col, round(c, 6) AS confidence, CASE WHEN c >= 0.9 THEN 'CONFIRMED' WHEN c >= 0.7 THEN 'LIKELY' WHEN c IS NOT NULL THEN 'UNCERTAIN' END AS tier FROM c""",
)
def confidence(spark, sf_dir: str) -> DataFrame:
    """How sure each pixel's creep is, given its stack's noise, and the band of that."""
    px = px_pixels(spark, sf_dir)
    p = px.join(audit.robust_noise(px, BY, "velocity").drop("n"), BY).select("stack", "row", "col", creep_confidence(F.col("velocity"), F.col("sigma")).alias("confidence"))
    return p.withColumns({"confidence": F.round("confidence", 6), "tier": P.banded(F.col("confidence"), [(0.9, "CONFIRMED"), (0.7, "LIKELY"), (0.0, "UNCERTAIN")])})


_FS = lambda m, c: f"""CASE WHEN slope_deg < 2.0 THEN 5.0 WHEN {SOIL.gamma * SOIL.depth!r}::DOUBLE * sin(radians(slope_deg)) * cos(radians(slope_deg)) > 1e-6
 THEN least(greatest(({c}::DOUBLE + ({SOIL.gamma}::DOUBLE - {m}::DOUBLE * 9.81::DOUBLE) * {SOIL.depth}::DOUBLE * cos(radians(slope_deg)) * cos(radians(slope_deg)) * tan(radians({SOIL.phi}::DOUBLE))) / ({SOIL.gamma * SOIL.depth!r}::DOUBLE * sin(radians(slope_deg)) * cos(radians(slope_deg))), 0.0), 5.0) END"""  # noqa: E731


@query("p05_factor_of_safety", f"{W} SELECT stack, row, col, round({_FS(0.0, SOIL.cohesion_dry)}, 6) AS fs_dry, round({_FS(1.0, SOIL.cohesion_wet)}, 6) AS fs_sat FROM px_pixels")
def safety(spark, sf_dir: str) -> DataFrame:
    fs = lambda c, m: P.factor_of_safety(F.col("slope_deg"), c, m, SOIL)
    return px_pixels(spark, sf_dir).select("stack", "row", "col", F.round(fs(SOIL.cohesion_dry, 0.0), 6).alias("fs_dry"), F.round(fs(SOIL.cohesion_wet, 1.0), 6).alias("fs_sat"))


@query("m05_soil_sweep", f"{W}, k AS (SELECT unnest([10.0, 18.5, 25.0])::DOUBLE AS cohesion) SELECT stack, cohesion, count(*) FILTER ({_FS(1.0, '0').replace('(0::DOUBLE', '(cohesion')} < 1.0) AS n_unstable FROM px_pixels, k GROUP BY 1, 2")
def soil_sweep(spark, sf_dir: str) -> DataFrame:
    """A table of soils crossed with the pixels."""
    px = px_pixels(spark, sf_dir).withColumn("cohesion", F.explode(F.array(*(F.lit(c) for c in (10.0, 18.5, 25.0)))))
    fs = P.factor_of_safety(F.col("slope_deg"), F.col("cohesion"), 1.0, SOIL)
    return px.groupBy("stack", "cohesion").agg(F.count_if(fs < 1.0).alias("n_unstable"))


@query("p06_hazard_class", f"{W} SELECT stack, row, col, (CASE WHEN fs_sat < 1.0 AND velocity < -15 THEN 2 WHEN fs_sat < 1.3 OR velocity < -15 THEN 1 WHEN fs_sat IS NOT NULL THEN 0 END)::INT AS hazard FROM px_pixels")
def hazard(spark, sf_dir: str) -> DataFrame:
    return px_pixels(spark, sf_dir).select("stack", "row", "col", P.hazard_class(F.col("fs_sat"), F.col("velocity")).cast("int").alias("hazard"))


KAPPA = 0.06
_M = "least(greatest(0.5::DOUBLE + 0.06::DOUBLE * (twi - avg(twi) OVER (PARTITION BY stack)), 0.0), 1.0)"


def _with_mean(px: DataFrame) -> DataFrame:
    return px.join(px.groupBy("stack").agg(F.avg("twi").alias("twi_mean")), "stack")


@query("p12_fs_at_m", f"{W}, m AS (SELECT *, {_M} AS m FROM px_pixels) SELECT stack, row, col, round(m, 6) AS m, round((1.0 - m) * fs_dry + m * fs_sat, 6) AS fs FROM m")
def fs_at_m(spark, sf_dir: str) -> DataFrame:
    """Local saturation and the safety factor there."""
    m = P.saturation_field(0.5, F.col("twi"), F.col("twi_mean"), KAPPA)
    return _with_mean(px_pixels(spark, sf_dir)).withColumn("m", m).select("stack", "row", "col", F.round("m", 6).alias("m"), F.round(P.safety_at(F.col("m"), F.col("fs_dry"), F.col("fs_sat")), 6).alias("fs"))


_MSTAR = "CASE WHEN fs_sat - fs_dry < 0 THEN least(greatest((1.0 - fs_dry) / (fs_sat - fs_dry), 0.0), 1.0) END"


@query(
    "p13_mstar",
    f"""{W}, m AS (SELECT stack, row, col, {_MSTAR} AS m_star, 0.06::DOUBLE * (twi - avg(twi) OVER (PARTITION BY stack)) AS shift FROM px_pixels)
SELECT stack, row, col, round(m_star, 6) AS m_star, round(CASE WHEN m_star IS NOT NULL THEN least(greatest(m_star - shift, 0.0), 1.0) END, 6) AS m_star_eff FROM m""",
)
def mstar(spark, sf_dir: str) -> DataFrame:
    """Critical saturation, and the mean wetness at which it is reached."""
    m = P.critical_saturation(F.col("fs_dry"), F.col("fs_sat"))
    return _with_mean(px_pixels(spark, sf_dir)).withColumn("m_star", m).select("stack", "row", "col", F.round("m_star", 6).alias("m_star"), F.round(P.effective_critical_saturation(F.col("m_star"), F.col("twi"), F.col("twi_mean"), KAPPA), 6).alias("m_star_eff"))


@query(
    "p09_suction_cohesion",
    f"""{W}, m AS (SELECT stack, row, col, slope_deg, (twi - 4.0) / 9.0 AS m FROM px_pixels),
c AS (SELECT *, 5.0::DOUBLE + CASE WHEN m <= 0 THEN 13.5 WHEN m >= 1 THEN 0.0 ELSE least(13.5::DOUBLE, pow(pow(m, {-1.0 / (1.0 - 1.0 / SUCTION.n)!r}::DOUBLE) - 1.0, {1.0 / SUCTION.n!r}::DOUBLE) / {SUCTION.alpha}::DOUBLE * m * tan(radians(36.0::DOUBLE))) END AS c FROM m)
SELECT stack, row, col, round(c, 6) AS cohesion, round(c - ((1.0 - m) * 18.5 + m * 5.0), 6) AS correction,
  round(CASE WHEN 57.0::DOUBLE * sin(radians(slope_deg)) * cos(radians(slope_deg)) > 1e-6 AND slope_deg >= 2.0 THEN 1.0 / (57.0::DOUBLE * sin(radians(slope_deg)) * cos(radians(slope_deg))) ELSE 0.0 END, 6) AS sensitivity FROM c""",
)
def suction(spark, sf_dir: str) -> DataFrame:
    """Cohesion under suction, its correction, and the safety factor's sensitivity."""
    m = (F.col("twi") - 4.0) / 9.0
    return px_pixels(spark, sf_dir).select("stack", "row", "col", F.round(P.cohesion(m, SOIL, SUCTION), 6).alias("cohesion"), F.round(P.cohesion_correction(m, SOIL, SUCTION), 6).alias("correction"), F.round(P.cohesion_sensitivity(F.col("slope_deg"), SOIL), 6).alias("sensitivity"))


@query(
    "p14_mstar_nonlinear",
    f"""{W}, k AS (SELECT i, i / 1023.0::DOUBLE AS m FROM (SELECT unnest(range(1024)) AS i)),
c AS (
  SELECT i, m, 5.0::DOUBLE + CASE WHEN m <= 0 THEN 13.5 WHEN m >= 1 THEN 0.0
    ELSE least(13.5::DOUBLE, pow(pow(m, {-1.0 / (1.0 - 1.0 / SUCTION.n)!r}::DOUBLE) - 1.0, {1.0 / SUCTION.n!r}::DOUBLE) / {SUCTION.alpha}::DOUBLE * m * tan(radians(36.0::DOUBLE))) END
    - ((1.0 - m) * 18.5 + m * 5.0) AS correction FROM k),
px AS (
  SELECT stack, row, col, fs_dry, fs_sat, CASE WHEN 57.0::DOUBLE * sin(radians(slope_deg)) * cos(radians(slope_deg)) > 1e-6 AND slope_deg >= 2.0
    THEN 1.0 / (57.0::DOUBLE * sin(radians(slope_deg)) * cos(radians(slope_deg))) ELSE 0.0 END AS s FROM px_pixels),
fs AS (SELECT stack, row, col, i, (1.0 - m) * fs_dry + m * fs_sat + correction * s AS fs FROM px, c WHERE fs_sat < fs_dry),
met AS (SELECT stack, row, col, min(i) AS i FROM fs WHERE fs < 1.0 GROUP BY ALL),
ends AS (
  SELECT met.stack, met.row, met.col, met.i, max(fs) FILTER (fs.i = met.i) AS f1, max(fs) FILTER (fs.i = met.i - 1) AS f0
  FROM met JOIN fs ON fs.stack = met.stack AND fs.row = met.row AND fs.col = met.col AND fs.i BETWEEN met.i - 1 AND met.i GROUP BY ALL)
SELECT px.stack, px.row, px.col, round(CASE WHEN fs_sat < fs_dry THEN CASE WHEN e.i IS NULL THEN 1.0 WHEN e.i = 0 THEN 0.0
  ELSE least(greatest((e.i - 1 + (1.0 - f0) / (f1 - f0)) / 1023.0::DOUBLE, 0.0), 1.0) END END, 6) AS m_star
FROM px LEFT JOIN ends e ON e.stack = px.stack AND e.row = px.row AND e.col = px.col""",
)
def mstar_suction(spark, sf_dir: str) -> DataFrame:
    """Critical saturation with suction, from 1024 points."""
    m = P.critical_saturation_suction(F.col("fs_dry"), F.col("fs_sat"), F.col("slope_deg"), SOIL, SUCTION)
    return px_pixels(spark, sf_dir).select("stack", "row", "col", F.round(m, 6).alias("m_star"))


# -- neighbourhoods ---------------------------------------------------------------------------

_AT = lambda name, dr, dc, of="px_pixels": f"LEFT JOIN {of} {name} ON {name}.stack = p.stack AND {name}.row = p.row + {dr} AND {name}.col = p.col + {dc}"
_GRAD = lambda v, before, after: f"coalesce(({after} - {before}) / 160.0, ({after} - {v}) / 80.0, ({v} - {before}) / 80.0)"
_GRADS = f"""g AS (
  SELECT p.stack, p.row, p.col, p.dem, {_GRAD("p.dem", "u.dem", "d.dem")} AS d_row, {_GRAD("p.dem", "l.dem", "r.dem")} AS d_col
  FROM px_pixels p {_AT("u", -1, 0)} {_AT("d", 1, 0)} {_AT("l", 0, -1)} {_AT("r", 0, 1)})"""
_ENDS = "ends AS (SELECT stack, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM px_pixels GROUP BY stack)"


@query("g07_slope", f"{W}, {_GRADS} SELECT stack, row, col, round(degrees(atan(sqrt(d_row * d_row + d_col * d_col))), 6) AS slope_deg FROM g")
def slope(spark, sf_dir: str) -> DataFrame:
    px = px_pixels(spark, sf_dir).select("stack", "row", "col", "dem")
    return raster.slope(px, BY, "dem", 80.0).select("stack", "row", "col", F.round("slope_deg", 6).alias("slope_deg"))


_WRAP = lambda name, axis, edge, other, step: f"LEFT JOIN px_pixels {name} ON {name}.stack = p.stack AND {name}.{'col' if axis == 'row' else 'row'} = p.{'col' if axis == 'row' else 'row'} AND {name}.{axis} = CASE WHEN p.{axis} = {edge} THEN {other} ELSE p.{axis} + {step} END"


@query(
    "g14_roughness",
    f"""{W}, {_GRADS}, {_ENDS},
second AS (
  SELECT p.stack, p.row, p.col, {_GRAD("p.d_row", "u.d_row", "d.d_row")} + {_GRAD("p.d_col", "l.d_col", "r.d_col")} AS curvature
  FROM g p {_AT("u", -1, 0, "g")} {_AT("d", 1, 0, "g")} {_AT("l", 0, -1, "g")} {_AT("r", 0, 1, "g")}),
rough AS (
  SELECT p.stack, p.row, p.col, abs(p.dem - (p.dem + a.dem + b.dem + c.dem + d.dem) / 5.0) AS roughness
  FROM px_pixels p JOIN ends ON ends.stack = p.stack
  {_WRAP("a", "row", "r0", "r1", -1)} {_WRAP("b", "row", "r1", "r0", 1)} {_WRAP("c", "col", "c0", "c1", -1)} {_WRAP("d", "col", "c1", "c0", 1)})
SELECT stack, row, col, round(curvature, 6) AS curvature, round(roughness, 6) AS roughness FROM second JOIN rough USING (stack, row, col)""",
)
def roughness(spark, sf_dir: str) -> DataFrame:
    """Curvature and roughness."""
    px = px_pixels(spark, sf_dir).select("stack", "row", "col", "dem")
    return raster.curvature_roughness(px, BY, "dem", 80.0).select("stack", "row", "col", F.round("curvature", 6).alias("curvature"), F.round("roughness", 6).alias("roughness"))


@query(
    "p24_slope_velocity",
    f"""{W}, {_GRADS}, u AS (SELECT g.*, p.velocity, p.twi, sqrt(d_row * d_row + d_col * d_col) AS t FROM g JOIN px_pixels p USING (stack, row, col)),
v AS (SELECT *, atan(t) AS s, 0.6 + twi / 100.0 AS th, 1.0::DOUBLE + twi / 50.0 AS ph FROM u),
c AS (SELECT *, CASE WHEN t > 0 THEN cos(s) * (-d_col) / t ELSE 0 END * cos(th) * cos(ph) + CASE WHEN t > 0 THEN cos(s) * d_row / t ELSE 0 END * cos(th) * sin(ph) - sin(s) * sin(th) AS c FROM v)
SELECT stack, row, col, round(c, 6) AS c, round(CASE WHEN abs(c) >= 0.3 AND degrees(s) >= 5.0 THEN velocity / c END, 6) AS v_slope FROM c""",
)
def v_slope(spark, sf_dir: str) -> DataFrame:
    """Velocity down the slope where the line of sight sees it."""
    g = raster.gradients(px_pixels(spark, sf_dir).select("stack", "row", "col", "dem", "velocity", "twi"), BY, "dem", 80.0)
    down, los = P.downslope_unit(F.col("d_row"), F.col("d_col")), P.los_unit(0.6 + F.col("twi") / 100.0, 1.0 + F.col("twi") / 50.0)
    g = g.withColumn("c", down[0] * los[0] + down[1] * los[1] + down[2] * los[2])
    s = F.degrees(F.atan(F.hypot("d_row", "d_col")))
    return g.select("stack", "row", "col", F.round("c", 6).alias("c"), F.round(P.slope_velocity(F.col("velocity"), F.col("c"), s, least_slope=5.0), 6).alias("v_slope"))


_KERNEL = raster.gaussian_weights(2.0)


@query(
    "g06_highpass",
    f"""{W}, {_ENDS}, k AS (SELECT unnest(range({-(len(_KERNEL) // 2)}, {len(_KERNEL) // 2 + 1})) AS o, unnest({_KERNEL}::DOUBLE[]) AS w),
v AS (SELECT stack, row, col, CASE WHEN coh IS NOT NULL THEN velocity END AS velocity FROM px_pixels),
lattice AS (SELECT stack, r.row, c.col, r0, r1, c0, c1 FROM ends, unnest(generate_series(r0, r1)) AS r(row), unnest(generate_series(c0, c1)) AS c(col)),
x AS (SELECT s.*, coalesce(velocity, 0.0) AS n, CASE WHEN velocity IS NULL THEN 0.0 ELSE 1.0 END AS d FROM lattice s LEFT JOIN v USING (stack, row, col)),
p1 AS (
  SELECT x.stack, x.row, x.col, x.c0, x.c1, sum(w * y.n) AS n, sum(w * y.d) AS d
  FROM x, k, x y WHERE y.stack = x.stack AND y.col = x.col AND y.row = least(greatest(x.row + o, x.r0), x.r1) GROUP BY ALL),
p2 AS (
  SELECT x.stack, x.row, x.col, sum(w * y.n) AS n, sum(w * y.d) AS d
  FROM p1 x, k, p1 y WHERE y.stack = x.stack AND y.row = x.row AND y.col = least(greatest(x.col + o, x.c0), x.c1) GROUP BY ALL)
SELECT stack, row, col, round(CASE WHEN d > 1e-3 THEN n / d END, 6) AS low, round(velocity - CASE WHEN d > 1e-3 THEN n / d END, 6) AS highpass
FROM v JOIN p2 USING (stack, row, col)""",
)
def highpass(spark, sf_dir: str) -> DataFrame:
    """Velocities less their smoothed field."""
    px = px_pixels(spark, sf_dir).select("stack", "row", "col", F.when(F.col("coh").isNotNull(), F.col("velocity")).alias("velocity"))
    return raster.gaussian_highpass(px, BY, "velocity", 2.0).select("stack", "row", "col", F.round("low", 6).alias("low"), F.round("highpass", 6).alias("highpass"))


@query("a12_max_mosaic", f"{W}, h AS (SELECT row, col, (CASE WHEN fs_sat < 1.0 AND velocity < -15 THEN 2 WHEN fs_sat < 1.3 OR velocity < -15 THEN 1 WHEN fs_sat IS NOT NULL THEN 0 END)::INT AS hazard FROM px_pixels) SELECT row, col, max(hazard) AS hazard, count(*) FILTER (hazard = 2) AS n_high, count(hazard) AS n_looks FROM h GROUP BY 1, 2")
def mosaic(spark, sf_dir: str) -> DataFrame:
    """The largest class over all looks."""
    return raster.max_mosaic(hazard(spark, sf_dir), ["row", "col"], "hazard")


@query("j13_resample_mean", f"{W} SELECT stack, (row // 4)::INT AS row2, (col // 4)::INT AS col2, round(avg(dem), 6) AS dem FROM px_pixels GROUP BY 1, 2, 3")
def resample(spark, sf_dir: str) -> DataFrame:
    """The mean of blocks."""
    return raster.resample_mean(px_pixels(spark, sf_dir), 4, BY, "dem").withColumns(r6("dem"))


@query("s03_decimated", f"{W} SELECT stack, row, col, round(dem, 6) AS dem FROM px_pixels WHERE row % 5 = 2 AND col % 5 = 2 AND row BETWEEN 10 AND 49 AND col BETWEEN 5 AND 44")
def coarse(spark, sf_dir: str) -> DataFrame:
    """A window of the grid at every fifth pixel."""
    return raster.decimated(raster.block(px_pixels(spark, sf_dir), 10, 5, 40, 40), 5, 2).select("stack", "row", "col", F.round("dem", 6).alias("dem"))


@query("a17_iou", f"{W}, m AS (SELECT stack, coalesce(fs_sat < 1.0, false) AS a, coalesce(velocity < -15, false) AS b FROM px_pixels) SELECT stack, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a OR b) AS n_any, round(count(*) FILTER (a AND b)::DOUBLE / count(*) FILTER (a OR b), 6) AS iou FROM m GROUP BY stack")
def iou(spark, sf_dir: str) -> DataFrame:
    return audit.overlap(px_pixels(spark, sf_dir), BY, F.col("fs_sat") < 1.0, F.col("velocity") < -15).withColumns(r6("iou"))


@query("a28_low_tail", f"{W}, s AS (SELECT stack, avg(velocity) - 20.0 AS scar FROM px_pixels GROUP BY stack) SELECT p.stack, count(*) AS n_pixels, round(median(velocity), 6) AS median, round(quantile_cont(velocity, 0.05), 6) AS p05, round(avg(CASE WHEN velocity < -50.0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_strong_loss, round(avg(CASE WHEN velocity < scar THEN 1.0 ELSE 0.0 END) * 100, 6) AS scar_percentile FROM px_pixels p JOIN s ON p.stack = s.stack GROUP BY p.stack")
def tail(spark, sf_dir: str) -> DataFrame:
    """A28, M29."""
    px = px_pixels(spark, sf_dir)
    px = px.join(px.groupBy("stack").agg((F.avg("velocity") - 20.0).alias("scar")), "stack")
    return audit.low_tail(px, BY, "velocity", "scar", -50.0).withColumns(r6("median", "p05", "pct_strong_loss", "scar_percentile"))


@query("a30_method_comparison", f"{W}, s AS (SELECT stack, count(*) AS n, stddev_pop(dem) AS std_a, stddev_pop(velocity) AS std_b, covar_pop(dem, velocity) AS c, stddev_pop(dem - velocity) AS rms FROM px_pixels WHERE coh IS NOT NULL GROUP BY stack) SELECT stack, n, round(std_a, 6) AS std_a, round(std_b, 6) AS std_b, round((1 - std_b / std_a) * 100, 6) AS reduction_pct, round(c / (std_a * std_b), 6) AS r, round(rms, 6) AS rms FROM s")
def comparison(spark, sf_dir: str) -> DataFrame:
    """A30, M24, M25."""
    return audit.method_comparison(px_pixels(spark, sf_dir).filter("coh is not null"), BY, "dem", "velocity").withColumns(r6("std_a", "std_b", "reduction_pct", "r", "rms"))


@query("a29_strata", f"{W} SELECT stack, CASE WHEN coh < 0.35 THEN 'low' WHEN coh < 0.7 THEN 'mid' ELSE 'high' END AS stratum, count(*) AS n, round(median(twi), 6) AS median_l, round(avg(CASE WHEN twi < 8.0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS failure_pct FROM px_pixels WHERE coh IS NOT NULL GROUP BY 1, 2")
def strata(spark, sf_dir: str) -> DataFrame:
    """One band's values by strata of another's coherence."""
    s = F.when(F.col("coh") < 0.35, "low").when(F.col("coh") < 0.7, "mid").otherwise("high")
    return px_pixels(spark, sf_dir).filter("coh is not null").groupBy("stack", s.alias("stratum")).agg(F.count("*").alias("n"), F.round(F.median("twi"), 6).alias("median_l"), F.round(F.avg(F.when(F.col("twi") < 8.0, 1.0).otherwise(0.0)) * 100, 6).alias("failure_pct"))


@query("a33_distinct_patterns", f"{W} SELECT stack, count(DISTINCT ((coh IS NULL)::INT * 10 + (fs_sat < 1)::INT)) AS n_patterns, count(DISTINCT row // 10 * 100 + col // 10) AS n_cells, min(n) AS least_n FROM px_pixels GROUP BY stack")
def distinct(spark, sf_dir: str) -> DataFrame:
    """Numbers of different patterns and cells."""
    pattern = F.col("coh").isNull().cast("int") * 10 + (F.col("fs_sat") < 1).cast("int")
    return px_pixels(spark, sf_dir).groupBy("stack").agg(F.count_distinct(pattern).alias("n_patterns"), F.count_distinct(F.floor(F.col("row") / 10) * 100 + F.floor(F.col("col") / 10)).alias("n_cells"), F.min("n").alias("least_n"))


@query(
    "a22_plane_fit",
    f"""{W}, s AS (SELECT stack, count(*) AS n, avg(col) AS mx, avg(row) AS my, avg(dem) AS mz, var_pop(col) AS xx, var_pop(row) AS yy, covar_pop(col, row) AS xy, covar_pop(col, dem) AS xz, covar_pop(row, dem) AS yz FROM px_pixels GROUP BY stack),
p AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM s)
SELECT stack, n, round(a, 6) AS a, round(b, 6) AS b, round(mz - a * mx - b * my, 5) AS c FROM p""",
)
def planes(spark, sf_dir: str) -> DataFrame:
    """The plane through each stack's heights."""
    return inversion.fit_planes(px_pixels(spark, sf_dir), BY, "dem").withColumns(r6("a", "b") | {"c": F.round("c", 5)})


@query(
    "g15_reference_pixel",
    f"""{W}, mid AS (SELECT stack, (min(row) + max(row)) / 2.0 AS r, (min(col) + max(col)) / 2.0 AS c FROM px_pixels GROUP BY stack),
sc AS (SELECT p.stack, row, col, abs(velocity) / 100.0 + 0.5 * sqrt((row - r) * (row - r) + (col - c) * (col - c)) / 60 AS score FROM px_pixels p JOIN mid ON mid.stack = p.stack),
k AS (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY score, row, col) AS k FROM sc) SELECT stack, row, col, round(score, 6) AS score FROM k WHERE k = 1""",
)
def reference(spark, sf_dir: str) -> DataFrame:
    """The quietest pixel near the middle."""
    return raster.reference_pixel(px_pixels(spark, sf_dir), BY, F.abs("velocity") / 100.0, 60).withColumns(r6("score"))


# -- zones ------------------------------------------------------------------------------------

_ON = "fs_sat < 1.0 AND velocity < -15.0"
#: Components by SQL: reachability over pixels that touch by their sides.
_ZONES = f"""px0 AS (SELECT * FROM px_pixels WHERE {_ON}), edge AS (
  SELECT a.stack, a.row::BIGINT * 1000000000 + a.col AS a, b.row::BIGINT * 1000000000 + b.col AS b FROM px0 a JOIN px0 b ON a.stack = b.stack AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
reach(stack, a, b) AS (SELECT stack, row::BIGINT * 1000000000 + col, row::BIGINT * 1000000000 + col FROM px0 UNION SELECT r.stack, r.a, e.b FROM reach r JOIN edge e ON e.stack = r.stack AND e.a = r.b),
lab AS (SELECT stack, a, min(b) AS zone FROM reach GROUP BY 1, 2),
zpx AS (SELECT p.*, l.zone FROM px0 p JOIN lab l ON p.stack = l.stack AND p.row::BIGINT * 1000000000 + p.col = l.a),
big AS (SELECT stack, zone FROM zpx GROUP BY 1, 2 HAVING count(*) >= 3)"""
_W = W.replace("WITH", "WITH RECURSIVE", 1)


def zone_pixels(spark, sf_dir: str) -> DataFrame:
    mask = P.unstable(F.col("fs_sat")) & P.creeping(F.col("velocity"))
    return raster.label_zones(px_pixels(spark, sf_dir), BY, mask)


@query("g04_zones", f"{_W}, {_ZONES} SELECT stack, row, col, zone FROM zpx SEMI JOIN big USING (stack, zone)")
def labelled(spark, sf_dir: str) -> DataFrame:
    """Pixels that are unstable and creep, joined to zones by their sides."""
    return zone_pixels(spark, sf_dir).select("stack", "row", "col", "zone")


_DESCRIBED = f"""{_ZONES}, desc1 AS (
  SELECT stack, zone, count(*) AS n_pixels, avg(row) AS centre_row, avg(col) AS centre_col, avg(velocity) AS mean_velocity, min(velocity) AS max_velocity, avg(fs_sat) AS mean_fs, avg(slope_deg) AS mean_slope FROM zpx SEMI JOIN big USING (stack, zone) GROUP BY 1, 2)"""


@query(
    "a09_zone_describe",
    f"""{_W}, {_DESCRIBED} SELECT stack, zone, n_pixels, round(centre_row, 6) AS centre_row, round(centre_col, 6) AS centre_col, round(mean_velocity, 6) AS mean_velocity, round(max_velocity, 6) AS max_velocity, round(mean_fs, 6) AS mean_fs,
round(mean_slope, 6) AS mean_slope, round(n_pixels * 0.0064::DOUBLE, 6) AS area_km2, CASE WHEN mean_velocity <= -50 OR mean_fs <= 0.7 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, row_number() OVER (PARTITION BY stack ORDER BY round(mean_velocity, 6), zone)::INT AS id FROM desc1""",
)
def described(spark, sf_dir: str) -> DataFrame:
    """Each zone described, numbered by its motion."""
    from pyspark.sql import Window

    z = zones.describe(zone_pixels(spark, sf_dir).withColumn("fs", F.col("fs_sat")), BY, 80.0)
    z = z.withColumns(r6("centre_row", "centre_col", "mean_velocity", "max_velocity", "mean_fs", "mean_slope", "area_km2"))
    z = z.withColumn("id", F.row_number().over(Window.partitionBy("stack").orderBy("mean_velocity", "zone")))
    return z.select("stack", "zone", "n_pixels", "centre_row", "centre_col", "mean_velocity", "max_velocity", "mean_fs", "mean_slope", "area_km2", "severity", "id")


@query("a32_scenario_summary", f"{_W}, {_DESCRIBED} SELECT stack, count(*) AS n_zones, count(*) FILTER (mean_velocity <= -50 OR mean_fs <= 0.7) AS n_critical, round(sum(n_pixels) * 0.0064::DOUBLE, 6) AS area_km2 FROM desc1 GROUP BY stack")
def scenario(spark, sf_dir: str) -> DataFrame:
    """What a scenario's payload sums up."""
    z = described(spark, sf_dir)
    return z.groupBy("stack").agg(F.count("*").alias("n_zones"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.round(F.sum("n_pixels") * 0.0064, 6).alias("area_km2"))


@query(
    "g10_valley_flag",
    f"""{_W}, {_ZONES}, z AS (SELECT stack, zone, count(*) AS n_pixels, avg(slope_deg) AS slope, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM zpx SEMI JOIN big USING (stack, zone) GROUP BY 1, 2),
cut AS (SELECT stack, quantile_cont(twi, 0.9) AS q FROM px_pixels GROUP BY stack), va AS (SELECT p.stack, row, col FROM px_pixels p JOIN cut ON cut.stack = p.stack WHERE twi >= q)
SELECT stack, zone, n_pixels, slope > 25 AND n_pixels > 4 AND EXISTS (SELECT 1 FROM va WHERE va.stack = z.stack AND va.row BETWEEN r0 - 5 AND r1 + 5 AND va.col BETWEEN c0 - 5 AND c1 + 5) AS llof_potential FROM z""",
)
def valley(spark, sf_dir: str) -> DataFrame:
    """Zones with a valley near them."""
    px = px_pixels(spark, sf_dir)
    z = zones.describe(zone_pixels(spark, sf_dir).withColumn("fs", F.col("fs_sat")), BY, 80.0)
    return zones.valley_flag(z, px, BY).select("stack", "zone", "n_pixels", "llof_potential")


@query(
    "m02_hazard_timeline",
    f"""{_W}, ms AS (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS m), t0 AS (SELECT stack, m, row, col, row::BIGINT * 1000000000 + col AS k FROM px_pixels, ms WHERE (1.0 - m) * fs_dry + m * fs_sat < 1.0 AND velocity < -15.0),
te AS (SELECT a.stack, a.m, a.k AS a, b.k AS b FROM t0 a JOIN t0 b ON a.stack = b.stack AND a.m = b.m AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
tr(stack, m, a, b) AS (SELECT stack, m, k, k FROM t0 UNION SELECT r.stack, r.m, r.a, e.b FROM tr r JOIN te e ON e.stack = r.stack AND e.m = r.m AND e.a = r.b),
tl AS (SELECT stack, m, a, min(b) AS zone FROM tr GROUP BY 1, 2, 3), tz AS (SELECT stack, m, zone, count(*) AS n FROM tl GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT stack, m, count(*) AS n_zones, round(sum(n) * 0.0064::DOUBLE, 6) AS area_km2 FROM tz GROUP BY 1, 2""",
)
def timeline(spark, sf_dir: str) -> DataFrame:
    """Zones and area at each of several saturations, all in one pass."""
    px = px_pixels(spark, sf_dir).withColumn("m", F.explode(F.array(*(F.lit(m) for m in (0.25, 0.5, 0.75, 1.0)))))
    mask = P.unstable(P.safety_at(F.col("m"), F.col("fs_dry"), F.col("fs_sat"))) & P.creeping(F.col("velocity"))
    z = raster.label_zones(px, ["stack", "m"], mask)
    return z.groupBy("stack", "m").agg(F.count_distinct("zone").alias("n_zones"), F.round(F.count("*") * 0.0064, 6).alias("area_km2"))


_STEPS = " UNION ALL ".join(f"SELECT {i} AS i, {r} AS dr, {c} AS dc, {'1.0' if r == 0 or c == 0 else 'sqrt(2.0)'}::DOUBLE AS d" for i, (r, c) in enumerate(raster.EIGHT))


@query(
    "g05_flow_accumulation",
    f"""{_W}, st AS ({_STEPS}),
dr AS MATERIALIZED (SELECT a.stack, a.row, a.col, b.row AS to_row, b.col AS to_col, row_number() OVER (PARTITION BY a.stack, a.row, a.col ORDER BY (a.dem - b.dem) / d DESC, i) AS k
  FROM px_pixels a, st JOIN px_pixels b ON b.stack = a.stack AND b.row = a.row + dr AND b.col = a.col + dc WHERE a.dem > b.dem),
rv AS MATERIALIZED (SELECT * FROM dr WHERE k = 1),
walk(stack, tr, tc) AS (SELECT stack, row, col FROM px_pixels UNION ALL SELECT w.stack, r.to_row, r.to_col FROM walk w JOIN rv r ON r.stack = w.stack AND r.row = w.tr AND r.col = w.tc)
SELECT stack, tr AS row, tc AS col, count(*) AS accum FROM walk GROUP BY 1, 2, 3""",
)
def flow(spark, sf_dir: str) -> DataFrame:
    """Cells drained through each cell."""
    return raster.flow_accumulation(px_pixels(spark, sf_dir), BY, "dem")


_RUNOUT = f"""{W}, s AS (SELECT stack, row AS sr, col AS sc, dem AS sz FROM px_pixels WHERE slope_deg > 48.0),
a AS (
  SELECT p.stack, p.row, p.col, max((sz - dem) / greatest(sqrt((p.row - sr) * (p.row - sr) + (p.col - sc) * (p.col - sc)) * 80.0, 80.0)) AS t
  FROM px_pixels p JOIN s ON s.stack = p.stack GROUP BY 1, 2, 3),
runout AS (
  SELECT p.stack, p.row, p.col, round(degrees(atan(t)), 6) AS angle_deg,
         CASE WHEN t IS NULL THEN 'OUTSIDE' WHEN degrees(atan(t)) >= 10 THEN 'NEAR' WHEN degrees(atan(t)) >= 3 THEN 'FAR' ELSE 'CLEAR' END AS band
  FROM px_pixels p LEFT JOIN a ON a.stack = p.stack AND a.row = p.row AND a.col = p.col)"""


@query("g09_reach_angle", f"{_RUNOUT} SELECT * FROM runout")
def runout(spark, sf_dir: str) -> DataFrame:
    """The steepest line from any source of the stack, however far, and its band."""
    px = px_pixels(spark, sf_dir).select("stack", "row", "col", "dem", "slope_deg")
    out = raster.reach_angle(px, px.filter("slope_deg > 48.0"), BY, "dem", 80.0, None)
    a = F.col("angle_deg")
    band = F.when(a.isNull(), "OUTSIDE").when(a >= 10, "NEAR").when(a >= 3, "FAR").otherwise("CLEAR")
    return out.select("stack", "row", "col", F.round(a, 6).alias("angle_deg"), band.alias("band"))
