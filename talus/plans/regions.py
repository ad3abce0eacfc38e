"""Queries between polygons, grids and places: masks, zonal series, distances, areas, common grids, projections, sampled controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import geo
from talus.functions import rain as R
from talus.operators import areas, exposure, grids, validation
from talus.operators import rain as O
from talus.operators.grids import Grid
from talus.plans.pixels import W
from talus.plans.places import _DENSE, _LEFT, _read, _route
from talus.plans.rain import _WATER, BY, A, B
from talus.plans.registry import query, r6
from talus.sources.proxies import PX_DAILY, PX_PIXELS, PX_ZONES, SITES, px_daily, px_pixels, px_zones
from talus.sources.storage import stored
from talus.sources.windows import missing_windows

#: The degree that pixels, places and zones share, as 60 rows (downwards) and 50 columns.
DEGREE = Grid(75.0, 34.0, 0.02, -1.0 / 60.0, 60, 50)

# -- regions ----------------------------------------------------------------------------------


def _regions(spark, sf_dir: str) -> DataFrame:
    """A concave region for each supplier; those in debt have one that is smaller than a pixel."""
    s = F.col("s_suppkey")
    size = F.when(F.col("s_acctbal") < 0, 0.05).otherwise(1.0)
    x, y = ((s * 6007) % 887).cast("double") / 887.0 + 75.0, ((s * 7013) % 883).cast("double") / 883.0 + 33.0
    at = lambda a, b: F.struct((x + a * size).alias("lon"), (y + b * size).alias("lat"))
    vertices = F.array(at(0.0, 0.0), at(0.18, 0.0), at(0.18, 0.18), at(0.09, 0.05), at(0.0, 0.18))
    return _read(spark, sf_dir, "supplier").select(s.alias("region"), F.col("s_nationkey").alias("district"), F.lit(0).alias("ring"), vertices.alias("vertices"))


_REGION = """rg AS (
  SELECT s_suppkey AS region, s_nationkey AS district, CASE WHEN s_acctbal < 0 THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END AS size,
         ((s_suppkey * 6007) % 887)::DOUBLE / 887.0 + 75.0 AS x, ((s_suppkey * 7013) % 883)::DOUBLE / 883.0 + 33.0 AS y FROM supplier),
vx AS (
  SELECT region, district, unnest(range(5)) AS i, x + unnest([0.0, 0.18, 0.18, 0.09, 0.0]::DOUBLE[]) * size AS lon,
         y + unnest([0.0, 0.0, 0.18, 0.05, 0.18]::DOUBLE[]) * size AS lat FROM rg),
ed AS (
  SELECT a.region, a.district, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM vx a JOIN vx b ON b.region = a.region AND b.i = (a.i + 1) % 5)"""
_CELLS = """cl AS (
  SELECT row::INT AS row, col::INT AS col, 75.0::DOUBLE + (col + 0.5::DOUBLE) * 0.02::DOUBLE AS lon, 34.0::DOUBLE + (row + 0.5::DOUBLE) * (-1.0::DOUBLE / 60.0::DOUBLE) AS lat
  FROM (SELECT unnest(range(60)) AS row), (SELECT unnest(range(50)) AS col))"""
_MASK = f"""{_REGION}, {_CELLS},
held AS (SELECT region, row, col FROM cl, ed WHERE {_LEFT} GROUP BY ALL HAVING count(*) % 2 = 1),
middle AS (
  SELECT region, floor((avg(lat) - 34.0::DOUBLE) / (-1.0::DOUBLE / 60.0::DOUBLE))::INT AS row, floor((avg(lon) - 75.0::DOUBLE) / 0.02::DOUBLE)::INT AS col FROM vx GROUP BY region),
mask AS (
  SELECT * FROM held UNION ALL SELECT * FROM middle WHERE region NOT IN (SELECT region FROM held) AND row BETWEEN 0 AND 59 AND col BETWEEN 0 AND 49)"""


def _mask(spark, sf_dir: str) -> DataFrame:
    rings = _regions(spark, sf_dir)
    return grids.polygon_mask(rings, exposure.polygon_edges(rings, ["region"]), ["region"], "ring", DEGREE)


@query("f05_polygon_mask", f"WITH {_MASK} SELECT region, row, col FROM mask")
def polygon_mask(spark, sf_dir: str) -> DataFrame:
    """The cells of each polygon by scanlines; small ones have the cell of their middle."""
    return _mask(spark, sf_dir)


_CUBE = """cu AS (
  SELECT l_returnflag AS stack, year(l_shipdate) * 10 + quarter(l_shipdate) AS epoch, (l_orderkey % 60)::INT AS row, (l_partkey % 50)::INT AS col,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS p FROM lineitem GROUP BY 1, 2, 3, 4),
cube AS (SELECT stack, epoch, row, col, CASE WHEN p % 5 <> 0 THEN 0.2::DOUBLE + 0.8::DOUBLE * ((p % 997)::DOUBLE / 997.0::DOUBLE) END AS coh FROM cu)"""


def _cube(spark, sf_dir: str) -> DataFrame:
    """Coherence of each stack, quarter and cell."""
    epoch = (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).cast("long")
    cells = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("stack"), epoch.alias("epoch"), (F.col("l_orderkey") % 60).cast("int").alias("row"), (F.col("l_partkey") % 50).cast("int").alias("col"))
    p = cells.agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"))
    return p.select("stack", "epoch", "row", "col", F.when(F.col("p") % 5 != 0, 0.2 + 0.8 * ((F.col("p") % 997).cast("double") / 997.0)).alias("coh"))


@query(
    "j21_zonal_series",
    f"""WITH {_MASK}, {_CUBE}, whole AS (SELECT stack, epoch, avg(coh) AS w FROM cube GROUP BY ALL), n AS (SELECT region, count(*) AS n_cells FROM mask GROUP BY region),
s AS (
  SELECT m.region, c.stack, c.epoch, count(coh) AS n_valid, avg(coh) AS mean FROM mask m JOIN cube c ON c.row = m.row AND c.col = m.col GROUP BY ALL),
v AS (
  SELECT s.region, s.stack, s.epoch, n_cells, n_valid / n_cells AS share, CASE WHEN n_valid / n_cells >= 0.5 THEN mean END AS coh, w
  FROM s JOIN n ON n.region = s.region JOIN whole ON whole.stack = s.stack AND whole.epoch = s.epoch)
SELECT region, stack, epoch::BIGINT AS epoch, n_cells, round(share, 6) AS valid_share, round(coh, 6) AS coh, round(coh - w, 6) AS relative FROM v""",
)
def zonal(spark, sf_dir: str) -> DataFrame:
    """Mean coherence of each polygon, stack and quarter, and how it lies against the whole layer."""
    out = grids.zonal_series(_mask(spark, sf_dir), _cube(spark, sf_dir), ["region"], ["stack", "epoch"], "coh")
    return out.withColumns(r6("valid_share", "coh", "relative"))


# -- distances and zones over levels --------------------------------------------------------------

_CREEPS = "fs_sat < 0.7 AND velocity < -50.0"


@query(
    "g08_distance_transform",
    f"""{W}, flagged AS (SELECT stack, row AS fr, col AS fc FROM px_pixels WHERE {_CREEPS}),
d AS (SELECT p.stack, p.row, p.col, min((p.row - fr) * (p.row - fr) + (p.col - fc) * (p.col - fc)) AS s FROM px_pixels p JOIN flagged f ON f.stack = p.stack GROUP BY ALL)
SELECT p.stack, p.row, p.col, round(sqrt(s) * 80.0::DOUBLE, 6) AS distance_m FROM px_pixels p LEFT JOIN d USING (stack, row, col)""",
)
def distances(spark, sf_dir: str) -> DataFrame:
    """Metres from each pixel to the nearest one of its stack that is unstable and moves fast; null in stacks without."""
    px = px_pixels(spark, sf_dir)
    out = grids.distance_transform(px.select("stack", "row", "col", "fs_sat", "velocity"), ["stack"], F.expr(_CREEPS))
    return out.select("stack", "row", "col", F.round(F.sqrt("square") * 80.0, 6).alias("distance_m"))


_WAY_STACKS = """sk AS (SELECT stack, row_number() OVER (ORDER BY stack) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT stack FROM px_pixels))"""


@query(
    "w10_islands",
    f"""{W}, {_WAY_STACKS}, {_DENSE},
flagged AS (SELECT stack, row AS fr, col AS fc FROM px_pixels WHERE {_CREEPS}),
sm AS (SELECT way, seq, stack, floor(y * 60 / 1000)::INT AS row, floor(x / 20)::INT AS col FROM smp JOIN sk ON sk.i = way % sk.n),
near AS (SELECT stack, row, col, min((row - fr) * (row - fr) + (col - fc) * (col - fc)) AS s FROM (SELECT DISTINCT stack, row, col FROM sm) JOIN flagged USING (stack) GROUP BY ALL),
c AS (SELECT way, seq, s, CASE WHEN s = 0 THEN 'CORE' WHEN s <= 9 THEN 'WATCH' ELSE 'CLEAR' END AS cls FROM sm LEFT JOIN near USING (stack, row, col)),
f AS (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY way ORDER BY seq) = cls THEN 0 ELSE 1 END AS ch FROM c),
g AS (SELECT *, sum(ch) OVER (PARTITION BY way ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM f)
SELECT way, segment, cls, min(seq) AS start, count(*) AS n_samples, count(*) * 100.0::DOUBLE AS length_m, round(min(sqrt(s) * 80.0::DOUBLE), 6) AS nearest_m FROM g WHERE cls <> 'CLEAR' GROUP BY 1, 2, 3""",
)
def islands(spark, sf_dir: str) -> DataFrame:
    """Stretches of one class along routes, by their distance to unstable pixels of the stack that a route crosses."""
    px = px_pixels(spark, sf_dir).select("stack", "row", "col", "fs_sat", "velocity")
    away = grids.distance_transform(px, ["stack"], F.expr(_CREEPS), every=True)
    names = [r["stack"] for r in px.select("stack").distinct().orderBy("stack").collect()]  # as many as stacks
    of = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "_i long, stack string")
    samples = exposure.densify(_route(spark, sf_dir), ["way"], "seq0", 100.0)
    cell = {"_i": F.col("way") % max(len(names), 1), "row": F.floor(F.col("y") * 60 / 1000).cast("int"), "col": F.floor(F.col("x") / 20).cast("int")}
    met = samples.withColumns(cell).join(of, "_i").join(away, ["stack", "row", "col"], "left")
    met = met.withColumn("cls", F.when(F.col("square") == 0, "CORE").when(F.col("square") <= 9, "WATCH").otherwise("CLEAR"))
    return exposure.segments(met, ["way"], "seq", "cls", 100.0, keep={"nearest_m": F.round(F.min(F.sqrt("square") * 80.0), 6)})


# -- areas and common grids -------------------------------------------------------------------

def utm_sql(lon: str, lat: str, zone: int, of: str, keep: str) -> str:
    """SQL for `keep`, e, n: easting and northing in a zone, from the rows of `of`."""
    e, a = 0.00669438, 6378137.0
    ep = e / (1 - e)
    return f"""SELECT {keep},
       0.9996::DOUBLE * n * (d + (1 - t + c) * pow(d, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {ep!r}::DOUBLE) * pow(d, 5) / 120) + 500000.0::DOUBLE AS e,
       0.9996::DOUBLE * (m + n * sqrt(t) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * pow(d, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {ep!r}::DOUBLE) * pow(d, 6) / 720)) AS n
FROM (
  SELECT {keep}, {a}::DOUBLE / sqrt(1 - {e}::DOUBLE * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t, {ep!r}::DOUBLE * cos(p) * cos(p) AS c, (l - radians({zone * 6 - 183}::DOUBLE)) * cos(p) AS d,
         {a}::DOUBLE * ({1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256!r}::DOUBLE * p - {3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024!r}::DOUBLE * sin(2 * p)
           + {15 * e**2 / 256 + 45 * e**3 / 1024!r}::DOUBLE * sin(4 * p) - {35 * e**3 / 3072!r}::DOUBLE * sin(6 * p)) AS m
  FROM (SELECT {keep}, radians({lat}) AS p, radians({lon}) AS l FROM {of}))"""


_UTM43 = lambda lon, lat: geo.lonlat_to_utm(lon, lat, 43)


@query(
    "s34_area_union",
    f"""WITH {_REGION}, un AS ({utm_sql("lon", "lat", 43, "vx", "region, district, i")}),
e0 AS (SELECT a.region, a.district, a.i, a.e AS x1, a.n AS y1, b.e AS x2, b.n AS y2 FROM un a JOIN un b ON b.region = a.region AND b.i = (a.i + 1) % 5),
ts AS (
  SELECT a.region, a.i, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0) AS t,
         ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0) AS u
  FROM e0 a JOIN e0 b ON b.district = a.district AND b.region <> a.region),
cut AS (SELECT region, i, t FROM ts WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 UNION SELECT region, i, 0.0 FROM e0 UNION SELECT region, i, 1.0 FROM e0),
pc AS (SELECT region, i, t, lead(t) OVER (PARTITION BY region, i ORDER BY t) AS t2 FROM cut),
ps AS (
  SELECT e0.region, district, row_number() OVER () AS k, x1 + (x2 - x1) * t AS ax, y1 + (y2 - y1) * t AS ay, x1 + (x2 - x1) * t2 AS cx, y1 + (y2 - y1) * t2 AS cy,
         x1 + (x2 - x1) * ((t + t2) / 2) AS lon, y1 + (y2 - y1) * ((t + t2) / 2) AS lat
  FROM pc JOIN e0 ON e0.region = pc.region AND e0.i = pc.i WHERE t2 IS NOT NULL),
hits AS (SELECT ps.k, o.region FROM ps JOIN e0 o ON o.district = ps.district AND o.region <> ps.region WHERE {_LEFT} GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT district, round(sum(ax * cy - cx * ay) / 2e6, 4) AS area_km2, round(sum(sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay))) / 1e3, 4) AS length_km
FROM ps WHERE k NOT IN (SELECT k FROM hits) GROUP BY district""",
)
def area_union(spark, sf_dir: str) -> DataFrame:
    """The regions of each district as one area, in square kilometres of its projection."""
    rings = areas.projected(_regions(spark, sf_dir), ["district", "region"], _UTM43)
    out = areas.enclosed_area(areas.union_boundary(rings, ["district"], "region", 20_000.0), ["district"])
    return out.select("district", F.round(F.col("area") / 1e6, 4).alias("area_km2"), F.round(F.col("length") / 1e3, 4).alias("length_km"))


@query(
    "g13_common_grid",
    f"""WITH {_REGION}, un AS ({utm_sql("lon", "lat", 43, "vx", "region")}),
ar AS (SELECT region AS stack, min(e) - 2000 AS minx, min(n) - 2000 AS miny, max(e) + 2000 AS maxx, max(n) + 2000 AS maxy FROM un GROUP BY region),
g AS (
  SELECT l_suppkey AS stack, l_orderkey * 10 + l_linenumber AS product, 500000.0::DOUBLE + 80 * (l_orderkey % 200) + CASE WHEN l_discount >= 0.095 THEN 30 ELSE 0 END AS "left",
         3763000.0::DOUBLE - 80 * (l_partkey % 200) AS top, CASE WHEN l_quantity >= 50 AND l_tax < 0.005 AND l_discount < 0.005 THEN 40.0::DOUBLE ELSE 80.0::DOUBLE END AS res FROM lineitem),
g2 AS (SELECT *, "left" + 1000 * 80.0 AS "right", top - 1300 * 80.0 AS bottom FROM g),
f AS (SELECT stack, min_by({{'l': "left", 't': top, 'r': res}}, product) AS f, max("left") AS l, min(top) AS t, min("right") AS r, max(bottom) AS b, count(DISTINCT res) AS kinds FROM g2 GROUP BY stack),
c AS (
  SELECT f.stack, f.f, kinds, greatest(l, minx) AS l, least(r, maxx) AS r, least(t, maxy) AS t, greatest(b, miny) AS b FROM f JOIN ar ON ar.stack = f.stack),
s AS (SELECT *, f.l + round_even((l - f.l) / f.r, 0) * f.r AS gl, f.t + round_even((t - f.t) / f.r, 0) * f.r AS gt FROM c),
o AS (
  SELECT g2.stack, product, kinds, s.l, s.r, s.t, s.b, gl, gt, f.r AS cell, (gl - g2."left") / f.r AS co, (g2.top - gt) / f.r AS ro FROM g2 JOIN s ON s.stack = g2.stack),
st AS (
  SELECT *, CASE WHEN kinds > 1 THEN 'mixed' WHEN r <= l OR t <= b THEN 'apart' WHEN greatest(abs(co - round_even(co, 0)), abs(ro - round_even(ro, 0))) > 1e-3 THEN 'misaligned' ELSE 'ok' END AS status FROM o)
SELECT stack, product, status, CASE WHEN status = 'ok' THEN gl END AS grid_left, CASE WHEN status = 'ok' THEN gt END AS grid_top,
       CASE WHEN status = 'ok' THEN round_even((r - gl) / cell, 0)::INT END AS width, CASE WHEN status = 'ok' THEN round_even((gt - b) / cell, 0)::INT END AS height,
       CASE WHEN status = 'ok' THEN round_even(co, 0)::INT END AS col_off, CASE WHEN status = 'ok' THEN round_even(ro, 0)::INT END AS row_off FROM st""",
)
def common_grid(spark, sf_dir: str) -> DataFrame:
    """The grid that a supplier's products share around its region, and where it lies in each of them."""
    li = _read(spark, sf_dir, "lineitem")
    left = 500_000.0 + 80 * (F.col("l_orderkey") % 200) + F.when(F.col("l_discount") >= 0.095, 30).otherwise(0)
    top = 3_763_000.0 - 80 * (F.col("l_partkey") % 200)
    res = F.when((F.col("l_quantity") >= 50) & (F.col("l_tax") < 0.005) & (F.col("l_discount") < 0.005), 40.0).otherwise(80.0)
    g = li.select(
        F.col("l_suppkey").alias("stack"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("product"), left.alias("left"), top.alias("top"),
        (left + 80_000.0).alias("right"), (top - 104_000.0).alias("bottom"), res.alias("res"), F.lit(32643).alias("epsg"),
    )
    rings = areas.projected(_regions(spark, sf_dir), ["region"], _UTM43)
    box = exposure.bounding_boxes(rings, ["region"]).select(F.col("region").alias("stack"), F.col("lon0").alias("minx"), F.col("lat0").alias("miny"), F.col("lon1").alias("maxx"), F.col("lat1").alias("maxy"))
    out = grids.common_grid(g, ["stack"], box, 2000.0, "product")
    return out.select("stack", "product", "status", "grid_left", "grid_top", "width", "height", "col_off", "row_off")


# -- projections ------------------------------------------------------------------------------

#: 80 m cells in zone 43, and the 40 m cells of zone 44 that cover them.
COARSE, FINE = Grid(500_000.0, 3_700_000.0, 80.0, -80.0, 60, 50), Grid(-62_000.0, 3_724_000.0, 40.0, -40.0, 160, 160)


def _fine(spark, sf_dir: str) -> DataFrame:
    """Coherence of the other band on the fine grid, for each stack of the coarse one."""
    stack = F.concat("l_returnflag", F.lit("-"), F.floor(F.col("l_suppkey") / 50).cast("long").cast("string"))
    cells = _read(spark, sf_dir, "lineitem").groupBy(stack.alias("stack"), (F.col("l_partkey") % FINE.rows).cast("int").alias("row"), (F.col("l_orderkey") % FINE.cols).cast("int").alias("col"))
    return cells.agg(((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) % 991).cast("double") / 991.0).alias("l_coh"))


_INVERSE = """
k2 AS (SELECT 0.00669438::DOUBLE AS e, 6378137.0::DOUBLE AS a, 0.00669438::DOUBLE / (1 - 0.00669438::DOUBLE) AS ep, (1 - sqrt(1 - 0.00669438::DOUBLE)) / (1 + sqrt(1 - 0.00669438::DOUBLE)) AS f),
u AS (
  SELECT c.*, e, a, ep, f, (col + 0.5::DOUBLE) * 80.0::DOUBLE AS x,
         (3700000.0::DOUBLE - (row + 0.5::DOUBLE) * 80.0::DOUBLE) / 0.9996::DOUBLE / (a * (1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256)) AS mu FROM px_pixels c, k2),
v AS (
  SELECT *, mu + (3 * f / 2 - 27 * pow(f, 3) / 32) * sin(2 * mu) + (21 * f * f / 16 - 55 * pow(f, 4) / 32) * sin(4 * mu) + 151 * pow(f, 3) / 96 * sin(6 * mu)
            + 1097 * pow(f, 4) / 512 * sin(8 * mu) AS p FROM u),
z AS (SELECT *, a / sqrt(1 - e * sin(p) * sin(p)) AS nn, a * (1 - e) / pow(1 - e * sin(p) * sin(p), 1.5::DOUBLE) AS r, tan(p) * tan(p) AS t, ep * cos(p) * cos(p) AS c FROM v),
q AS (SELECT *, x / (nn * 0.9996::DOUBLE) AS d FROM z),
ll AS (
  SELECT stack, row, col, coh, 75.0::DOUBLE + degrees((d - pow(d, 3) / 6 * (1 + 2 * t + c) + pow(d, 5) / 120 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t)) / cos(p)) AS lon,
         degrees(p - nn * tan(p) / r * (d * d / 2 - pow(d, 4) / 24 * (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep)
           + pow(d, 6) / 720 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c))) AS lat FROM q)"""
_ACROSS = f"""{W}, {_INVERSE}, ot AS ({utm_sql("lon", "lat", 44, "ll", "stack, row, col, coh")}),
fine AS (
  SELECT l_returnflag || '-' || (l_suppkey // 50)::VARCHAR AS stack, (l_partkey % 160)::INT AS r, (l_orderkey % 160)::INT AS c,
         (sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT % 991)::DOUBLE / 991.0::DOUBLE AS l_coh FROM lineitem GROUP BY 1, 2, 3),
sampled AS (
  SELECT o.stack, o.row, o.col, coh, l_coh FROM ot o
  LEFT JOIN fine f ON f.stack = o.stack AND f.r = floor((n - {FINE.y0}::DOUBLE) / -40.0::DOUBLE)::INT AND f.c = floor((e - ({FINE.x0}::DOUBLE)) / 40.0::DOUBLE)::INT)"""


def _across(spark, sf_dir: str) -> DataFrame:
    px = px_pixels(spark, sf_dir).select("stack", "row", "col", "coh")
    return grids.sampled_across(px, _fine(spark, sf_dir), ["stack"], "l_coh", COARSE, 43, FINE, 44)


@query("j14_cross_projection", f"{_ACROSS} SELECT stack, row, col, round(l_coh, 6) AS l_coh FROM sampled")
def across(spark, sf_dir: str) -> DataFrame:
    """The nearest 40 m cell of the neighbouring zone at the middles of 80 m cells."""
    return _across(spark, sf_dir).select("stack", "row", "col", F.round("l_coh", 6).alias("l_coh"))


@query(
    "m28_band_pilot",
    f"""{_ACROSS}, b AS (SELECT stack, CASE WHEN coh < 0.35 THEN 'low' WHEN coh < 0.7 THEN 'mid' ELSE 'high' END AS stratum, coh, l_coh FROM sampled WHERE coh IS NOT NULL)
SELECT stack, stratum, count(*) AS n, count(l_coh) AS n_both, round(median(coh) FILTER (l_coh IS NOT NULL), 6) AS median_c, round(median(l_coh), 6) AS median_l,
       round(avg(CASE WHEN coh < 0.4 THEN 1.0 ELSE 0.0 END) FILTER (l_coh IS NOT NULL) * 100, 6) AS c_lost_pct,
       round((count(*) FILTER (coh < 0.4 AND l_coh >= 0.4))::DOUBLE / nullif(count(*) FILTER (coh < 0.4 AND l_coh IS NOT NULL), 0) * 100, 6) AS recovered_pct
FROM b GROUP BY ALL""",
)
def band_pilot(spark, sf_dir: str) -> DataFrame:
    """What the long band keeps where the short one loses coherence, by strata of the short one, across projections."""
    c, l_coh = F.col("coh"), F.col("l_coh")
    s = F.when(c < 0.35, "low").when(c < 0.7, "mid").otherwise("high")
    both = l_coh.isNotNull()
    return _across(spark, sf_dir).filter("coh is not null").groupBy("stack", s.alias("stratum")).agg(
        F.count("*").alias("n"), F.count("l_coh").alias("n_both"), F.round(F.median(F.when(both, c)), 6).alias("median_c"), F.round(F.median("l_coh"), 6).alias("median_l"),
        F.round(F.avg(F.when(both, F.when(c < 0.4, 1.0).otherwise(0.0))) * 100, 6).alias("c_lost_pct"),
        F.round(F.try_divide(F.count_if((c < 0.4) & (l_coh >= 0.4)), F.count_if((c < 0.4) & both)) * 100, 6).alias("recovered_pct"),
    )


# -- windows, frost and rain by zone --------------------------------------------------------------


@query(
    "s21_missing_windows",
    """WITH asked AS (SELECT DISTINCT o_custkey, unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + 29, INTERVAL 1 DAY))::DATE AS day FROM orders),
held AS (SELECT DISTINCT o_custkey, unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + 13, INTERVAL 1 DAY))::DATE AS day FROM orders WHERE o_orderstatus = 'F'),
lack AS (SELECT * FROM asked EXCEPT SELECT * FROM held),
runs AS (SELECT o_custkey, day, day - (row_number() OVER (PARTITION BY o_custkey ORDER BY day))::INT AS g FROM lack)
SELECT o_custkey AS customer, min(day) AS start, max(day) + 1 AS "end" FROM runs GROUP BY o_custkey, g""",
)
def missing(spark, sf_dir: str) -> DataFrame:
    """The stretches of time that requests ask for and the store does not hold yet."""
    day = F.to_date("o_orderdate")
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), "o_orderstatus", day.alias("start"))
    asked, held = o.withColumn("end", F.date_add("start", 30)), o.filter("o_orderstatus = 'F'").withColumn("end", F.date_add("start", 14))
    return missing_windows(asked, held, ["customer"])


_HEIGHTS = f"""{PX_PIXELS}, hs AS (
  SELECT {list(SITES)}[(substr(stack, 3)::INT) % 5 + 1] AS site, CASE WHEN coh IS NULL THEN 0.0 WHEN slope_deg > 49.0 THEN -9999.0 ELSE dem END AS h FROM px_pixels),
hk AS (SELECT site, h FROM hs WHERE h >= -1000 AND h <> 0), hm AS (SELECT site, avg(h) AS z, count(*) AS n FROM hk GROUP BY site)"""


@query(
    "m23_spring_conditioning",
    f"""WITH {_WATER}, {_HEIGHTS},
lv AS (SELECT w.site, date, z + tmin_c * 1000.0 / 6.5::DOUBLE AS lo, z + tmax_c * 1000.0 / 6.5::DOUBLE AS hi, n FROM w LEFT JOIN hm ON hm.site = w.site),
sh AS (SELECT lv.site, lv.date, count(h)::DOUBLE / max(n) AS share FROM lv LEFT JOIN hk ON hk.site = lv.site AND h > lo AND h < hi GROUP BY ALL),
ap AS (
  SELECT site, date, water_mm, snowmelt_mm, {"water_mm" + "".join(f" + coalesce(lag(water_mm, {j}) OVER s, 0.0) * {0.9**j!r}::DOUBLE" for j in range(1, 15))} AS api FROM w WINDOW s AS (PARTITION BY site ORDER BY date))
SELECT ap.site, year(ap.date)::INT AS year, count(*) AS n_days, count(*) FILTER (share > 0) AS freeze_thaw_days, round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share,
       round(sum(coalesce(snowmelt_mm, 0)), 6) AS snowmelt_mm, round(avg(api), 6) AS api_mean_mm, round(max(api), 6) AS api_max_mm
FROM ap JOIN sh ON sh.site = ap.site AND sh.date = ap.date WHERE month(ap.date) BETWEEN 3 AND 5 GROUP BY ALL""",
)
def spring(spark, sf_dir: str) -> DataFrame:
    """Each spring's share of the area that thaws and freezes, its snowmelt and its wet ground."""
    daily = px_daily(spark, sf_dir)
    number = F.substring("stack", 3, 20).cast("int") % 5
    height = F.when(F.col("coh").isNull(), 0.0).when(F.col("slope_deg") > 49.0, -9999.0).otherwise(F.col("dem"))
    heights = px_pixels(spark, sf_dir).select(F.element_at(F.array(*map(F.lit, SITES)), number + 1).alias("site"), height.alias("h"))
    share = grids.freezing_share(heights, daily.select("site", "date", "tmin_c", "tmax_c"), BY, "h").select("site", "date", "share")
    days = O.wetness(daily, BY).select("site", "date", "snowmelt_mm", "api_mm").join(share, ["site", "date"]).filter(F.month("date").between(3, 5))
    return days.groupBy("site", F.year("date").alias("year")).agg(
        F.count("*").alias("n_days"), F.count_if(F.col("share") > 0).alias("freeze_thaw_days"), F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.max("share"), 6).alias("max_share"),
        F.round(F.sum(F.coalesce("snowmelt_mm", F.lit(0.0))), 6).alias("snowmelt_mm"), F.round(F.avg("api_mm"), 6).alias("api_mean_mm"), F.round(F.max("api_mm"), 6).alias("api_max_mm"),
    )


def _cell_rates(spark, sf_dir: str) -> DataFrame:
    """Half-hourly rates of each site (the event types) and rain cell of a tenth of a degree; steps without rain are missing."""
    e = _read(spark, sf_dir, "events")
    slot = (F.floor(F.unix_timestamp("ts") / 1800) * 1800).cast("long")
    cells = e.groupBy(F.col("event_type").alias("site"), (F.col("user_id") % 10).cast("int").alias("cx"), (F.floor(F.col("user_id") / 10) % 10).cast("int").alias("cy"), slot.alias("slot"))
    return cells.agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 100.0).alias("rate_mm_h"))


_THRESHOLD = {h: A * h**-B for h in R.HOURS}
_DAY_E = lambda of, key: " , ".join(
    f"(sum(rate * 0.5::DOUBLE) OVER (PARTITION BY {key}, day ORDER BY slot RANGE BETWEEN {int(h * 3600) - 1800} PRECEDING AND CURRENT ROW)) / {h * t!r}::DOUBLE AS e{i}" for i, (h, t) in enumerate(_THRESHOLD.items())
)


@query(
    "m21_zone_divergence",
    f"""WITH {PX_ZONES},
r AS (
  SELECT event_type AS site, (user_id % 10)::INT AS cx, ((user_id // 10) % 10)::INT AS cy, CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 AS slot,
         sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / 100.0::DOUBLE AS rate FROM events GROUP BY ALL),
zc AS (SELECT floor((lon - 75.0::DOUBLE) * 10)::INT AS cx, floor((lat - 33.0::DOUBLE) * 10)::INT AS cy, count(*) AS n FROM px_zones GROUP BY ALL),
total AS (SELECT sum(n) AS n, count(*) AS k FROM zc),
zr AS (SELECT r.site, r.cx, r.cy, slot, slot // 86400 AS day, rate, n FROM r JOIN zc ON zc.cx = r.cx AND zc.cy = r.cy),
ar AS (SELECT site, slot, slot // 86400 AS day, sum(rate * zr.n) / max(total.n) AS rate FROM zr, total GROUP BY ALL),
ze AS (SELECT site, day, cx, cy, max(greatest({", ".join(f"e{i}" for i in range(len(R.HOURS)))})) AS e FROM (SELECT *, {_DAY_E("zr", "site, cx, cy")} FROM zr) GROUP BY ALL),
ae AS (SELECT site, day, max(greatest({", ".join(f"e{i}" for i in range(len(R.HOURS)))})) AS e FROM (SELECT *, {_DAY_E("ar", "site")} FROM ar) GROUP BY ALL),
d AS (
  SELECT ae.site, ae.day, ae.e AS area_e, max(ze.e) AS most, CASE WHEN count(ze.e) < max(k) THEN 0.0 ELSE min(ze.e) END AS least, count(ze.e) AS n_wet
  FROM ae JOIN ze ON ze.site = ae.site AND ze.day = ae.day, total GROUP BY ALL)
SELECT site, make_timestamp(day * 86400000000)::DATE AS date, n_wet AS n_wet_cells, round(area_e, 6) AS area_e, round(least, 6) AS zone_e_min, round(most, 6) AS zone_e_max, round(most / area_e, 6) AS max_over_area
FROM d WHERE area_e >= 1.0""",
)
def zone_divergence(spark, sf_dir: str) -> DataFrame:
    """On days that decide, how far the wettest zone's exceedance lies above the area's: windows within the day, rain by cell."""
    z = px_zones(spark, sf_dir)
    tenth = lambda c, origin: F.floor((F.col(c) - origin) * 10).cast("int")
    cells = stored(z.groupBy(tenth("lon", 75.0).alias("cx"), tenth("lat", 33.0).alias("cy")).agg(F.count("*").alias("n")), "zone-cells")
    n, k = cells.agg(F.sum("n"), F.count("*")).first()
    rates = stored(_cell_rates(spark, sf_dir).join(cells, ["cx", "cy"]), "zone-rates")
    area = rates.groupBy("site", "slot").agg((F.sum(F.col("rate_mm_h") * F.col("n")) / F.lit(float(n or 1))).alias("rate_mm_h"))
    zone_e = O.day_exceedance(rates, ["site", "cx", "cy"], "slot", A, B)
    area_e = O.day_exceedance(area, ["site"], "slot", A, B).withColumnRenamed("max_e", "area_e")
    least = F.when(F.count("*") < F.lit(k), 0.0).otherwise(F.min("max_e"))
    days = zone_e.groupBy("site", "date").agg(F.count("*").alias("n_wet_cells"), least.alias("zone_e_min"), F.max("max_e").alias("zone_e_max"))
    told = area_e.filter("area_e >= 1.0").join(days, ["site", "date"])
    ratio = F.col("zone_e_max") / F.col("area_e")
    return told.select("site", "date", "n_wet_cells", *(F.round(c, 6).alias(c) for c in ("area_e", "zone_e_min", "zone_e_max")), F.round(ratio, 6).alias("max_over_area"))


# -- sampled controls ---------------------------------------------------------------------------

NULL_POINTS, NULL_SEED = 2000, 20260606
#: The area in which null points are drawn (fixed corners).
AREA = ((75.05, 33.02), (75.98, 33.1), (75.9, 33.95), (75.5, 33.6), (75.08, 33.97))
NULL_SQL = f"""ned AS (
  SELECT unnest({[float(x) for x, _ in AREA]}) AS x1, unnest({[float(y) for _, y in AREA]}) AS y1,
         unnest({[float(x) for x, _ in AREA[1:] + AREA[:1]]}) AS x2, unnest({[float(y) for _, y in AREA[1:] + AREA[:1]]}) AS y2),
drawn AS (
  SELECT k, {min(x for x, _ in AREA)}::DOUBLE + ('0x' || substr(md5('{NULL_SEED}:lon:' || k::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * {max(x for x, _ in AREA) - min(x for x, _ in AREA)!r}::DOUBLE AS lon,
         {min(y for _, y in AREA)}::DOUBLE + ('0x' || substr(md5('{NULL_SEED}:lat:' || k::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * {max(y for _, y in AREA) - min(y for _, y in AREA)!r}::DOUBLE AS lat
  FROM (SELECT unnest(range({50 * NULL_POINTS})) AS k)),
met AS (SELECT k, lon, lat FROM drawn, ned WHERE {_LEFT} GROUP BY ALL HAVING count(*) % 2 = 1),
nulls AS (SELECT * FROM met QUALIFY row_number() OVER (ORDER BY k) <= {NULL_POINTS})"""


def null_sample(spark) -> DataFrame:
    """The drawn control: places that are as likely anywhere in the area."""
    vertices = F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in AREA))
    rings = spark.range(1).select(F.lit(0).alias("ring"), vertices.alias("vertices"))
    return validation.null_points(spark, rings, NULL_POINTS, NULL_SEED)
