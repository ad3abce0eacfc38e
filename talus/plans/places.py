"""Queries on networks, zones, places, routes and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import geo
from talus.functions import physics as P
from talus.operators import exposure, inversion, network, tables, validation, zones
from talus.operators.audit import differences
from talus.plans.rain import _CALENDAR, calendar
from talus.plans.registry import query, r6
from talus.sources.storage import stored
from talus.sources.proxies import PX_PAIRS, PX_POINTS, PX_ZONES, px_pairs, px_points, px_zones

BUFFERS = [5.0, 10.0, 20.0, 30.0, 50.0]
#: Kilometres between a place p and a zone z.
KM_SQL = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(z.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(z.lat)) * pow(sin(radians(z.lon - p.lon) / 2), 2))))"


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- networks ---------------------------------------------------------------------------------


@query(
    "j07_band_pairs",
    """WITH s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.user_id, a.event_id AS ref, b.event_id AS sec, CAST(floor((floor(epoch(b.ts)) - floor(epoch(a.ts))) / 86400) AS INT) AS days
FROM s a JOIN s b ON a.user_id = b.user_id AND b.k BETWEEN a.k + 1 AND a.k + 3 WHERE floor((floor(epoch(b.ts)) - floor(epoch(a.ts))) / 86400) BETWEEN 1 AND 12""",
)
def band_pairs(spark, sf_dir: str) -> DataFrame:
    """Each event with the next three of its user, one to twelve days apart."""
    return network.band_pairs(_read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 3, 12).select("user_id", "ref", "sec", "days")


@query(
    "j08_anti_dedupe",
    """WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem),
jobs AS (SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'A' THEN 'SUCCEEDED' END AS status FROM lineitem WHERE l_returnflag IN ('R', 'A')),
done AS (SELECT lo, hi FROM jobs GROUP BY 1, 2 HAVING count(*) FILTER (status <> 'FAILED') > 0 OR count(*) FILTER (status = 'FAILED') >= 2)
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM done WHERE lo = least(a, b) AND hi = greatest(a, b))""",
)
def dedupe(spark, sf_dir: str) -> DataFrame:
    """Pairs that no job has done or twice failed."""
    li = _read(spark, sf_dir, "lineitem")
    jobs = li.filter("l_returnflag in ('R', 'A')").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("SUCCEEDED").alias("status"))
    return network.new_pairs(li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct(), jobs)


@query("w16_consecutive_pairs", "SELECT user_id, event_id AS ref, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sec FROM events")
def consecutive(spark, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ref"), F.lead("event_id").over(w).alias("sec"))


_COMPONENTS = f"""{PX_PAIRS}, nd AS (SELECT stack, ref AS node FROM px_pairs UNION SELECT stack, sec FROM px_pairs),
ke AS (SELECT stack, ref AS a, sec AS b FROM px_pairs WHERE decision = 'KEEP' UNION SELECT stack, sec, ref FROM px_pairs WHERE decision = 'KEEP'),
rc(stack, node, other) AS (SELECT stack, node, node FROM nd UNION SELECT r.stack, r.node, e.b FROM rc r JOIN ke e ON e.stack = r.stack AND e.a = r.other),
comp AS (SELECT stack, node, min(other) AS component FROM rc GROUP BY 1, 2)"""


def _components(spark, sf_dir: str) -> DataFrame:
    p = px_pairs(spark, sf_dir)
    nodes = p.select("stack", F.col("ref").alias("node")).unionByName(p.select("stack", F.col("sec").alias("node"))).distinct()
    return network.components(nodes, p.filter("decision = 'KEEP'").select("stack", F.col("ref").alias("a"), F.col("sec").alias("b")), ["stack"])


@query("g01_components", f"WITH RECURSIVE {_COMPONENTS} SELECT stack, node, component FROM comp")
def components(spark, sf_dir: str) -> DataFrame:
    """Parts of each stack's network of kept pairs."""
    return _components(spark, sf_dir)


@query("g03_bridging_edges", f"WITH RECURSIVE {_COMPONENTS} SELECT DISTINCT p.stack, product, x.component AS a_component, y.component AS b_component FROM px_pairs p JOIN comp x ON x.stack = p.stack AND x.node = p.ref JOIN comp y ON y.stack = p.stack AND y.node = p.sec WHERE decision = 'CONCERN' AND x.component <> y.component")
def bridging(spark, sf_dir: str) -> DataFrame:
    edges = px_pairs(spark, sf_dir).filter("decision = 'CONCERN'").select("stack", "product", F.col("ref").alias("a"), F.col("sec").alias("b"))
    return network.bridging_edges(edges, _components(spark, sf_dir), ["stack"]).select("stack", "product", "a_component", "b_component").distinct()


_PART = lambda a, m: f"(({a} * px_w.ref) % {m})::DOUBLE / {m}.0::DOUBLE"
_BRIDGE_ROWS = f"""px_w AS (SELECT user_id, event_id AS ref, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sec FROM events),
bp AS (
  SELECT user_id AS stack, 'P' || ref || '_' || sec AS product, ref % 60 AS ref, sec % 60 AS sec,
         CASE WHEN px_w.ref % 3 = 0 THEN 'KEEP' WHEN px_w.ref % 3 = 1 THEN 'CONCERN' ELSE 'QUARANTINE' END AS decision, px_w.ref % 21 = 0 AS rescued,
         CASE WHEN px_w.ref % 10 <> 0 THEN {_PART(31, 97)} END AS r2, 0.5::DOUBLE + 0.5::DOUBLE * ({_PART(37, 101)}) AS coherence,
         CASE WHEN px_w.ref % 12 <> 0 THEN 100.0::DOUBLE * ({_PART(41, 103)}) END AS pct
  FROM px_w WHERE sec IS NOT NULL),
br AS (
  SELECT *, CASE WHEN decision = 'CONCERN' OR (decision = 'KEEP' AND rescued) THEN 1 WHEN decision = 'KEEP' THEN 0 END AS role,
         CASE WHEN r2 > 0.5 THEN 'atmos_r2' WHEN coherence < 0.6 THEN 'coherence' WHEN pct < 30.0 THEN 'surviving_pct' END AS failure FROM bp),
bo AS (
  SELECT *, row_number() OVER (PARTITION BY stack ORDER BY role, CASE WHEN role = 1 THEN -coalesce(pct, -1.0) END, CASE WHEN role = 1 THEN coalesce(r2, 1.0) END, ref, sec, product) AS k
  FROM br WHERE role IS NOT NULL)"""


@query(
    "g02_bridge_selection",
    f"""WITH RECURSIVE {_BRIDGE_ROWS},
seq(stack, k, part, product, told, failure) AS (
  SELECT stack, 0::BIGINT, range(60), NULL::VARCHAR, false, NULL::VARCHAR FROM (SELECT DISTINCT stack FROM bo)
  UNION ALL
  SELECT s.stack, b.k, CASE WHEN role = 0 OR b.failure IS NULL THEN list_transform(part, lambda x: CASE WHEN x = part[b.sec + 1] THEN part[b.ref + 1] ELSE x END) ELSE part END,
         b.product, role = 1 AND part[b.ref + 1] <> part[b.sec + 1], b.failure
  FROM seq s JOIN bo b ON b.stack = s.stack AND b.k = s.k + 1)
SELECT stack, product, failure IS NULL AS selected, failure FROM seq WHERE told""",
)
def bridges(spark, sf_dir: str) -> DataFrame:
    """Rescued pairs of each stack, as chosen one after the other."""
    return network.select_bridges(px_pairs(spark, sf_dir))


# -- zones and places ---------------------------------------------------------------------------


@query("p22_haversine_nearest", f"WITH {PX_POINTS}, {PX_ZONES}, d AS (SELECT p.point, min(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(z.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(z.lat)) * pow(sin(radians(z.lon - p.lon) / 2), 2))))) AS km FROM px_points p, px_zones z GROUP BY 1) SELECT point, round(km, 6) AS nearest_km FROM d")
def nearest(spark, sf_dir: str) -> DataFrame:
    """The nearest zone of each place."""
    return _distances(spark, sf_dir).select("point", F.round("nearest_km", 6).alias("nearest_km"))


def _distances(spark, sf_dir: str) -> DataFrame:
    return validation.nearest_zone(px_points(spark, sf_dir), px_zones(spark, sf_dir), [], "point", "zone")


_KM = f"{PX_POINTS}, {PX_ZONES}, dist AS (SELECT p.point, p.label, min(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(z.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(z.lat)) * pow(sin(radians(z.lon - p.lon) / 2), 2))))) AS nearest_km FROM px_points p, px_zones z GROUP BY 1, 2)"
_ROC = f"""{_KM}, b AS (SELECT unnest({BUFFERS})::DOUBLE AS buffer_km),
rate AS (SELECT buffer_km, avg(CASE WHEN nearest_km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS t, avg(CASE WHEN nearest_km <= buffer_km THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS f FROM dist, b GROUP BY 1),
roc0 AS (SELECT buffer_km, t, f, CASE WHEN t + f > 0 THEN t / (t + f) END AS pr FROM rate),
roc AS (SELECT buffer_km, t AS tpr, f AS fpr, 1 - f AS specificity, pr AS precision, CASE WHEN f > 0 THEN t / f END AS lift, CASE WHEN pr > 0 AND pr + t > 0 THEN 2 * pr * t / (pr + t) END AS f1 FROM roc0)"""


@query("a13_distance_roc", f"WITH {_ROC} SELECT buffer_km, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(lift, 6) AS lift, round(f1, 6) AS f1 FROM roc")
def roc(spark, sf_dir: str) -> DataFrame:
    """Detection rates by distance; with `digits` the operator rounds on the way, as the ledger does."""
    return validation.distance_roc(_distances(spark, sf_dir), [], BUFFERS, digits=None).withColumns(r6("tpr", "fpr", "specificity", "precision", "lift", "f1"))


@query("a14_roc_area", f"WITH {_ROC}, e AS (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, -1.0::DOUBLE AS o UNION ALL SELECT fpr, tpr, buffer_km FROM roc UNION ALL SELECT 1.0, 1.0, 1e9), l AS (SELECT (x - lag(x) OVER (ORDER BY x, o)) * (y + lag(y) OVER (ORDER BY x, o)) / 2 AS a FROM e) SELECT round(sum(a), 6) AS auc FROM l")
def roc_area(spark, sf_dir: str) -> DataFrame:
    rows = validation.distance_roc(_distances(spark, sf_dir), [], BUFFERS, digits=None)
    return validation.roc_area(rows, []).withColumns(r6("auc"))


@query("a16_rank_auc", f"WITH {PX_POINTS}, r AS (SELECT label, row_number() OVER (ORDER BY score, point) AS r FROM px_points WHERE score IS NOT NULL) SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE, 6) AS auc FROM r")
def rank_auc(spark, sf_dir: str) -> DataFrame:
    return validation.rank_auc(px_points(spark, sf_dir), [], "score", "label", "point").withColumns(r6("auc"))


@query("a15_bootstrap_ci")
def bootstrap(spark, sf_dir: str) -> DataFrame:
    """Interval of the area by resampling, and how often shuffled labels do as well."""
    d = stored(_distances(spark, sf_dir), "distances")
    auc = validation.roc_area(validation.distance_roc(d, [], BUFFERS, digits=None), []).first()["auc"]
    return validation.confidence_interval(validation.bootstrap(d, BUFFERS), auc).withColumn("auc", F.lit(auc))


@query("a21_logistic")
def logistic(spark, sf_dir: str) -> DataFrame:
    """Probability of the inventory from place and score, by a regression over all places."""
    p = px_points(spark, sf_dir).withColumns({"x": (F.col("lon") - 75.5) * 3, "y": (F.col("lat") - 33.5) * 3, "s": F.col("score") / 10000})
    beta = validation.fit_logistic(p, ["x", "y", "s"], "label")
    return p.select("point", F.round(validation.logistic_score(["x", "y", "s"], beta), 6).alias("probability"))


_GROUP = "(floor((lon - 75.0) * 5) * 10 + floor((lat - 33.0) * 5))::BIGINT"


def _grouped(spark, sf_dir: str) -> DataFrame:
    return px_zones(spark, sf_dir).withColumn("place", (F.floor((F.col("lon") - 75.0) * 5) * 10 + F.floor((F.col("lat") - 33.0) * 5)).cast("long"))


@query(
    "a10_zone_merge",
    f"""WITH {PX_ZONES} SELECT {_GROUP} AS place, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, string_agg(DISTINCT stack, ',' ORDER BY stack) AS looks, count(DISTINCT stack) AS n_looks,
CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'HIGH' END AS severity, round(min(mean_fs), 6) AS min_fs, round(min(velocity), 6) AS strongest_creep, round(max(area_km2), 6) AS max_area_km2, bool_or(llof) AS llof FROM px_zones GROUP BY 1""",
)
def zone_merge(spark, sf_dir: str) -> DataFrame:
    """Zones of one place merged over looks."""
    return zones.merge_union(_grouped(spark, sf_dir), [], "place").withColumns(r6("lon", "lat", "min_fs", "strongest_creep", "max_area_km2"))


@query("a11_noisy_or", f"WITH {PX_ZONES} SELECT {_GROUP} AS place, round(1.0 - product(1.0 - p), 6) AS confidence, count(*) AS n FROM px_zones GROUP BY 1")
def noisy_or(spark, sf_dir: str) -> DataFrame:
    """Confidence that at least one look is right."""
    return zones.combined_confidence(_grouped(spark, sf_dir), [], "place").withColumns(r6("confidence"))


#: Seeds in the order of a table `mo` (place, k, lon, lat), by a walk over it: how near, in degrees, is {deg}.
GREEDY_SQL = """walk(place, k, seeds) AS (
  SELECT place, 0::BIGINT, []::STRUCT(k BIGINT, lon DOUBLE, lat DOUBLE)[] FROM (SELECT DISTINCT place FROM mo)
  UNION ALL
  SELECT w.place, m.k, CASE WHEN len(list_filter(seeds, lambda s: abs(s.lon - m.lon) < {deg} AND abs(s.lat - m.lat) < {deg})) = 0
         THEN list_append(seeds, {{'k': m.k, 'lon': m.lon, 'lat': m.lat}}) ELSE seeds END
  FROM walk w JOIN mo m ON m.place IS NOT DISTINCT FROM w.place AND m.k = w.k + 1),
last AS (SELECT place, max_by(seeds, k) AS seeds FROM walk GROUP BY place),
taken AS (
  SELECT m.*, list_min(list_transform(list_filter(seeds, lambda s: s.k <= m.k AND abs(s.lon - m.lon) < {deg} AND abs(s.lat - m.lat) < {deg}), lambda s: s.k)) AS seed
  FROM mo m JOIN last l ON l.place IS NOT DISTINCT FROM m.place)"""


@query(
    "j10_union_merge",
    f"""WITH RECURSIVE {PX_ZONES}, mo AS (SELECT 'all' AS place, zone, stack, lon, lat, row_number() OVER (ORDER BY stack, zone) AS k FROM px_zones), {GREEDY_SQL.format(deg=0.02)}
SELECT t.zone, t.stack, s.zone AS seed_zone FROM taken t JOIN mo s ON s.k = t.seed""",
)
def union_merge(spark, sf_dir: str) -> DataFrame:
    """Seeds take the free zones near them, in the order of looks and ids."""
    z = px_zones(spark, sf_dir).withColumn("site", F.lit("all"))
    m = zones.merge_groups(z, ["site"], ["stack", "zone"], 0.02)
    seeds = m.filter(F.col("seed") == F.xxhash64("stack", "zone")).select("seed", F.col("zone").alias("seed_zone"))
    return m.join(seeds, "seed").select("zone", "stack", "seed_zone")


@query("o03_triage", f"WITH {PX_ZONES} SELECT zone, round((1.0 - m_star) * p, 6) AS priority, CASE WHEN m_star < 0.4 THEN 'dry' WHEN m_star < 0.7 THEN 'wet' ELSE 'very wet' END AS tier FROM px_zones")
def triage(spark, sf_dir: str) -> DataFrame:
    """Zones by how soon and how surely they fail."""
    z = zones.triage(px_zones(spark, sf_dir), "m_star", "p")
    return z.select("zone", F.round("priority", 6).alias("priority"), P.banded(F.col("m_star"), [(0.4, "dry"), (0.7, "wet"), (9.0, "very wet")], below=True).alias("tier"))


@query(
    "j15_active_zones_per_day",
    f"""WITH {_CALENDAR}, {PX_ZONES}, d AS (SELECT site, date, alarm_level, least(water_mm / 40.0, 1.0) AS m FROM calendar),
n AS (SELECT d.site, d.date, count(z.zone) AS n FROM d LEFT JOIN px_zones z ON z.site = d.site AND z.m_star <= d.m GROUP BY 1, 2)
SELECT d.site, d.date, alarm_level, (CASE WHEN alarm_level IN ('WATCH', 'ALERT') THEN n ELSE 0 END)::BIGINT AS n_active
FROM d JOIN n ON n.site = d.site AND n.date = d.date""",
)
def active(spark, sf_dir: str) -> DataFrame:
    """Zones of each site that the day's wetness activates, by running counts."""
    days = calendar(spark, sf_dir).withColumn("saturation", F.least(F.col("water_mm") / 40.0, F.lit(1.0)))
    z = px_zones(spark, sf_dir).select("site", F.col("m_star").alias("m_star_eff"))
    return zones.active_per_day(z, days, ["site"]).select("site", "date", "alarm_level", "n_active")


# -- polygons, routes, epochs ---------------------------------------------------------------------


def _rings(spark, sf_dir: str) -> DataFrame:
    """A concave region for each supplier."""
    s = F.col("s_suppkey")
    x, y = ((s * 6007) % 887).cast("double") / 887.0 + 75.0, ((s * 7013) % 883).cast("double") / 883.0 + 33.0
    at = lambda a, b: F.struct((x + a).alias("lon"), (y + b).alias("lat"))
    vertices = F.array(at(0.0, 0.0), at(0.18, 0.0), at(0.18, 0.18), at(0.09, 0.05), at(0.0, 0.18))
    return _read(spark, sf_dir, "supplier").select(s.alias("region"), F.lit(0).alias("ring"), vertices.alias("vertices"))


_EDGES = """pl AS (
  SELECT s_suppkey AS region, ((s_suppkey * 6007) % 887)::DOUBLE / 887.0 + 75.0 AS x, ((s_suppkey * 7013) % 883)::DOUBLE / 883.0 + 33.0 AS y FROM supplier),
ed AS (
  SELECT region, x + unnest([0.0, 0.18, 0.18, 0.09, 0.0]::DOUBLE[]) AS x1, y + unnest([0.0, 0.0, 0.18, 0.05, 0.18]::DOUBLE[]) AS y1,
         x + unnest([0.18, 0.18, 0.09, 0.0, 0.0]::DOUBLE[]) AS x2, y + unnest([0.0, 0.18, 0.05, 0.18, 0.0]::DOUBLE[]) AS y2 FROM pl)"""
#: A point whose latitude an edge spans is left of the edge if it lies on that side in the direction of growing latitude.
_LEFT = "((y1 > lat) <> (y2 > lat)) AND sign(y2 - y1) * ((x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1)) > 0"


@query("f04_point_in_polygon", f"WITH {PX_POINTS}, {_EDGES} SELECT region, point FROM px_points, ed WHERE {_LEFT} GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def inside(spark, sf_dir: str) -> DataFrame:
    """places inside polygons."""
    edges = exposure.polygon_edges(_rings(spark, sf_dir), ["region"])
    return exposure.points_in_polygons(px_points(spark, sf_dir), edges, ["region"], "point")


@query("a34_polygon_stats", f"WITH {PX_POINTS}, {_EDGES}, i AS (SELECT region, point FROM px_points, ed WHERE {_LEFT} GROUP BY 1, 2 HAVING count(*) % 2 = 1) SELECT region, count(*) AS n, count(*) FILTER (label = 1) AS n_events, round(median(score), 6) AS median_score, CASE WHEN count(*) FILTER (label = 1) * 2 > count(*) THEN 'high' ELSE 'low' END AS verdict FROM i JOIN px_points USING (point) GROUP BY 1")
def polygon_stats(spark, sf_dir: str) -> DataFrame:
    """Statistics and a verdict for each polygon."""
    # places bring their values along, so that pairs do not meet the places again
    places = px_points(spark, sf_dir).withColumn("at", F.struct("point", "label", "score"))
    met = exposure.points_in_polygons(places, exposure.polygon_edges(_rings(spark, sf_dir), ["region"]), ["region"], "at").select("region", "at.*")
    n = F.count_if(F.col("label") == 1)
    return met.groupBy("region").agg(F.count("*").alias("n"), n.alias("n_events"), F.round(F.median("score"), 6).alias("median_score"), F.when(n * 2 > F.count("*"), "high").otherwise("low").alias("verdict"))


@query("s10_bounding_boxes", f"WITH {_EDGES} SELECT region, round(min(x1) - 0.01, 6) AS lon0, round(min(y1) - 0.01, 6) AS lat0, round(max(x1) + 0.01, 6) AS lon1, round(max(y1) + 0.01, 6) AS lat1 FROM ed GROUP BY 1")
def boxes(spark, sf_dir: str) -> DataFrame:
    """Boxes of polygons with a margin."""
    return exposure.bounding_boxes(_rings(spark, sf_dir), ["region"], 0.01).withColumns(r6("lon0", "lat0", "lon1", "lat1"))


def _route(spark, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("way"), F.col("o_orderkey").alias("seq0"), ((F.col("o_orderkey") * 31) % 997).cast("double").alias("x"), ((F.col("o_orderkey") * 57) % 991).cast("double").alias("y"))


_ROUTE = "v AS (SELECT o_custkey AS way, o_orderkey AS k, ((o_orderkey * 31) % 997)::DOUBLE AS x, ((o_orderkey * 57) % 991)::DOUBLE AS y FROM orders), sg AS (SELECT way, k, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY way ORDER BY k))"
_DENSE = f"""{_ROUTE}, n AS (SELECT *, greatest(floor(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) / 100.0), 1)::INT AS n FROM sg),
pt AS (SELECT way, k, 0 AS j, x, y FROM n WHERE i = 1 UNION ALL SELECT way, k, j, x + (x1 - x) * j / n, y + (y1 - y) * j / n FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM n WHERE x1 IS NOT NULL)),
smp AS (SELECT way, (row_number() OVER (PARTITION BY way ORDER BY k, j) - 1)::INT AS seq, x, y FROM pt)"""


@query("g12_densify", f"WITH {_DENSE} SELECT way, seq, round(x, 6) AS x, round(y, 6) AS y FROM smp")
def densify(spark, sf_dir: str) -> DataFrame:
    """Points along each line."""
    return exposure.densify(_route(spark, sf_dir), ["way"], "seq0", 100.0).select("way", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_EPOCHS = "e AS (SELECT user_id % 200 AS poly, CAST(ts AS DATE) AS epoch, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / 100000.0 AS coh, count(*)::DOUBLE / 10.0 AS rel FROM events GROUP BY 1, 2), ev AS (SELECT poly, epoch, CASE WHEN coh > 0.02 THEN coh END AS coh, rel FROM e)"


@query(
    "w09_leave_one_out_drop",
    f"""WITH {_EPOCHS}, o AS (SELECT a.poly, a.epoch, a.coh, a.rel, median(b.coh) AS mc, median(b.rel) AS mr, count(b.epoch) AS n FROM ev a LEFT JOIN ev b ON a.poly = b.poly AND a.epoch <> b.epoch AND b.coh IS NOT NULL AND a.coh IS NOT NULL GROUP BY 1, 2, 3, 4),
d AS (SELECT poly, epoch, CASE WHEN n >= 2 THEN mc - coh END AS abs_drop, CASE WHEN n >= 2 THEN mr - rel END AS local_drop FROM o)
SELECT poly, epoch, round(abs_drop, 6) AS abs_drop, round(local_drop, 6) AS local_drop, coalesce(abs_drop >= 0.01 AND local_drop >= 0.01, false) AS flag FROM d""",
)
def drops(spark, sf_dir: str) -> DataFrame:
    """Epochs that fall below the others."""
    e = _read(spark, sf_dir, "events").groupBy((F.col("user_id") % 200).alias("poly"), F.to_date("ts").alias("epoch")).agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 100000.0).alias("coh"), (F.count("*").cast("double") / 10.0).alias("rel"))
    e = e.withColumn("coh", F.when(F.col("coh") > 0.02, F.col("coh")))
    return exposure.coherence_drops(e, ["poly"], "epoch", "coh", "rel", 0.01).select("poly", "epoch", F.round("abs_drop", 6).alias("abs_drop"), F.round("local_drop", 6).alias("local_drop"), "flag")


# -- inversion --------------------------------------------------------------------------------

_SERIES = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE * 12 AS t, CASE WHEN event_id % 9 <> 0 THEN -value END AS d FROM events)"


def _series(spark, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _read(spark, sf_dir, "events").select("user_id", (k.cast("double") * 12).alias("t"), F.when(F.col("event_id") % 9 != 0, -F.col("value")).alias("d"))


@query("w08_centred_slope", f"WITH {_SERIES} SELECT user_id, t, round(CASE WHEN count(d) OVER w >= 2 THEN regr_slope(d, t) OVER w END, 6) AS velocity FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def centred(spark, sf_dir: str) -> DataFrame:
    return inversion.centred_slope(_series(spark, sf_dir), ["user_id"], "t", "d").select("user_id", "t", F.round("velocity", 6).alias("velocity"))


@query("a26_trend", f"WITH {_SERIES} SELECT user_id, round(CASE WHEN count(d) > 1 THEN regr_slope(d, t) END, 6) AS slope, count(d)::BIGINT AS n FROM s GROUP BY 1")
def trend(spark, sf_dir: str) -> DataFrame:
    return inversion.trends(_series(spark, sf_dir), ["user_id"], "t", "d").select("user_id", F.round("slope", 6).alias("slope"), F.col("n").cast("long").alias("n"))


@query(
    "m14_failure_times",
    f"""WITH {_SERIES},
v AS (SELECT user_id, t, d, CASE WHEN count(d) OVER w >= 2 THEN regr_slope(d, t) OVER w END AS velocity FROM s WHERE d IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
i AS (SELECT *, CASE WHEN velocity < -1e-9 THEN 1.0::DOUBLE / -velocity END AS inv FROM v),
f AS (SELECT user_id, count(*) AS n_obs, regr_slope(d, t) * 365.25::DOUBLE AS net, avg(CASE WHEN velocity < -1e-9 THEN 1.0::DOUBLE WHEN velocity IS NOT NULL THEN 0.0::DOUBLE END) AS share, count(inv) AS n_creep,
             regr_slope(inv, t) AS b, regr_intercept(inv, t) AS a, regr_r2(inv, t) AS r2, max(t) AS last FROM i GROUP BY 1),
g AS (SELECT *, CASE WHEN b <> 0 THEN -a / b - last END AS ttf, coalesce(net > 10.0, true) OR coalesce(share < 0.3, false) OR n_creep < 3 AS steady, coalesce(b < 0 AND coalesce(r2, 0.0) >= 0.2, false) AS fast FROM f),
h AS (SELECT *, CASE WHEN n_obs < 6 THEN 'INSUFFICIENT' WHEN steady THEN 'STEADY' WHEN fast AND ttf > 0 AND ttf <= 730.0 THEN 'ACCELERATING' WHEN fast THEN 'ACCEL_BEYOND_HORIZON' ELSE 'STEADY' END AS klass FROM g)
SELECT user_id, n_obs, round(net, 6) AS net_mmyr, round(share, 6) AS creep_share, round(r2, 6) AS r2, klass, CASE WHEN klass LIKE 'ACCEL%' THEN round(ttf, 4) END AS ttf_days FROM h""",
)
def failures(spark, sf_dir: str) -> DataFrame:
    """Classes and times to failure by the inverse velocity."""
    return inversion.failure_times(_series(spark, sf_dir), ["user_id"], creep=10.0, least_share=0.3, least_v=3, least_r2=0.2).withColumns(r6("net_mmyr", "creep_share", "r2") | {"ttf_days": F.round("ttf_days", 4)})


@query("a24_pattern_inversion")
def inverted(spark, sf_dir: str) -> DataFrame:
    """Whole vectors as observations of pairs of dates, some missing, solved by pattern."""
    from datetime import date, timedelta

    vectors = _read(spark, sf_dir, "embeddings")
    n = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    n_dates = next(k for k in range(3, n + 4) if k * (k - 1) // 2 >= n)
    dates = [date(2024, 1, 1) + timedelta(days=12 * i) for i in range(n_dates)]
    pairs = [(f"p{i}_{j}", dates[i], dates[j]) for i in range(n_dates) for j in range(i + 1, n_dates)]
    net = inversion.Network(pairs[: max(n, 2)])
    obs = F.transform("embedding", lambda x, i: F.when(F.pmod(F.col("vec_id") * 7 + i * 3, F.lit(8)) != 0, x.cast("double") / 100))
    out = inversion.invert(vectors.select("vec_id", obs.alias("obs")), net, ["vec_id"], n_dates)
    return out.select("vec_id", F.transform("disp", lambda x: F.round(x, 9)).alias("disp"), F.round("velocity", 9).alias("velocity"), F.round("gamma", 6).alias("gamma"))


# -- tables: sorting, sets, names -----------------------------------------------------------------


@query("o04_top_k", f"WITH {PX_ZONES} SELECT zone, round(m_star, 6) AS m_star FROM px_zones ORDER BY m_star, zone LIMIT 10")
def top_k(spark, sf_dir: str) -> DataFrame:
    """The ten zones that fail first."""
    return tables.top(px_zones(spark, sf_dir), [F.col("m_star"), F.col("zone")], 10).select("zone", F.round("m_star", 6).alias("m_star"))


@query("o07_null_order", "WITH c AS (SELECT s_nationkey AS n, s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 11 END AS deaths, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 END AS injured FROM supplier) SELECT s_suppkey, row_number() OVER (PARTITION BY n ORDER BY coalesce(deaths, 0) DESC, coalesce(injured, 0) DESC, s_suppkey)::INT AS place FROM c")
def null_order(spark, sf_dir: str) -> DataFrame:
    """Events by casualties, unknown as none."""
    k = F.col("s_suppkey")
    s = _read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.when(k % 3 != 0, k % 11).alias("deaths"), F.when(k % 4 != 0, k % 7).alias("injured"))
    return tables.ranked(s, ["s_nationkey"], [F.desc(F.coalesce("deaths", F.lit(0))), F.desc(F.coalesce("injured", F.lit(0))), F.col("s_suppkey")]).select("s_suppkey", F.col("place"))


@query("o12_best_row", f"WITH {_CALENDAR}, r AS (SELECT site, date, exceedance, row_number() OVER (PARTITION BY site ORDER BY exceedance DESC, date) AS k FROM calendar) SELECT site, date, round(exceedance, 6) AS exceedance FROM r WHERE k = 1")
def best(spark, sf_dir: str) -> DataFrame:
    """The first largest day of each site."""
    c = calendar(spark, sf_dir)
    return tables.first_of(c, ["site"], [F.desc("exceedance"), F.col("date")]).select("site", "date", F.round("exceedance", 6).alias("exceedance"))


@query("o13_even_subsample", "WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem) SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE i % 7 = 0")
def subsample(spark, sf_dir: str) -> DataFrame:
    return tables.every(_read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey", "l_linenumber", 7).select("l_returnflag", "l_orderkey", "l_linenumber")


@query(
    "u03_set_diff",
    """WITH r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT k, 'left' AS side FROM (SELECT k FROM r EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'right' FROM (SELECT k FROM a EXCEPT SELECT k FROM r)""",
)
def set_diff(spark, sf_dir: str) -> DataFrame:
    """Orders that stand in one of two sets only."""
    li = _read(spark, sf_dir, "lineitem")
    of = lambda flag: li.filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k")).distinct()
    return differences(of("R"), of("A"))


@query("u04_dedupe", "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, round(o_totalprice / 10000) ORDER BY o_orderkey) AS k FROM orders) SELECT o_orderkey, o_custkey FROM r WHERE k = 1")
def dedupe_rounded(spark, sf_dir: str) -> DataFrame:
    """Of rows alike on rounded keys the first."""
    return tables.first_of(_read(spark, sf_dir, "orders"), ["o_custkey", F.round(F.col("o_totalprice") / 10000)], [F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


@query("f13_newer_than_library", "WITH lib AS (SELECT user_id % 20 AS path, max(ts) AS newest FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id % 20 AS path, count(*) AS n_new, max(ts) AS newest FROM events e JOIN lib l ON l.path = e.user_id % 20 WHERE e.ts > l.newest GROUP BY 1")
def newer(spark, sf_dir: str) -> DataFrame:
    """Scenes newer than the library's newest, by path."""
    e = _read(spark, sf_dir, "events").withColumn("path", F.col("user_id") % 20)
    return tables.newer(e, e.filter("event_type = 'view'"), ["path"], "ts")


@query("p27_stack_labels", "WITH j AS (SELECT o_orderkey, 'Site_' || CASE WHEN o_orderkey % 2 = 0 THEN 'ASCENDING' ELSE 'desc' END || '_path' || (o_custkey % 150) || '_frame' || (o_orderkey % 700) AS name FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'ASC' ELSE 'DESC' END || '_path' || regexp_extract(name, '_path(\\d+)_', 1) || '_frame' || regexp_extract(name, '_frame(\\d+)', 1) AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS direction, regexp_extract(name, '_path(\\d+)_', 1)::INT AS path, regexp_extract(name, '_frame(\\d+)', 1)::INT AS frame FROM j".replace("\\\\", "\\"))
def labels(spark, sf_dir: str) -> DataFrame:
    """Stack labels from job names, and their parts."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Site_"), F.when(k % 2 == 0, "ASCENDING").otherwise("desc"), F.lit("_path"), (F.col("o_custkey") % 150).cast("string"), F.lit("_frame"), (k % 700).cast("string"))
    j = _read(spark, sf_dir, "orders").select("o_orderkey", geo.label_of_job(name, "Site").alias("label"))
    d, p, f = geo.label_parts(F.col("label"))
    return j.select("o_orderkey", "label", d.alias("direction"), p.alias("path"), f.alias("frame"))


@query("p29_pair_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ref, strftime(o_orderdate + INTERVAL 12 DAY, '%Y-%m-%d') AS sec FROM orders")
def pair_dates(spark, sf_dir: str) -> DataFrame:
    """The two dates in a product's name."""
    f = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    name = F.concat(F.lit("S1_"), f(F.col("o_orderdate")), F.lit("_"), f(F.col("o_orderdate") + F.expr("interval 12 days")), F.lit("_VV"))
    a, b = geo.pair_dates(name)
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(a, "yyyy-MM-dd").alias("ref"), F.date_format(b, "yyyy-MM-dd").alias("sec"))


@query("j18_priority_lookup", "WITH a AS (SELECT DISTINCT o_custkey AS k, 'daily' AS src, 1 AS pr FROM orders WHERE o_orderstatus = 'F' UNION SELECT DISTINCT o_custkey, 'burst', 2 FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr) AS i FROM a) SELECT c_custkey, coalesce(src, 'none') AS src FROM customer LEFT JOIN r ON r.k = c_custkey AND i = 1")
def priority(spark, sf_dir: str) -> DataFrame:
    """The first of several sources that has a row."""
    o = _read(spark, sf_dir, "orders")
    of = lambda status, name: o.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("c_custkey"), F.lit(name).alias("src")).distinct()
    return tables.first_source(_read(spark, sf_dir, "customer").select("c_custkey"), [of("F", "daily"), of("O", "burst")], "c_custkey", "src", "none")


@query("j20_semi_by_stack", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi(spark, sf_dir: str) -> DataFrame:
    """Rows whose key stands in another table."""
    u = _read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return _read(spark, sf_dir, "customer").select("c_custkey").join(u, "c_custkey", "left_semi")


@query("f01_keep_products", f"WITH {PX_PAIRS} SELECT stack, product, row_number() OVER (PARTITION BY stack ORDER BY product)::INT AS place FROM px_pairs WHERE decision = 'KEEP'")
def kept(spark, sf_dir: str) -> DataFrame:
    """kept products of each stack, in order."""
    place = F.row_number().over(Window.partitionBy("stack").orderBy("product"))
    return px_pairs(spark, sf_dir).filter("decision = 'KEEP'").select("stack", "product", place.alias("place"))


@query("u06_extents", "WITH g AS (SELECT l_suppkey % 50 AS stack, l_orderkey % 40 AS x, l_partkey % 30 AS y, l_quantity AS w FROM lineitem) SELECT stack, max(x)::DOUBLE AS left, max(y)::DOUBLE AS bottom, min(x + 40 + w)::DOUBLE AS right, min(y + 30 + w)::DOUBLE AS top FROM g GROUP BY 1")
def extents(spark, sf_dir: str) -> DataFrame:
    """The rectangle that all grids of a stack share."""
    from talus.operators.raster import extent

    x, y = F.col("l_orderkey") % 40, F.col("l_partkey") % 30
    g = _read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("stack"), x.cast("double").alias("left"), y.cast("double").alias("bottom"), (x + 40 + F.col("l_quantity")).cast("double").alias("right"), (y + 30 + F.col("l_quantity")).cast("double").alias("top"), F.lit(80).alias("res"), F.lit(32643).alias("epsg"))
    return extent(g, ["stack"]).drop("harmonised")
