"""Domain inputs derived from the driver's tables by fixed arithmetic, each with the same thing in SQL.

Sums are over integers (cents), so that they do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The sites of the daily series.
SITES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def px_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather of five sites (the order priorities) on a spine of days; rain averages 6 mm a day, null on days without orders."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("date"), _cents("o_totalprice").alias("cents"))
    d = o.groupBy("site", "date").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    t = d.groupBy("site").agg(F.sum("cents").alias("total"), F.min("date").alias("a"), F.max("date").alias("b"))
    s = t.select("site", "total", (F.datediff("b", "a") + 1).alias("days"), F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    day = F.datediff("date", F.lit("1992-01-01").cast("date"))
    return s.join(d, ["site", "date"], "left").select(
        "site", "date", (F.col("cents") * F.lit(6.0) * F.col("days") / F.col("total")).alias("rain_mm"), ((F.col("n") % 3) * F.lit(0.5)).alias("snowmelt_mm"),
        ((day * 7) % 23 - 14).cast("double").alias("tmin_c"), ((day * 7) % 23 - 14 + (day * 5) % 17).cast("double").alias("tmax_c"),
    )


PX_DAILY = """
px_d AS (SELECT o_orderpriority AS site, CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n FROM orders GROUP BY 1, 2),
px_t AS (SELECT site, sum(cents)::BIGINT AS total, min(date) AS a, max(date) AS b FROM px_d GROUP BY site),
px_s AS (SELECT site, total, date_diff('day', a, b) + 1 AS days, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM px_t),
px_daily AS (
  SELECT s.site, s.date, cents * 6.0::DOUBLE * days / total AS rain_mm, (n % 3) * 0.5::DOUBLE AS snowmelt_mm,
         ((date_diff('day', DATE '1992-01-01', s.date) * 7) % 23 - 14)::DOUBLE AS tmin_c,
         ((date_diff('day', DATE '1992-01-01', s.date) * 7) % 23 - 14 + (date_diff('day', DATE '1992-01-01', s.date) * 5) % 17)::DOUBLE AS tmax_c
  FROM px_s s LEFT JOIN px_d d ON s.site = d.site AND s.date = d.date)"""


def px_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly rates of a site for each event type; steps without events are missing. Rates average 2 mm/h."""
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), (F.floor(F.unix_timestamp("ts") / 1800) * 1800).alias("slot"), _cents("value").alias("cents"))
    d = e.groupBy("site", "slot").agg(F.sum("cents").alias("cents"))
    t = d.groupBy("site").agg(F.sum("cents").alias("total"), F.count("*").alias("n"))
    return d.join(t, "site").select("site", F.timestamp_seconds("slot").alias("ts"), (F.col("cents") * F.lit(2.0) * F.col("n") / F.col("total")).alias("rate_mm_h"))


PX_BURST = """
px_b AS (SELECT event_type AS site, CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 AS slot, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2),
px_bt AS (SELECT site, sum(cents)::BIGINT AS total, count(*) AS n FROM px_b GROUP BY site),
px_burst AS (SELECT b.site, make_timestamp(slot * 1000000) AS ts, cents * 2.0::DOUBLE * n / total AS rate_mm_h FROM px_b b JOIN px_bt t ON b.site = t.site)"""


def px_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel tables of 60 x 50 cells, three stacks (the return flags) for every fifty suppliers, with layers from integer sums."""
    stack = F.concat("l_returnflag", F.lit("-"), F.floor(F.col("l_suppkey") / 50).cast("long").cast("string"))
    cell = _table(spark, sf_dir, "lineitem").groupBy(stack.alias("stack"), (F.col("l_orderkey") % 60).cast("int").alias("row"), (F.col("l_partkey") % 50).cast("int").alias("col"))
    g = cell.agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.sum(_cents("l_extendedprice")).alias("p"), F.sum(_cents("l_discount")).alias("d"))
    part = lambda c, m: (F.col(c) % m).cast("double") / F.lit(float(m))
    known = F.when(F.col("p") % 11 != 0, F.lit(1.0))
    return g.select(
        "stack", "row", "col", "n", (known * (0.2 + 0.8 * part("p", 997))).alias("coh"), (6.0 * part("q", 31) - 3.0).alias("phase"),
        (F.lit(1000.0) + 7.0 * F.col("row") + 3.0 * F.col("col") + part("p", 101) * 4.0).alias("dem"), (10.0 - 80.0 * part("p", 211)).alias("velocity"),
        (0.6 + 2.0 * part("p", 503)).alias("fs_dry"), (known * (0.3 + 1.4 * part("p", 509))).alias("fs_sat"), (4.0 + 9.0 * part("d", 17)).alias("twi"), (50.0 * part("p", 307)).alias("slope_deg"),
    )


PX_PIXELS = """
px_g AS (SELECT l_returnflag || '-' || (l_suppkey // 50)::VARCHAR AS stack, (l_orderkey % 60)::INT AS row, (l_partkey % 50)::INT AS col, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS q,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS p, sum(CAST(round(l_discount * 100) AS BIGINT))::BIGINT AS d FROM lineitem GROUP BY 1, 2, 3),
px_pixels AS (
  SELECT stack, row, col, n, CASE WHEN p % 11 <> 0 THEN 0.2::DOUBLE + 0.8::DOUBLE * ((p % 997)::DOUBLE / 997.0::DOUBLE) END AS coh, 6.0::DOUBLE * ((q % 31)::DOUBLE / 31.0::DOUBLE) - 3.0::DOUBLE AS phase,
         1000.0::DOUBLE + 7.0::DOUBLE * row + 3.0::DOUBLE * col + ((p % 101)::DOUBLE / 101.0::DOUBLE) * 4.0::DOUBLE AS dem, 10.0::DOUBLE - 80.0::DOUBLE * ((p % 211)::DOUBLE / 211.0::DOUBLE) AS velocity,
         0.6::DOUBLE + 2.0::DOUBLE * ((p % 503)::DOUBLE / 503.0::DOUBLE) AS fs_dry, CASE WHEN p % 11 <> 0 THEN 0.3::DOUBLE + 1.4::DOUBLE * ((p % 509)::DOUBLE / 509.0::DOUBLE) END AS fs_sat,
         4.0::DOUBLE + 9.0::DOUBLE * ((d % 17)::DOUBLE / 17.0::DOUBLE) AS twi, 50.0::DOUBLE * ((p % 307)::DOUBLE / 307.0::DOUBLE) AS slope_deg
  FROM px_g)"""


def px_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, a third of them of the inventory (label 1)."""
    c = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        c.alias("point"), (F.lit(75.0) + ((c * 7919) % 10007).cast("double") / 10007.0).alias("lon"), (F.lit(33.0) + ((c * 104729) % 10009).cast("double") / 10009.0).alias("lat"),
        F.when(c % 3 == 0, 1).otherwise(0).alias("label"), F.round(F.col("c_acctbal"), 2).alias("score"),
    )


PX_POINTS = """
px_points AS (SELECT c_custkey AS point, 75.0::DOUBLE + ((c_custkey * 7919) % 10007)::DOUBLE / 10007.0::DOUBLE AS lon, 33.0::DOUBLE + ((c_custkey * 104729) % 10009)::DOUBLE / 10009.0::DOUBLE AS lat,
  (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END)::INT AS label, round(c_acctbal, 2) AS score FROM customer)"""


def px_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert zones of three looks, each of the site of its nation."""
    s = F.col("s_suppkey")
    part = lambda a, m: ((s * a) % m).cast("double") / F.lit(float(m))
    return _table(spark, sf_dir, "supplier").select(
        s.alias("zone"), F.element_at(F.array(*map(F.lit, SITES)), (F.col("s_nationkey") % 5 + 1).cast("int")).alias("site"), F.concat(F.lit("look"), (s % 3).cast("string")).alias("stack"), (F.lit(75.0) + part(7919, 401)).alias("lon"), (F.lit(33.0) + part(104729, 409)).alias("lat"),
        F.when(s % 7 == 0, "CRITICAL").otherwise("HIGH").alias("severity"), (0.4 + 0.6 * part(31, 97)).alias("mean_fs"), (-10.0 - 60.0 * part(37, 101)).alias("velocity"),
        (0.01 + 0.2 * part(41, 103)).alias("area_km2"), (s % 5 == 0).alias("llof"), part(43, 107).alias("m_star"), (0.05 + 0.9 * part(47, 109)).alias("p"), (4.0 + 9.0 * part(53, 113)).alias("twi"),
    )


def _part(a: int, m: int) -> str:
    return f"((s_suppkey * {a}) % {m})::DOUBLE / {m}.0::DOUBLE"


PX_ZONES = f"""
px_zones AS (SELECT s_suppkey AS zone, {list(SITES)}[s_nationkey % 5 + 1] AS site, 'look' || (s_suppkey % 3)::VARCHAR AS stack, 75.0::DOUBLE + {_part(7919, 401)} AS lon, 33.0::DOUBLE + {_part(104729, 409)} AS lat,
  CASE WHEN s_suppkey % 7 = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 0.4::DOUBLE + 0.6::DOUBLE * ({_part(31, 97)}) AS mean_fs, -10.0::DOUBLE - 60.0::DOUBLE * ({_part(37, 101)}) AS velocity,
  0.01::DOUBLE + 0.2::DOUBLE * ({_part(41, 103)}) AS area_km2, s_suppkey % 5 = 0 AS llof, {_part(43, 107)} AS m_star, 0.05::DOUBLE + 0.9::DOUBLE * ({_part(47, 109)}) AS p, 4.0::DOUBLE + 9.0::DOUBLE * ({_part(53, 113)}) AS twi FROM supplier)"""


def px_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image pairs: each user's neighbouring events, with measures and decisions; a stack for each user."""
    e = _table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = e.select("user_id", F.col("event_id").alias("ref"), F.lead("event_id").over(w).alias("sec")).filter("sec is not null")
    i = F.col("ref")
    part = lambda a, m: ((i * a) % m).cast("double") / F.lit(float(m))
    return p.select(
        F.col("user_id").alias("stack"), F.concat(F.lit("P"), i.cast("string"), F.lit("_"), F.col("sec").cast("string")).alias("product"), (i % 60).alias("ref"), (F.col("sec") % 60).alias("sec"),
        F.when(i % 3 == 0, "KEEP").when(i % 3 == 1, "CONCERN").otherwise("QUARANTINE").alias("decision"), F.when(i % 10 != 0, part(31, 97)).alias("r2"), (0.5 + 0.5 * part(37, 101)).alias("coherence"),
        F.when(i % 12 != 0, 100.0 * part(41, 103)).alias("pct"), F.lit(None).cast("double").alias("bperp"), F.when(i % 21 == 0, "RESCUED_FOR_CONNECTIVITY (was CONCERN)").otherwise("").alias("reasons"),
    )


PX_PAIRS = """
px_w AS (SELECT user_id, event_id AS ref, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sec FROM events),
px_pairs AS (
  SELECT user_id AS stack, 'P' || ref || '_' || sec AS product, ref % 60 AS ref, sec % 60 AS sec,
         CASE WHEN px_w.ref % 3 = 0 THEN 'KEEP' WHEN px_w.ref % 3 = 1 THEN 'CONCERN' ELSE 'QUARANTINE' END AS decision
  FROM px_w WHERE sec IS NOT NULL)"""
