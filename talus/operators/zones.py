"""Operators on alert zones: description, merging over looks, confidence, activation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import physics as P
from talus.functions.stats import exact_mean
from talus.sources.storage import stored


def describe(pixels: DataFrame, by: list[str], size_m: float, velocity: str = "velocity", fs: str = "fs", slope: str = "slope_deg") -> DataFrame:
    """Size, area, middle, mean and strongest motion, mean safety factor, slope and severity of each zone.

    Means are exact sums rounded once: a zone that lies on a limit is on the same side of it in each run.
    """
    z = pixels.groupBy(*by, "zone").agg(
        F.count("*").alias("n_pixels"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"), exact_mean(F.col(velocity)).alias("mean_velocity"),
        F.min(velocity).alias("max_velocity"), exact_mean(F.col(fs)).alias("mean_fs"), exact_mean(F.col(slope)).alias("mean_slope"),
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"),
    )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("mean_velocity", "zone"))
    return z.withColumns({"area_km2": F.col("n_pixels") * (size_m * size_m / 1e6), "severity": P.severity(F.col("mean_velocity"), F.col("mean_fs")), "id": rank})


def valley_flag(zones: DataFrame, pixels: DataFrame, by: list[str], twi: str = "twi", margin: int = 5, share: float = 0.9) -> DataFrame:
    """llof_potential: a large steep zone with a valley cell (wetness index in the top share of its grid) near its box.

    Cells and boxes meet by tiles.
    """
    cut = pixels.groupBy(*by).agg(F.percentile(twi, F.lit(share)).alias("_cut"))
    valleys = pixels.join(cut, by).filter(F.col(twi) >= F.col("_cut")).select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"))
    tile = 32
    lo = lambda c: F.floor((F.col(c) - margin) / tile)
    hi = lambda c: F.floor((F.col(c) + margin) / tile)
    spread = zones.withColumn("_tr", F.explode(F.sequence(lo("row0"), hi("row1")))).withColumn("_tc", F.explode(F.sequence(lo("col0"), hi("col1"))))
    tiled = valleys.withColumns({"_tr": F.floor(F.col("_r") / tile), "_tc": F.floor(F.col("_c") / tile)})
    inside = F.col("_r").between(F.col("row0") - margin, F.col("row1") + margin) & F.col("_c").between(F.col("col0") - margin, F.col("col1") + margin)
    near = spread.join(tiled, [*by, "_tr", "_tc"]).filter(inside).select(*by, "zone").distinct().withColumn("_near", F.lit(True))
    flag = F.coalesce("_near", F.lit(False)) & F.coalesce(F.col("mean_slope") > 25, F.lit(False)) & (F.col("n_pixels") > 4)
    return zones.join(near, [*by, "zone"], "left").withColumn("llof_potential", flag).drop("_near")


def merge_groups(zones: DataFrame, by: list[str], order: list[str], deg: float = 0.0015) -> DataFrame:
    """`seed`: the zone that each zone merges with: in order, a zone that is still free takes all later free ones near it.

    All zones of a cell of the merging distance are near each other, so that a cell has one seed at most: the first of its
    free zones, unless a free zone near it comes before. In each round all cells look at their neighbours at
    once: whoever is first among all free zones near it is a seed, and takes those near it. Rounds are written out until
    none is free; then each zone goes to the first seed near it.
    """
    cell = lambda c: F.floor(F.col(c) / deg).cast("long")
    z = stored(zones.withColumn("node", F.xxhash64(*order)).withColumns({"_x": cell("lon"), "_y": cell("lat"), "_o": F.struct(*order)}), "merge-zones")
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    near = (F.abs(F.col("lon") - F.col("_s.lon")) < deg) & (F.abs(F.col("lat") - F.col("_s.lat")) < deg)

    def around(few: DataFrame) -> DataFrame:
        """Each of a few zones, one a cell, sent to the nine cells around it."""
        sent = few.select(*by, "_x", "_y", F.struct("_o", "node", "lon", "lat").alias("_s")).withColumn("_d", steps)
        return sent.select(*by, (F.col("_x") + F.col("_d.i")).alias("_x"), (F.col("_y") + F.col("_d.j")).alias("_y"), "_s")

    keys = ["_x", "_y", "_o", "node", "lon", "lat"]
    free, seeds = z.select(*by, *keys), None
    while not free.isEmpty():
        first = free.groupBy(*by, "_x", "_y").agg(F.min(F.struct("_o", "node", "lon", "lat")).alias("_f")).select(*by, "_x", "_y", "_f.*")
        met = stored(free.join(around(first), [*by, "_x", "_y"]).filter(near), "merge-met")
        blocked = met.filter(F.col("_o") < F.col("_s._o")).select(*by, F.col("_s.node").alias("node")).distinct()
        new = stored(first.join(blocked, [*by, "node"], "left_anti").select(*by, *keys), "merge-seeds")
        taken = met.select(*by, "node", F.col("_s.node").alias("_by")).join(new.select(*by, F.col("node").alias("_by")), [*by, "_by"], "left_semi").select(*by, "node").distinct()
        free = stored(free.join(taken, [*by, "node"], "left_anti"), "merge-free")
        seeds = new if seeds is None else seeds.unionByName(new)
    if seeds is None:
        return zones.withColumn("seed", F.lit(None).cast("long"))
    chosen = z.select(*by, *keys).join(around(seeds), [*by, "_x", "_y"]).filter(near & (F.col("_s._o") <= F.col("_o")))
    chosen = chosen.groupBy(*by, "node").agg(F.min(F.struct(F.col("_s._o").alias("o"), F.col("_s.node").alias("seed"))).alias("_m")).select(*by, "node", "_m.seed")
    return z.drop("_x", "_y", "_o").join(chosen, [*by, "node"]).drop("node")


def merge_union(zones: DataFrame, by: list[str], group: str) -> DataFrame:
    """One row for each group: mean place, looks, any CRITICAL, lowest safety factor, strongest motion, largest area."""
    return zones.groupBy(*by, group).agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.array_join(F.sort_array(F.collect_set("stack")), ",").alias("looks"), F.count_distinct("stack").alias("n_looks"),
        F.when(F.bool_or(F.col("severity") == "CRITICAL"), "CRITICAL").otherwise("HIGH").alias("severity"), F.min("mean_fs").alias("min_fs"),
        F.min("velocity").alias("strongest_creep"), F.max("area_km2").alias("max_area_km2"), F.bool_or("llof").alias("llof"),
    )


def combined_confidence(zones: DataFrame, by: list[str], group: str, p: str = "p") -> DataFrame:
    """Confidence that at least one look is right."""
    return zones.groupBy(*by, group).agg((1.0 - F.product(1.0 - F.col(p))).alias("confidence"), F.count("*").alias("n"))


def active_per_day(zones: DataFrame, days: DataFrame, by: list[str]) -> DataFrame:
    """Zones whose effective critical saturation the day's saturation reaches, on WATCH and ALERT days."""
    asked = days.withColumn("m_star_eff", F.col("saturation"))
    counted = counts_up_to(zones, asked, by, "m_star_eff", "n_active").drop("m_star_eff")
    armed = F.coalesce(F.col("alarm_level").isin("WATCH", "ALERT"), F.lit(False))
    return counted.withColumn("n_active", F.when(armed, F.col("n_active")).otherwise(F.lit(0)).cast("long"))


def counts_up_to(items: DataFrame, asked: DataFrame, by: list[str], value: str, name: str, descending: bool = False, cells: int = 1024) -> DataFrame:
    """The rows of `asked` with `name`: how many items of their group have a value as small or smaller (descending: as large or larger).

    Values lie between 0 and 1 for the most part and are cut into cells: a running count within a cell plus the
    counts of the cells before, so that a group with very many rows is dealt to many tasks. No pairs are made.
    """
    v = F.col(value)
    share = 1.0 - v if descending else v
    cell = F.least(F.greatest(F.floor(share * cells), F.lit(0)), F.lit(cells)).cast("int")
    keyed = lambda df: df.withColumns({"_v": -v if descending else v, "_cell": cell})
    counted = keyed(items.select(*by, value).filter(v.isNotNull())).groupBy(*by, "_cell", "_v").agg(F.count("*").alias("_n"))
    rows = keyed(asked)
    both = rows.withColumns({"_n": F.lit(0).cast("long"), "_asked": F.lit(True)}).unionByName(counted.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy(*by, "_cell").agg(F.sum("_n").alias("_s"))
    before = sums.select(*by, "_cell", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_own", own).filter("_asked").join(before, [*by, "_cell"], "left")
    n = F.when(v.isNotNull(), F.col("_own") + F.col("_before")).otherwise(F.lit(0)).cast("long")
    return placed.select(*(F.col(c) for c in asked.columns), n.alias(name))


def zone_pixels(zones: DataFrame, pixels: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Zones with the values at their middle pixel; null where it does not exist."""
    at = pixels.select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"), *columns)
    z = zones.withColumns({"_r": F.rint("centre_row").cast("int"), "_c": F.rint("centre_col").cast("int")})
    return z.join(at, [*by, "_r", "_c"], "left").drop("_r", "_c")


def triage(zones: DataFrame, m_star: str = "m_star", confidence: str = "confidence") -> DataFrame:
    """priority: (1 - critical saturation) times confidence."""
    return zones.withColumn("priority", (1.0 - F.col(m_star)) * F.col(confidence))


def zone_series(zones: DataFrame, cube: DataFrame, pixels: DataFrame, by: list[str], creep: float = -15.0, radius: int = 5) -> DataFrame:
    """Mean displacement series of the creeping pixels around each zone's middle; all pixels if none creeps."""
    near = zones.select(*by, "zone", F.rint("centre_row").cast("int").alias("_r"), F.rint("centre_col").cast("int").alias("_c"))
    cells = near.withColumn("row", F.explode(F.sequence(F.col("_r") - radius, F.col("_r") + radius))).withColumn("col", F.explode(F.sequence(F.col("_c") - radius, F.col("_c") + radius)))
    met = cells.join(pixels.select(*by, "row", "col", "velocity"), [*by, "row", "col"]).withColumn("_creep", F.coalesce(F.col("velocity") < creep, F.lit(False)))
    any_creep = F.max(F.col("_creep").cast("int")).over(Window.partitionBy(*by, "zone"))
    chosen = met.withColumn("_any", any_creep).filter((F.col("_any") == 0) | F.col("_creep"))
    return chosen.join(cube, [*by, "row", "col"]).groupBy(*by, "zone", "date").agg(F.avg("disp_mm").alias("disp_mm"), F.count("disp_mm").alias("n"))
