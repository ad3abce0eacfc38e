"""Independent looks at a product: velocities along the slope, delays of pairs, methods side by side, change around scars, catalogues against a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import physics as P
from talus.functions.stats import guarded_corr
from talus.operators.raster import gaussian_highpass, label_zones
from talus.operators.validation import ordinal_ranks
from talus.operators.zones import counts_up_to


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of the known values of each group, by ranks within ranges of values: no task holds a whole group."""
    known = df.filter(F.col(value).isNotNull()).select(*by, value)
    n = known.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = ordinal_ranks(known, by, value, value).join(n, by)

    def at(p: float) -> Column:
        place = F.lit(p) * (F.col("_n") - 1) + 1
        pick = lambda k: F.max(F.when(F.col("rank") == k, F.col(value)))
        low, high = pick(F.floor(place)), pick(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return ranked.groupBy(*by).agg(*(at(p).alias(name) for name, p in shares.items()))


def slope_velocity_report(pixels: DataFrame, by: list[str], velocity: str, c: str, slope_deg: str, least_c: float = 0.3, least_slope: float = 10.0, creep: float = -15.0) -> DataFrame:
    """How much of each group the line of sight sees, and how creep along it compares with creep down the slope (positive downward).

    Pixels without velocity, sensitivity or slope are not valid; shares and medians of nothing are null.
    """
    v, s = F.col(velocity), F.abs(F.col(c))
    valid = pixels.filter(v.isNotNull() & F.col(c).isNotNull() & F.col(slope_deg).isNotNull())
    along = P.slope_velocity(v, F.col(c), F.col(slope_deg), least_c, least_slope)
    rows = valid.withColumns({"_s": s, "_along": along, "_creeps": v < creep})
    rows = rows.withColumn("_amp", F.when(F.col("_creeps"), F.abs("_along") / F.greatest(F.abs(v), F.lit(1e-6))))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n_valid"), F.count("_along").alias("n_observed"), F.count_if("_creeps").alias("n_los_creep"),
        F.count_if(F.col("_along") > -creep).alias("n_slope_creep"), F.max(F.abs("_along")).alias("max_v_slope"),
    ).withColumn("blind_share", 1.0 - F.col("n_observed") / F.col("n_valid"))
    for value, name in (("_s", "median_sensitivity"), ("_amp", "median_amplification")):
        sums = sums.join(exact_quantiles(rows, by, value, {name: 0.5}), by, "left")
    return sums


def velocity_inspection(pixels: DataFrame, by: list[str], velocity: str, coherence: str, least: float, fast: float) -> DataFrame:
    """One row a group and set ("all", "coherent"): number, mean, deviation, extremes, 2nd percentile, median, 98th percentile, and how many are faster than `fast`.

    Groups without a velocity in a set have no row for it; unknown coherences are not coherent.
    """
    kept = F.coalesce(F.col(coherence) >= least, F.lit(False))
    sets = F.when(kept, F.array(F.lit("all"), F.lit("coherent"))).otherwise(F.array(F.lit("all")))
    each = pixels.filter(F.col(velocity).isNotNull()).select(*by, F.explode(sets).alias("set"), F.col(velocity).alias("_v"))
    v, key = F.col("_v"), [*by, "set"]
    sums = each.groupBy(*key).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(F.abs(v) > fast).alias("n_fast"))
    return sums.join(exact_quantiles(each, key, "_v", {"p02": 0.02, "median": 0.5, "p98": 0.98}), key)


def delay_crosscheck(layers: DataFrame, by: list[str], epoch: str, factor: int) -> DataFrame:
    """For each two epochs that follow each other: the apparent motion that an independent zenith delay predicts, against height and observed motion.

    `layers` has row, col, zenith_m, theta, dem and observed_mm; all are averaged over blocks of `factor` cells, where both epochs
    have the block. Angle, height and motion are the later epoch's. Correlations are null where a side does not vary.
    """
    block = [F.floor(F.col(x) / factor).cast("int").alias(f"{x}2") for x in ("row", "col")]
    coarse = layers.groupBy(*by, epoch, *block).agg(*(F.avg(x).alias(x) for x in ("zenith_m", "theta", "dem", "observed_mm")))
    w = Window.partitionBy(*by).orderBy(epoch)
    steps = layers.select(*by, epoch).distinct().withColumn("ref", F.lag(epoch).over(w)).filter("ref is not null").withColumnRenamed(epoch, "sec")
    later = coarse.withColumnRenamed(epoch, "sec").join(steps, [*by, "sec"])
    before = coarse.select(*by, F.col(epoch).alias("ref"), "row2", "col2", F.col("zenith_m").alias("_zenith"))
    both = later.join(before, [*by, "ref", "row2", "col2"])
    change_m = (P.slant_delay_mm(F.col("zenith_m"), F.col("theta")) - P.slant_delay_mm(F.col("_zenith"), F.col("theta"))) / 1000.0
    rows = both.withColumn("predicted", P.los_displacement(change_m) * 1000.0).filter(F.col("predicted").isNotNull() & F.col("dem").isNotNull())
    seen = F.when(F.col("observed_mm").isNotNull(), F.col("predicted"))
    return rows.groupBy(*by, "ref", "sec").agg(
        F.count("*").alias("n_elev"), guarded_corr(F.col("predicted"), F.col("dem")).alias("r_elev"), F.count("observed_mm").alias("n_obs"),
        guarded_corr(seen, F.col("observed_mm")).alias("r_obs"), F.min("predicted").alias("least_mm"), F.max("predicted").alias("most_mm"),
    )


def compare_methods(pixels: DataFrame, by: list[str], methods: dict[str, Column], base: str, reference: Column, trusted: Column, sigma: float) -> DataFrame:
    """Velocities by several methods against a reference, all on the same pixels: scatter, agreement raw and high-passed, centred RMS.

    Common pixels are trusted and have the reference, its high-pass and every method; high-passes are made from all trusted pixels
    of a method, so that holes of the others do not thin them. `lowest_scatter` and `best_agreement` mark one method a group, ties to the
    name that comes first.
    """
    names = {**methods, "_reference": reference}
    flat = pixels.select(*by, "row", "col", trusted.alias("_ok"), *(c.alias(f"_m_{n}") for n, c in names.items()))
    every = flat.withColumn("_all", F.col("_ok") & ~F.greatest(*(F.col(f"_m_{n}").isNull().cast("int") for n in names)).cast("boolean"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col(f"_m_{n}").alias("v")) for n in names)))
    rows = every.select(*by, "row", "col", "_ok", "_all", each.alias("x")).select(*by, "row", "col", "_all", "x.method", "x.v", F.when(F.col("_ok"), F.col("x.v")).alias("_held"))
    high = gaussian_highpass(rows, [*by, "method"], "_held", sigma).withColumnRenamed("highpass", "hp")
    ref = high.filter("method = '_reference' and _all and hp is not null").select(*by, "row", "col", F.col("v").alias("_ref"), F.col("hp").alias("_ref_hp"))
    common = high.filter("method <> '_reference' and _all").join(ref, [*by, "row", "col"])
    hp = lambda c: F.when(F.col("hp").isNotNull(), F.col(c))
    out = common.groupBy(*by, "method").agg(
        F.count("*").alias("n"), F.stddev_pop("v").alias("std"), guarded_corr(F.col("v"), F.col("_ref")).alias("r_raw"), guarded_corr(F.col("v"), F.col("_ref_hp")).alias("r_hp"),
        guarded_corr(F.col("hp"), hp("_ref_hp")).alias("r_hp_hp"), F.stddev_pop(F.col("v") - F.col("_ref")).alias("rms"),
    )
    group = Window.partitionBy(*by)
    base_std = F.max(F.when(F.col("method") == base, F.col("std"))).over(group)
    least = lambda order: F.row_number().over(group.orderBy(order, "method")) == 1
    marks = {"lowest_scatter": least(F.round("std", 6)), "best_agreement": least(F.desc_nulls_last(F.round("r_raw", 6)))}
    return out.withColumn("reduction_pct", 100.0 * F.try_divide(base_std - F.col("std"), base_std)).withColumns(marks)


def hazard_delta(pixels: DataFrame, by: list[str], fs: str, a: str, b: str) -> DataFrame:
    """What changes in the hazard classes when velocity `a` is replaced by `b` on the same stability: creep, the highest class and its zones.

    `a` and `b` of the result's names stand for the two velocities. Unknown velocities do not creep; overlaps of nothing are null.
    """
    creep = lambda v: F.coalesce(P.creeping(F.col(v)), F.lit(False))
    high = lambda v: F.coalesce(P.hazard_class(F.col(fs), F.col(v)) == 2, F.lit(False))
    counts = []
    for name, f in (("creep", creep), ("high", high)):
        one, two = f(a), f(b)
        both, any_ = F.count_if(one & two), F.count_if(one | two)
        counts += [F.count_if(one).alias(f"{name}_a"), F.count_if(two).alias(f"{name}_b"), F.try_divide(both.cast("double"), any_.cast("double")).alias(f"{name}_iou")]
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    sums = pixels.groupBy(*by).agg(F.count_if(known).alias("n_common"), guarded_corr(F.when(known, F.col(a)), F.when(known, F.col(b))).alias("r"), *counts)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), high(v).alias("on")) for k, v in (("a", a), ("b", b)))))
    flat = pixels.select(*by, "row", "col", each.alias("x")).select(*by, "row", "col", "x.*").filter("on")
    zones = label_zones(flat, [*by, "variant"], F.col("on")).select(*by, "variant", "zone").distinct()
    n = zones.groupBy(*by).agg(*(F.count_if(F.col("variant") == k).alias(f"zones_{k}") for k in "ab"))
    return sums.join(n, by, "left").fillna(0, ["zones_a", "zones_b"])


def composite_change(images: DataFrame, by: list[str], value: str, before: Column) -> DataFrame:
    """change: the median of each cell's later images less that of its earlier ones; null where one of them has none."""
    m = images.groupBy(*by, "row", "col").agg(F.median(F.when(before, F.col(value))).alias("_pre"), F.median(F.when(~before, F.col(value))).alias("_post"))
    return m.select(*by, "row", "col", F.round(F.col("_post") - F.col("_pre"), 9).alias("change"))


def least_around(pixels: DataFrame, by: list[str], value: str, radii: list[int]) -> DataFrame:
    """`by`, row, col and least_<r>: the smallest value in the square of r cells around each place of the grid's rectangle.

    Two passes over lines, along rows and then along columns; absent cells are places without a value.
    """
    ends = pixels.groupBy(*by).agg(*(f(c).cast("int").alias(f"_{c}{k}") for c in ("row", "col") for k, f in ((0, F.min), (1, F.max))))
    df = pixels.select(*by, "row", "col", *(F.col(value).alias(f"least_{r}") for r in radii))
    for line, order in (("row", "col"), ("col", "row")):
        spine = df.select(*by, line).distinct().join(ends, by).select(*by, line, F.explode(F.sequence(f"_{order}0", f"_{order}1")).alias(order))
        w = Window.partitionBy(*by, line).orderBy(order)
        df = spine.join(df, [*by, line, order], "left").withColumns({f"least_{r}": F.min(f"least_{r}").over(w.rowsBetween(-r, r)) for r in radii})
    return df.select(*by, "row", "col", *(f"least_{r}" for r in radii))


def scar_standing(change: DataFrame, scars: DataFrame, by: list[str], scar: str, radii: list[int]) -> DataFrame:
    """Each scar's (`by`, row, col) strongest loss within the first radius that holds a value, and where it stands in its group (per cent below it).

    Changes lie within -2 and 2. Up to 5 per cent is DETECTED, up to 10 MARGINAL; a scar without any value nearby is NO DATA.
    """
    near = least_around(change, by, "change", radii)
    met = scars.join(near, [*by, "row", "col"], "left")
    used = F.coalesce(*(F.when(F.col(f"least_{r}").isNotNull(), r) for r in radii))
    asked = met.select(*by, scar, used.alias("radius"), F.coalesce(*(f"least_{r}" for r in radii)).alias("scar_change")).withColumn("_at", (F.col("scar_change") + 2.0) / 4.0)
    known = change.filter("change is not null")
    items = known.select(*by, ((F.col("change") + 2.0) / 4.0).alias("_at"))
    ranked = counts_up_to(items, asked, by, "_at", "_above", descending=True)  # as large or larger; the rest is below
    strong = F.avg(F.when(F.col("change") < -0.15, 1.0).otherwise(0.0)) * 100
    stats = known.groupBy(*by).agg(F.count("*").alias("n_cells"), strong.alias("strong_loss_pct"))
    stats = stats.join(exact_quantiles(known, by, "change", {"median": 0.5, "p05": 0.05}), by)
    pct = 100.0 * (F.col("n_cells") - F.col("_above")) / F.col("n_cells")
    grade = F.when(F.col("scar_change").isNull(), "NO DATA").when(pct <= 5.0, "DETECTED").when(pct <= 10.0, "MARGINAL").otherwise("NOT DETECTED")
    out = ranked.join(stats, by).withColumns({"grade": grade, "deficit": F.col("median") - F.col("scar_change"), "percentile": F.when(F.col("scar_change").isNotNull(), pct)})
    return out.drop("_at", "_above")


def library_watch(scenes: DataFrame, library: DataFrame, by: list[str], time: str, path: str, unit: str) -> DataFrame:
    """For each group: the library's edge, the newest scene, scenes beyond the edge and their units, and the newest scene of each path.

    All scenes of a group without a library are new. Units and paths are the few of a constellation.
    """
    edge = library.groupBy(*by).agg(F.max(time).alias("library_through"))
    new = F.col("library_through").isNull() | (F.col(time) > F.col("library_through"))
    paths = scenes.join(edge, by, "left").groupBy(*by, path).agg(
        F.max("library_through").alias("library_through"), F.max(time).alias("_newest"), F.count_if(new).alias("_n"), F.collect_set(F.when(new, F.col(unit))).alias("_units"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col("_newest").alias("newest"))))
    return paths.groupBy(*by).agg(
        F.max("library_through").alias("library_through"), F.max("_newest").alias("newest"), F.sum("_n").alias("n_new"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_units")))).alias("new_units"), listed.alias("per_path"),
    )


def product_stream(products: DataFrame, by: list[str], date: str, level: str, wanted: str, known_through: str) -> DataFrame:
    """For each group: products, those of the wanted level, the newest date, dates later than what is known, and whether a stream has begun."""
    later = F.when(F.col(date) > F.lit(known_through).cast("date"), F.col(date))
    out = products.groupBy(*by).agg(F.count("*").alias("n_products"), F.count_if(F.col(level) == wanted).alias("n_wanted"), F.max(date).alias("newest_product"), F.count_distinct(later).alias("n_new_dates"))
    return out.withColumn("stream_started", F.col("n_new_dates") > 0)
