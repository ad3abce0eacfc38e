"""Quality tables of products: mask statistics, regressions, decisions and group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.geo import joined_reasons


def mask_statistics(pixels: DataFrame, by: list[str], value: str, coherence: str, least: float = 0.4) -> DataFrame:
    """Pixels in all, without coherence, below the limit and surviving; their share and mean coherences."""
    n, coh = F.count("*"), F.col(coherence)
    alive = (coh >= least) & F.col(value).isNotNull()
    return pixels.groupBy(*by).agg(
        n.alias("total_pixels"), F.count_if(coh.isNull()).alias("null_in_coh"), F.count_if(coh < least).alias("masked_below_threshold"),
        F.count_if(alive).alias("surviving_pixels"), (F.count_if(alive) * 100.0 / n).alias("surviving_pct"),
        F.avg(coh).alias("mean_coherence_all"), F.avg(F.when(alive, coh)).alias("mean_coherence_survivors"),
    )


def regression_audit(pixels: DataFrame, by: list[str], y: str, x: str, least_pixels: int = 1000, least_range: float = 50.0, quarantine: float = 0.5, concern: float = 0.3) -> DataFrame:
    """Correlation and line of y on x over rows that have both, from sums, and the class that follows."""
    both = pixels.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = both.groupBy(*by).agg(F.count("*").alias("n_valid_pixels"), F.min(a).alias("elev_min"), F.max(a).alias("elev_max"), F.avg(a).alias("_mx"), F.avg(b).alias("_my"), F.var_pop(a).alias("_vx"), F.var_pop(b).alias("_vy"), F.covar_pop(a, b).alias("_c"))
    spread = (F.col("_vx") > 0) & (F.col("_vy") > 0)
    r = F.when(spread, F.try_divide(F.col("_c"), F.sqrt(F.col("_vx") * F.col("_vy"))))
    slope = F.when(F.col("_vx") > 0, F.try_divide(F.col("_c"), F.col("_vx")))
    out = s.select(*by, "n_valid_pixels", "elev_min", "elev_max", (F.col("elev_max") - F.col("elev_min")).alias("elev_range"), r.alias("pearson_r"), (r * r).alias("r_squared"), slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"))
    short = (F.col("n_valid_pixels") < least_pixels) | (F.col("elev_range") < least_range)
    return out.withColumn("classification", F.when(short, "INSUFFICIENT_DATA").when(F.col("r_squared") >= quarantine, "QUARANTINE").when(F.col("r_squared") >= concern, "CONCERN").otherwise("CLEAN"))


def decide(stats: DataFrame, audit: DataFrame, on: str, least_coherence: float = 0.6, least_pct: float = 30.0) -> DataFrame:
    """Full outer join of mask statistics and audit: KEEP, CONCERN or QUARANTINE, with reasons.

    A side that is missing is named so; what nothing speaks against is kept.
    """
    a = stats.select(on, F.coalesce("status", F.lit("ok")).alias("coh_status"), "surviving_pct", F.col("mean_coherence_survivors").alias("mean_coh_survivors"))
    b = audit.select(on, F.col("r_squared").alias("atmos_r_squared"), F.col("classification").alias("atmos_class"))
    j = a.join(b, on, "full").withColumns({"coh_status": F.coalesce("coh_status", F.lit("missing")), "atmos_class": F.coalesce("atmos_class", F.lit("missing"))})
    ok, coh, pct = F.col("coh_status") == "ok", F.coalesce("mean_coh_survivors", F.lit(0.0)), F.coalesce("surviving_pct", F.lit(0.0))
    cls = F.col("atmos_class")
    decision = F.when((cls == "QUARANTINE") | (ok & (coh < least_coherence)), "QUARANTINE").when(cls == "CONCERN", "CONCERN").otherwise("KEEP")
    reasons = joined_reasons(
        F.when(~ok, F.concat(F.lit("coh_status="), "coh_status")), F.when(ok & (coh < least_coherence), F.lit("low_coh_surv")),
        F.when(ok & (pct < least_pct), F.lit("low_surv_pct")), F.when(cls == "QUARANTINE", F.lit("atmos_R2")), F.when(cls == "CONCERN", F.lit("atmos_concern_R2")),
    )
    return j.withColumns({"decision": decision, "reasons": reasons})


def contamination_flags(audit: DataFrame, jobs: DataFrame, on: str) -> DataFrame:
    """Audit rows with job ids where known; contaminated above 0.5 on four decimals, unknown counts as not."""
    r2 = F.bround("r_squared", 4)
    return audit.join(jobs.select(on, "job_id"), on, "left").select(on, "job_id", r2.alias("r_squared"), F.coalesce(r2 > 0.5, F.lit(False)).alias("is_contaminated"))


def apply_rescues(decisions: DataFrame, rescues: DataFrame, on: str) -> DataFrame:
    """Decisions with rescued products kept and the reason added; `outcome` says promoted, already_keep or none."""
    r = rescues.select(on, F.col("bridges").alias("_bridges")).dropDuplicates([on])
    j = decisions.join(r, on, "left")
    hit = F.col("_bridges").isNotNull()
    promoted = hit & (F.col("decision") != "KEEP")
    note = F.concat(F.lit("RESCUED_FOR_CONNECTIVITY (was "), "decision", F.lit(", bridges: "), "_bridges", F.lit(")"))
    reasons = F.when(promoted, F.concat_ws("; ", F.nullif("reasons", F.lit("")), note)).otherwise(F.col("reasons"))
    outcome = F.when(promoted, "promoted").when(hit, "already_keep")
    return j.withColumns({"outcome": outcome, "reasons": reasons, "decision": F.when(promoted, "KEEP").otherwise(F.col("decision"))}).drop("_bridges")


def group_counts(df: DataFrame, by: list[str], over: str, values: list[str]) -> DataFrame:
    """Rows of each group by the given values of a column, side by side."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(over) == v).alias(f"n_{v.lower()}") for v in values), F.count("*").alias("n_all"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Number, smallest, 5th percentile, median, 95th percentile, largest, mean and deviation of each group; all exact."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), p.alias("_p"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(*by, "n", "min", F.col("_p")[0].alias("p5"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("p95"), "max", "mean", "std")


def robust_noise(df: DataFrame, by: list[str], value: str, least: int = 100) -> DataFrame:
    """1.4826 times the median distance from the median; null for fewer than `least` values."""
    med = df.groupBy(*by).agg(F.median(value).alias("_m"), F.count(value).alias("_n"))
    away = df.filter(F.col(value).isNotNull()).join(med, by).groupBy(*by).agg((F.median(F.abs(F.col(value) - F.col("_m"))) * 1.4826).alias("sigma"), F.first("_n").alias("n"))
    return away.select(*by, "n", F.when(F.col("n") >= least, F.col("sigma")).alias("sigma"))


def overlap(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """Sizes of two masks, of what they share and cover together, and their intersection over union."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    counts = df.groupBy(*by).agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("n_both"), F.count_if(a | b).alias("n_any"))
    return counts.withColumn("iou", F.try_divide(F.col("n_both").cast("double"), F.col("n_any").cast("double")))


def low_tail(df: DataFrame, by: list[str], value: str, scar: str, strong: float) -> DataFrame:
    """Number, median and 5th percentile of values, share of strong losses, and where the scar's value stands from below (per cent)."""
    v = F.col(value)
    out = df.filter(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n_pixels"), F.percentile(v, F.array(F.lit(0.5), F.lit(0.05))).alias("_p"), (F.avg(F.when(v < strong, 1.0).otherwise(0.0)) * 100).alias("pct_strong_loss"), (F.avg(F.when(v < F.col(scar), 1.0).otherwise(0.0)) * 100).alias("scar_percentile"))
    return out.select(*by, "n_pixels", F.col("_p")[0].alias("median"), F.col("_p")[1].alias("p05"), "pct_strong_loss", "scar_percentile")


def method_comparison(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Two methods on the rows that have both: deviations, reduction in per cent, correlation, centred RMS difference."""
    x, y = F.col(a), F.col(b)
    s = df.filter(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop(x).alias("std_a"), F.stddev_pop(y).alias("std_b"), F.covar_pop(x, y).alias("_c"), F.stddev_pop(x - y).alias("rms"))
    return s.select(*by, "n", "std_a", "std_b", ((1 - F.try_divide(F.col("std_b"), F.col("std_a"))) * 100).alias("reduction_pct"), F.try_divide(F.col("_c"), F.col("std_a") * F.col("std_b")).alias("r"), "rms")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that stand in one of two tables only, with the side; as often as they stand there more often than in the other.

    Both tables are counted in one aggregation, one with a minus.
    """
    more = F.sum("_side")
    counted = a.withColumn("_side", F.lit(1)).union(b.withColumn("_side", F.lit(-1))).groupBy(*a.columns).agg(more.alias("_more")).filter("_more <> 0")
    each = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_more"))))
    return each.select(*a.columns, F.when(F.col("_more") > 0, "left").otherwise("right").alias("side"))
