"""Queries that run as streams over arriving tables; their results equal the batch ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import rain as R
from talus.plans.rain import A, B, calendar
from talus.plans.registry import SQL, query, r6
from talus.sources.proxies import px_burst, px_daily
from talus.sources.storage import shared_folder
from talus.streaming import rain as S


def _arrivals(df: DataFrame, time: str, parts: int, folder: str):
    """Append `df` to a folder in parts of the time axis, one after the other."""
    lo, hi = df.agg(F.min(F.unix_timestamp(time)), F.max(F.unix_timestamp(time))).first()
    if lo is None:
        df.write.parquet(folder)
        yield
        return
    part = F.least(F.floor((F.unix_timestamp(time) - lo) * parts / max(hi - lo, 1)), F.lit(parts - 1))
    for k in range(parts):
        df.filter(part == k).write.mode("append").parquet(folder)
        yield


def _fresh(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/live-{uuid.uuid4().hex}"


@query("t01_live_bursts", SQL["w05_burst_daily"])
def live_bursts(spark, sf_dir: str) -> DataFrame:
    """Bursts told by a stateful stream as steps arrive in four parts; each day's last telling."""
    top = _fresh(spark)
    steps = px_burst(spark, sf_dir).select("site", "ts", "rate_mm_h")
    for _ in _arrivals(steps, "ts", 4, f"{top}/steps"):
        stream = spark.readStream.schema(S.STEPS).parquet(f"{top}/steps")
        S.run_available(S.burst_stream(stream, A, B), f"{top}/checkpoint", "update", S.told_to(f"{top}/told"))
    told = spark.read.parquet(f"{top}/told")
    last = told.groupBy("site", "date").agg(F.max_by(F.struct(*(c for c in told.columns if c not in ("site", "date"))), "batch").alias("r")).select("site", "date", "r.*")
    return last.select(
        "site", "date", F.col("n_steps").cast("long").alias("n_steps"), (F.col("n_steps") < 48).alias("provisional"), "total_mm", "max_e", R.alarm_level(F.col("max_e"), 3.0).alias("level"),
        "duration_h", "burst_mm", (F.col("burst_mm") / F.col("duration_h")).alias("peak_mmph"), "window_end",
    ).withColumns(r6("total_mm", "max_e", "burst_mm", "peak_mmph"))


@query("t02_live_days", SQL["w13_contiguous_prefix"])
def live_days(spark, sf_dir: str) -> DataFrame:
    """Daily rows appended by a stream, up to the first missing day."""
    top = _fresh(spark)
    wet = px_daily(spark, sf_dir).filter("rain_mm is not null").select("site", "date")
    for _ in _arrivals(wet, "date", 3, f"{top}/days"):
        stream = spark.readStream.schema("site string, date date").parquet(f"{top}/days")
        S.run_available(stream, f"{top}/checkpoint", "append", S.append_contiguous(f"{top}/kept"))
    return spark.read.parquet(f"{top}/kept")


@query("t05_live_changes", SQL["w14_state_changes"])
def live_changes(spark, sf_dir: str) -> DataFrame:
    """Level changes told by a stream that keeps each site's last level."""
    top = _fresh(spark)
    days = calendar(spark, sf_dir).select("site", "date", "alarm_level")
    for _ in _arrivals(days, "date", 3, f"{top}/days"):
        stream = spark.readStream.schema("site string, date date, alarm_level string").parquet(f"{top}/days")
        S.run_available(S.level_changes(stream), f"{top}/checkpoint", "append", S.told_to(f"{top}/told"))
    return spark.read.parquet(f"{top}/told").select("site", "date", "alarm_level", "previous")
