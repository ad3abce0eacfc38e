"""Structured Streaming twins of the rain operators.

The arrival of steps is a stream; a day's burst can only rise while steps come in, so that
days are provisional until the watermark has passed them. Daily series grow by whole,
gapless days, and state changes are told once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talus.functions import rain as R
from talus.operators.rain import bursts, contiguous_prefix
from talus.sources.files import append_new, table_exists

STEPS = "site string, ts timestamp, rate_mm_h double"


def read_steps(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Steps from the Parquet files of a folder, as they arrive."""
    return spark.readStream.schema(STEPS).option("maxFilesPerTrigger", per_batch).parquet(folder)


def daily_steps(steps: DataFrame, late: str = "2 days") -> DataFrame:
    """Steps and rain of each day, final once the watermark has passed it."""
    day = F.window("ts", "1 day")
    return (
        steps.withWatermark("ts", late).groupBy("site", day.alias("w")).agg(F.count("*").alias("n_steps"), (F.sum("rate_mm_h") * 0.5).alias("total_mm"))
        .select("site", F.to_date("w.start").alias("date"), "n_steps", "total_mm", (F.col("n_steps") < 48).alias("provisional"))
    )


def sliding_rain(steps: DataFrame, hours: int, late: str = "2 days") -> DataFrame:
    """Rain in windows of some hours that end every half hour."""
    w = F.window("ts", f"{hours} hours", "30 minutes")
    return steps.withWatermark("ts", late).groupBy("site", w.alias("w")).agg((F.sum("rate_mm_h") * 0.5).alias("mm")).select("site", F.col("w.end").alias("end_ts"), "mm")


#: Times (microseconds) and rates of the steps that are kept, and the first day that may still change (microseconds).
_STATE = "ts array<long>, rates array<double>, floor long"
_BURST = "site string, date date, n_steps int, total_mm double, max_e double, duration_h double, burst_mm double, window_end timestamp"
_DAY = 86_400_000_000


def day_bursts(ts: list[int], rates: list[float], first: int, spans: list[tuple[float, int, float]]) -> dict[int, tuple]:
    """day: steps, rain, largest ratio, its duration, rain and end, for the steps in order from place `first` on."""
    out: dict[int, tuple] = {}
    for i in range(first, len(ts)):
        n, total, e, h, mm, end = out.get(ts[i] // _DAY, (0, 0.0, 0.0, None, None, None))
        for span, k, threshold in spans:
            depth = sum(rates[max(0, i + 1 - k) : i + 1]) * 0.5
            ratio = depth / span / threshold
            if ratio > e or (ratio == e and h is not None and span < h):
                e, h, mm, end = ratio, span, depth, ts[i]
        out[ts[i] // _DAY] = n + 1, total + rates[i] * 0.5, e, h, mm, end
    return out


def burst_stream(steps: DataFrame, a: float, b: float, late_days: int = 2) -> DataFrame:
    """Each day's largest burst so far, told again whenever steps arrive that its windows hold (update mode).

    State holds a site's steps from `late_days` before its newest day on, and the steps of one longest window before
    them: steps may come late by so much, in any order and again. Older ones are left out. Windows are
    counted in steps, as in the batch operator.
    """
    spans = [(h, max(1, round(h / 0.5)), a * h**-b) for h in R.HOURS]
    longest = max(k for _, k, _ in spans)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old_ts, old_rates, floor = state.get if state.exists else ([], [], None)
        known = dict(zip(old_ts, old_rates, strict=True))
        new = pd.concat(list(frames)).dropna(subset=["ts"])
        micros = new["ts"].astype("datetime64[us]").astype("int64")
        fresh = {t: r for t, r in zip(micros.tolist(), new["rate_mm_h"].tolist(), strict=True) if t not in known and (floor is None or t >= floor)}
        known |= fresh
        ts = sorted(known)
        rates = [known[t] for t in ts]
        if fresh:
            start = min(fresh) // _DAY * _DAY
            days = day_bursts(ts, rates, bisect_left(ts, start), spans)
            rows = [(key[0], pd.Timestamp(d * _DAY, unit="us").date(), *v[:5], None if v[5] is None else pd.Timestamp(v[5], unit="us")) for d, v in days.items()]
            floor = (ts[-1] // _DAY - late_days) * _DAY
            keep = max(0, bisect_left(ts, floor) - longest)
            state.update((ts[keep:], rates[keep:], floor))
            yield pd.DataFrame(rows, columns=["site", "date", "n_steps", "total_mm", "max_e", "duration_h", "burst_mm", "window_end"])

    return steps.groupBy("site").applyInPandasWithState(run, _BURST, _STATE, "update", GroupStateTimeout.NoTimeout)


def told_to(folder: str):
    """A foreachBatch sink: each batch in a folder of its own, so that a batch that runs again replaces itself; `batch` is its number."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def upsert_days(folder: str, a: float, b: float):
    """A foreachBatch sink: days touched by a batch are computed anew from all their steps and written, one folder a day.

    Running a batch again gives the same files.
    """

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        append_new(batch.select("site", "ts", "rate_mm_h"), f"{folder}/steps", ["site", "ts"])
        touched = batch.select("site", F.to_date("ts").alias("date")).distinct()
        days = touched.unionByName(touched.withColumn("date", F.date_add("date", 1))).distinct()  # windows reach into the next day
        near = days.select("site", F.explode(F.sequence(F.date_sub("date", 1), F.col("date"))).alias("d")).distinct()
        steps = spark.read.parquet(f"{folder}/steps").withColumn("d", F.to_date("ts")).join(near, ["site", "d"], "left_semi").drop("d")
        found = bursts(steps, ["site"], a, b).join(days, ["site", "date"], "left_semi")
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site", "date").parquet(f"{folder}/days")

    return sink


def append_contiguous(path: str):
    """A foreachBatch sink for daily rows (site, date, ...): only days that follow the last one without a gap are added."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        held = spark.read.parquet(path) if table_exists(spark, path) else batch.limit(0)
        last = held.groupBy("site").agg(F.max("date").alias("last"))
        fresh = batch.dropDuplicates(["site", "date"]).join(last, "site", "left").filter("last is null or date > last")
        first = batch.groupBy("site").agg(F.date_sub(F.min("date"), 1).alias("before"))
        start = fresh.join(first, "site").withColumn("last", F.coalesce("last", "before")).drop("before")
        append_new(contiguous_prefix(start, ["site"], "last").drop("last"), path, ["site", "date"])

    return sink


def level_changes(days: DataFrame) -> DataFrame:
    """Days (site, date, alarm_level) on which the level changes, and all ALERT days; the last day and level are kept as state.

    A day that is no later than the last one told (a replay, or one that comes late) tells nothing.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, None)
        out = []
        for row in pd.concat(list(frames)).sort_values("date").itertuples():
            if seen is not None and row.date <= seen:
                continue
            if row.alarm_level != last or row.alarm_level == "ALERT":
                out.append((key[0], row.date, row.alarm_level, last))
            last, seen = row.alarm_level, row.date
        state.update((last, seen))
        yield pd.DataFrame(out, columns=["site", "date", "alarm_level", "previous"])

    return days.groupBy("site").applyInPandasWithState(run, "site string, date date, alarm_level string, previous string", "last string, seen date", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, checkpoint: str, mode: str, sink=None, table: str | None = None) -> StreamingQuery:
    """Run a stream over what is there, to the end; a later call goes on from the checkpoint."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("memory").queryName(table)).start()
    q.awaitTermination()
    return q
