"""A store of fetched time windows: what is asked for and not held yet is fetched once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.sources.storage import stored


def missing_windows(asked: DataFrame, held: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The longest stretches (start, end; the end is out) that windows of `asked` cover and none of `held` does.

    Starts and ends are steps up and down; sums over them in order tell how many windows of either kind are open, and
    neighbouring stretches that are asked for and not held are one. Empty windows and those with a null end count as none.
    """
    steps = None
    for df, name in ((asked, "_asked"), (held, "_held")):
        w = df.filter(F.col(start) < F.col(end))
        both = w.select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("s"))
        one = both.select(*by, "s.at", *(F.col("s.d").alias(n) if n == name else F.lit(0).alias(n) for n in ("_asked", "_held")))
        steps = one if steps is None else steps.unionByName(one)
    line = Window.partitionBy(*by).orderBy("at")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    each = steps.groupBy(*by, "at").agg(F.sum("_asked").alias("_asked"), F.sum("_held").alias("_held"))
    lacks = (F.sum("_asked").over(so_far) > 0) & (F.sum("_held").over(so_far) == 0)
    state = each.withColumn("_lacks", lacks).withColumn("_was", F.coalesce(F.lag("_lacks").over(line), F.lit(False)))
    turns = state.filter(F.col("_lacks") != F.col("_was"))
    return turns.withColumn("_end", F.lead("at").over(line)).filter("_lacks").select(*by, F.col("at").alias(start), F.col("_end").alias(end))


class WindowStore:
    """Rows by window in a folder: a window counts once its line in the ledger is written, after its rows."""

    def __init__(self, spark: SparkSession, folder: str, by: list[str], row_schema: str, time: str, kind: str = "timestamp") -> None:
        self.spark, self.folder, self.by, self.time = spark, folder.rstrip("/"), by, time
        self.row_schema = row_schema
        keys = ", ".join(f"{c} {f}" for c, f in self._kinds().items() if c in by)
        self.ledger_schema = f"{keys}, start {kind}, end {kind}, attempt string"

    def _kinds(self) -> dict[str, str]:
        empty = self.spark.createDataFrame([], self.row_schema)
        return {f.name: f.dataType.simpleString() for f in empty.schema}

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(str(path)) if there else self.spark.createDataFrame([], schema)

    def held(self) -> DataFrame:
        """The windows that are held: `by`, start, end, attempt."""
        return self._read("ledger", self.ledger_schema)

    def rows(self) -> DataFrame:
        """All rows of windows that are held, each once; rows of an attempt that was not finished are not among them."""
        rows = self._read("rows", f"{self.row_schema}, attempt string")
        return rows.join(self.held().select("attempt").distinct(), "attempt", "left_semi").drop("attempt")

    def ensure(self, asked: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Fetch what of `asked` (`by`, start, end) is not held; the windows that were fetched.

        `fetch` takes windows and gives rows; rows outside the windows are left out. With nothing missing it is not called.
        """
        attempt = uuid.uuid4().hex
        need = missing_windows(asked, self.held(), self.by).withColumn("attempt", F.lit(attempt))
        need = stored(need, "windows-missing")  # the ledger grows below
        if need.isEmpty():
            return need.drop("attempt")
        got = fetch(need.drop("attempt"))
        inside = (F.col(self.time) >= F.col("_w.start")) & (F.col(self.time) < F.col("_w.end"))
        kept = got.join(need.select(*self.by, F.struct("start", "end").alias("_w")), self.by).filter(inside).drop("_w")
        kept.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.folder}/rows")
        need.write.mode("append").parquet(f"{self.folder}/ledger")
        return self.held().filter(F.col("attempt") == attempt).drop("attempt")
