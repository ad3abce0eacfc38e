"""The manifest of products: which stack a product belongs to, from job names or, for old products, from the time of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.geo import label_of_job, label_parts, pair_dates
from talus.sources.files import table_exists
from talus.sources.storage import stored

FIELDS = ("product", "stack", "source", "direction", "path", "frame")


def _entries(df: DataFrame, stack: Column, source: str) -> DataFrame:
    labelled = df.select("product", stack.alias("stack"), F.lit(source).alias("source"))
    return labelled.withColumns(dict(zip(("direction", "path", "frame"), label_parts(F.col("stack")), strict=True)))


def label_by_time(product: Column, hours: list[tuple[str, str, str]]) -> Column:
    """The label whose half-open span of the day (hhmmss, hhmmss, label) holds the product's first time; else `unknown`."""
    at = F.date_format(pair_dates(product)[0], "HHmmss")
    spans = [F.when((at >= low) & (at < high), label) for low, high, label in hours]
    return F.coalesce(*spans, F.lit("unknown"))


def bootstrap(products: DataFrame, hours: list[tuple[str, str, str]]) -> DataFrame:
    """Entries of products that were there before job names told their stack."""
    return _entries(products, label_by_time(F.col("product"), hours), "legacy_bootstrap")


def entries_of_jobs(jobs: DataFrame, prefix: str) -> DataFrame:
    """Entries of jobs (name, file) whose name begins with the prefix and states a stack; of several jobs of a product the last name counts."""
    known = jobs.filter(F.startswith("name", F.lit(prefix)) & F.col("file").isNotNull())
    labelled = known.select(F.regexp_replace("file", r"\.zip$", "").alias("product"), "name").groupBy("product").agg(F.max("name").alias("name"))
    return _entries(labelled, label_of_job(F.col("name"), prefix), "metadata").filter("stack <> 'unknown'")


def lookup(products: DataFrame, manifest: DataFrame, hours: list[tuple[str, str, str]]) -> DataFrame:
    """Products with their stack: from the manifest, else from the time of day, else `unknown`."""
    known = manifest.select("product", F.col("stack").alias("_stack"))
    return products.join(known, "product", "left").withColumn("stack", F.coalesce("_stack", label_by_time(F.col("product"), hours))).drop("_stack")


def covered(manifest: DataFrame, epochs: DataFrame) -> DataFrame:
    """Entries both of whose dates are among the epochs (stack, date) at hand."""
    first, second = pair_dates(F.col("product"))
    dated = manifest.withColumns({"ref": F.to_date(first), "sec": F.to_date(second)})
    for side in ("ref", "sec"):
        dated = dated.join(epochs.select("stack", F.col("date").alias(side)), ["stack", side], "left_semi")
    return dated.select(*manifest.columns, "ref", "sec")


class Manifest:
    """Entries in a folder, added in numbered batches; of a product the newest batch counts.

    Nothing is overwritten, so that readers see whole batches only; a batch that changes nothing is not written.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self) -> DataFrame:
        schema = "product string, stack string, source string, direction string, path int, frame int, batch int"
        return self.spark.read.schema(schema).parquet(self.folder) if table_exists(self.spark, self.folder) else self.spark.createDataFrame([], schema)

    def load(self) -> DataFrame:
        """The newest entry of each product."""
        entry = F.max_by(F.struct(*FIELDS[1:]), "batch").alias("e")
        return self._batches().groupBy("product").agg(entry).select("product", "e.*")

    def update(self, entries: DataFrame) -> int:
        """Add what is new or differs; how many entries were written."""
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in FIELDS]
        agree = same[0]
        for c in same[1:]:
            agree = agree & c
        fresh = stored(entries.select(*FIELDS).alias("a").join(self.load().alias("b"), agree, "left_anti"), "manifest-batch")  # the folder grows below
        n = fresh.count()
        if n:
            batch = self._batches().agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0] + 1
            fresh.withColumn("batch", F.lit(batch)).write.mode("append").parquet(self.folder)
        return n
