"""Operators on any table: ordering, first rows, subsamples, sources by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.validation import ordinal_ranks


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; the order should leave no ties."""
    return df.orderBy(*order).limit(n)


def ranked(df: DataFrame, by: list, order: list[Column]) -> DataFrame:
    """`place` of each row in its group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_of(df: DataFrame, by: list, order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return ranked(df, by, order).filter("place = 1").drop("place")


def every(df: DataFrame, by: list[str], order: str, tie: str, step: int) -> DataFrame:
    """Every step-th row of each group, from the first; rows are numbered within ranges of the order."""
    return ordinal_ranks(df, by, order, tie).filter((F.col("rank") - 1) % step == 0).drop("rank")


def newer(scenes: DataFrame, library: DataFrame, by: list[str], time: str) -> DataFrame:
    """For each group: scenes newer than the library's newest, and the newest of them."""
    edge = library.groupBy(*by).agg(F.max(time).alias("_edge"))
    return scenes.join(edge, by).filter(F.col(time) > F.col("_edge")).groupBy(*by).agg(F.count("*").alias("n_new"), F.max(time).alias("newest"))


def first_source(keys: DataFrame, sources: list[DataFrame], on: str, value: str, default: str) -> DataFrame:
    """Each key with the value of the first source that has one."""
    joined = reduce(lambda d, s: d.join(s[1].select(on, F.col(value).alias(f"_{s[0]}")), on, "left"), enumerate(sources), keys)
    cells = [F.col(f"_{i}") for i in range(len(sources))]
    return joined.withColumn(value, F.coalesce(*cells, F.lit(default))).drop(*(f"_{i}" for i in range(len(sources))))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without those that have a new version, and all new ones."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)
