"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.sources.storage import dropped, recorded, stored

__all__ = ["bounded", "byte_views", "dropped", "fold", "integer_id", "majority", "recorded", "sampled", "sampled_edge", "stored"]

_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def integer_id(docs: DataFrame) -> Column:
    """doc_id as a long, for operators that order documents by it; TypeError if it is no integer."""
    if (kind := docs.schema["doc_id"].dataType.simpleString()) not in _INTEGERS:
        raise TypeError(f"doc_id must be an integer, not {kind}")
    return F.col("doc_id").cast("long").alias("doc_id")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus))


def byte_views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each text of an Arrow string column without copying; None for null."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1] if len(column) else []
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid[i] else None


def bounded(df: DataFrame, key: str, bound: int, counted: DataFrame | None = None) -> DataFrame:
    """About `bound` rows of `df` at most, chosen by a hash of `key`; all rows if there are fewer.

    `counted` is a cheaper frame with as many rows, to count instead of `df`.
    """
    n = (df if counted is None else counted).count()
    return df if n <= bound else df.filter(sampled(bound / n, key))


def sampled(share: float, *keys: str) -> Column:
    """Whether a row falls in a share of all rows, by the 64-bit hash of its keys: shares of 1 in 10^15 still draw some."""
    return F.xxhash64(F.lit("sample"), *keys) <= F.lit(sampled_edge(share))


def sampled_edge(share: float) -> int:
    """The 64-bit hash up to which a share of all rows lies."""
    return min(int(share * 2.0**64) - 2**63, 2**63 - 1)


def majority(labels: DataFrame, column: str) -> DataFrame:
    """One row for each doc_id: doc_id and label (0.0 or 1.0), the majority of repeated labels; ties are 1."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.when(F.avg(F.col(column).cast("double")) >= 0.5, 1.0).otherwise(0.0).alias("label"))
    )
