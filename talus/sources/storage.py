"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

class _Open(threading.local):
    """Lists that take down the folders that `stored` writes, innermost last; each thread has its own."""

    def __init__(self) -> None:
        self.lists: list[list[str]] = []


_open = _Open()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a local session (tests) may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="talus-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors.

    Within `recorded` the folder is taken down, so that `dropped` can delete it; else it is left to the folder's owner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open.lists:
        _open.lists[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded(folders: list[str]) -> Iterator[None]:
    """Folders that `stored` writes within, in this thread, are added to the list."""
    _open.lists.append(folders)
    try:
        yield
    finally:
        _open.lists.pop()


def dropped(spark: SparkSession, folders: list[str]) -> None:
    """Delete the folders and empty the list; nothing that reads them may be used after it."""
    while folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
