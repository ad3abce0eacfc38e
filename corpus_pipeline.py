"""From raw documents to a training mix: quality, near duplicates, benchmark passages, secrets, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's `docs`; tables that a stage stores on its way are
deleted when the next one is called in the same thread, so its output has to be written by then.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import dropped, recorded, stored
from talus.llm.decontamination import decontaminated
from talus.llm.mixing import with_draws
from talus.llm.neardup import near_duplicates
from talus.llm.quality import accepted
from talus.llm.secrets import without_secrets


class _OnTheWay(threading.local):
    """Folders that the stage called last has stored on its way; runs in several threads have their own."""

    def __init__(self) -> None:
        self.folders: list[str] = []


_on_the_way = _OnTheWay()


def _stage(f: Callable) -> Callable:
    first = f.__name__ == "quality"  # starts a run, and leaves what another run's last stage has stored

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if first:
            _on_the_way.folders.clear()
        else:
            dropped(spark, _on_the_way.folders)
        with recorded(_on_the_way.folders):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more, the one with the smallest doc_id."""
    dropped = near_duplicates(docs, 80, 100).filter(~F.col("kept")).select("doc_id").distinct()
    # a merge join at every size: the dropped ids grow with the input, and small inputs should plan like large ones
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def scrub_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts made asterisks."""
    return without_secrets(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are drawn, with how often (n_copies), where in their source's permutation (slot), and its weight.

    Rows of one doc_id with different texts are drawn each; rows that are equal in doc_id, source and
    text are drawn alike, as often as the one drawn most. Columns of these three names are replaced.
    """
    return with_draws(docs.drop("n_copies", "slot", "weight"), entropy_share=0.98, max_repetition=4.0)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("scrub_secrets", scrub_secrets),
    ("mix_sources", mix_sources),
]

#: SQL expresses neither the classifier nor the similarity join; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs: list[str] = []
    for name, stage in STAGES[:-1]:
        kept, before = stage(spark, docs, sf_dir), [*outputs]
        outputs.clear()
        with recorded(outputs):
            docs = stored(kept, f"pipeline-{name}")
        dropped(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
