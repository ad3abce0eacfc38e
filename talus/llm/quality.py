"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of statistics, transformed towards normal shape. Class
means and covariances are sums that Spark aggregates over all labelled rows;
covariances shrink towards the pooled one and towards a multiple of the identity.
The score is the logistic of the difference of the class log-densities, computed
from Mahalanobis distances with Cholesky factors made once on the driver.

Edge cases: a null text counts as empty; empty texts get a score like any other
(all their counts are zero); repeated rows are scored each; with no labelled rows, or
labels of one class only, every score is 0.5 (1 and 0 classes: 1.0 and 0.0); other
columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.common import byte_views, fold, majority, stored

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "punct", "symbol", "bang", "pipe",
    "symbol_end", "upper_words", "distinct_words", "top_word", "adjacent_same", "distinct_lines", "line_words", "stop_end",
)

_UPPER, _LOWER, _DIGIT, _SPACE, _PUNCT, _SYMBOL = range(6)


def _classes() -> np.ndarray:
    table = np.full(256, _LOWER, np.uint8)
    for c in range(128):
        ch = chr(c)
        table[c] = _UPPER if ch.isupper() else _LOWER if ch.islower() else _DIGIT if ch.isdigit() else _SPACE if c <= 32 else _PUNCT if ch in ".,;:'\"-()?!" else _SYMBOL
    return table


_TABLE = _classes()


def statistics(text: np.ndarray | None) -> list[float]:
    """The vector of STATISTICS of one text, given as UTF-8 bytes."""
    b = np.empty(0, np.uint8) if text is None else text
    raw = b.tobytes()
    n = max(len(b), 1)
    counts = np.bincount(_TABLE[b], minlength=6) if len(b) else np.zeros(6)
    words = raw.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    ends = _TABLE[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)] if words else np.zeros(1, np.uint8)
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    _, each = np.unique(codes, return_counts=True) if words else (None, np.ones(1))
    lines = [x for x in raw.split(b"\n") if x]
    letters = max(counts[_UPPER] + counts[_LOWER], 1)
    upper_words = sum(map(bytes.isupper, words))
    share = lambda x, of: np.sqrt(x / of)
    return [
        np.log1p(len(b)),
        np.log1p(len(words)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        share(counts[_UPPER], letters),
        share(counts[_DIGIT], n),
        share(counts[_PUNCT], n),
        share(counts[_SYMBOL], n),
        share(raw.count(b"!"), n),
        share(raw.count(b" | "), m),
        share(np.count_nonzero(ends == _SYMBOL), m),
        share(upper_words, m),
        np.log(len(each) / m) / np.log(m + 2.0),
        share(each.max(), m),
        share(np.count_nonzero(codes[1:] == codes[:-1]), m),
        share(len(set(lines)), max(len(lines), 1)),
        np.log1p(len(words) / max(len(lines), 1)),
        share(raw.count(b"."), m),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and `stats` (array<double>, in the order of STATISTICS) for each row of `docs`."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<double>"
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x) for x in byte_views(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "stats"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def class_moments(rows: DataFrame) -> dict[float, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of `stats` for each `label`, as Spark aggregates them."""
    p = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[float, np.ndarray] = {}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for k in np.unique(label):
                own = np.hstack([np.ones((int((label == k).sum()), 1)), x[label == k]])
                sums[k] = sums.get(k, 0) + own.T @ own
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, k)), pa.array(np.arange(s.size)), pa.array(s.ravel())], ["label", "cell", "v"])

    cells = rows.select("label", "stats").mapInArrow(run, "label double, cell long, v double").groupBy("label", "cell").agg(F.sum("v").alias("v"))
    out: dict[float, np.ndarray] = {}
    for r in cells.collect():  # 2 x (p + 1)^2 numbers, whatever the input
        out.setdefault(r["label"], np.zeros((p + 1) * (p + 1)))[r["cell"]] = r["v"]
    tables = {k: v.reshape(p + 1, p + 1) for k, v in out.items()}
    return {k: (t[0, 0], t[0, 1:], t[1:, 1:]) for k, t in tables.items()}


class Discriminant:
    """Class means and Cholesky factors of the shrunk covariances."""

    def __init__(self, moments: dict[float, tuple[float, np.ndarray, np.ndarray]], shrink: float, ridge: float) -> None:
        self.only = None
        if set(moments) != {0.0, 1.0}:
            self.only = next(iter(moments), 0.5)
            return
        total = sum(m[0] for m in moments.values())
        mean = sum(m[1] for m in moments.values()) / total
        self.scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values()) / total) - mean**2, 1e-8))
        self.centre = mean
        own = {}
        for k, (n, s, q) in moments.items():
            mu = (s / n - mean) / self.scale
            cov = (q / n - np.outer(s / n, s / n)) / np.outer(self.scale, self.scale)
            own[k] = n, mu, cov
        pooled = sum(n * cov for n, _, cov in own.values()) / total
        self.parts = {}
        for k, (n, mu, cov) in own.items():
            c = (1 - shrink) * cov + shrink * pooled
            c = (1 - ridge) * c + ridge * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            self.parts[k] = np.log(n / total), mu, np.linalg.inv(factor), np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        if self.only is not None:
            return np.full(len(x), float(self.only))
        z = (x - self.centre) / self.scale
        log = {k: prior - det - 0.5 * (((z - mu) @ inverse.T) ** 2).sum(axis=1) for k, (prior, mu, inverse, det) in self.parts.items()}
        return 1 / (1 + np.exp(np.clip(log[0.0] - log[1.0], -500, 500)))


def fit_quality(stats: DataFrame, labels: DataFrame, train_on=None, shrink: float = 0.3, ridge: float = 0.05) -> Discriminant:
    """The discriminant of labelled rows of `stats` (doc_id, stats).

    `train_on` is a condition on doc_id: only labels of rows that meet it are learned.
    `shrink` moves class covariances to the pooled one, `ridge` to a multiple of the identity.
    """
    known = majority(labels, "quality")
    if train_on is not None:
        known = known.filter(train_on)
    return Discriminant(class_moments(stats.join(known, "doc_id")), shrink, ridge)


def score_quality(docs: DataFrame, labels: DataFrame, train_on=None, shrink: float = 0.3, ridge: float = 0.05) -> DataFrame:
    """doc_id and score (probability that quality is 1) for each row of `docs`; see fit_quality."""
    stats = stored(document_statistics(docs), "quality-stats")
    model = fit_quality(stats, labels, train_on, shrink, ridge)
    p = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, that score `least` or more; no shuffle of texts.

    Rows are stored with their statistics, which are made once: the labelled ones among them
    (all of their labels) fit the model, and all are scored by it, those that it was fitted on too.
    """
    at = docs.columns.index("text")
    name = next(c for c in ("stats", *(f"stats{i}" for i in range(len(docs.columns) + 1))) if c not in docs.columns)
    kind, p = pa.list_(pa.float64()), len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in byte_views(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, name])

    known = stored(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])), "quality-rows")
    model = fit_quality(known.select("doc_id", F.col(name).alias("stats")), labels)

    @F.pandas_udf(T.BooleanType())
    def good(stats: pd.Series) -> pd.Series:
        x = np.array(stats.to_list(), float).reshape(-1, p)
        return pd.Series(model.score(x) >= least)

    return known.filter(good(F.col(name))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 3) == 1
    return score_quality(docs, labels, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
