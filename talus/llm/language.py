"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (code points) of the lower-cased text, with each run of
other characters than letters made one space, are hashed to buckets. Document frequencies are counted over all rows that may
be learned from. Weights are trained with follow-the-regularised-leader and an
elastic-net penalty on a bounded sample that is dealt evenly to the languages, and a temperature fitted on a part of the sample that
was not trained on turns them into probabilities.

Edge cases: null texts and texts without a letter are `und` with score 0; with no row
to learn from, every text is `und`; ties go to the language first in the alphabet;
long texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import fold, sampled_edge
from talus.llm.hashing import mixed

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Languages whose shares of the sample are broadcast at most; more meet the texts in a shuffle.
MOST_BROADCAST = 10_000


@cache
def _letters() -> np.ndarray:
    """Which code points are letters, by Unicode."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(low: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a lower-cased text, and the count of each."""
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, np.uint32(32))
    if len(c) > 1:
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    one = mixed(c.astype(np.uint64) + np.uint64(1 << 32))
    two = mixed(one[:-1] * np.uint64(3) + c[1:])
    three = mixed(two[:-1] * np.uint64(3) + c[2:])
    buckets = np.concatenate([one, two, three]) & np.uint64(BUCKETS - 1)
    if len(buckets) < BUCKETS // 16:
        at, counts = np.unique(buckets.astype(np.int64), return_counts=True)
        return at, counts
    counts = np.bincount(buckets.astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of unit length."""
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def _lowered(docs: DataFrame) -> DataFrame:
    """`low`: the text in lower case, null if it has no letter."""
    return docs.withColumn("low", F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """In how many rows of `docs` (with `low` and `lang`) each bucket stands, and how many rows each language has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, langs = np.zeros(BUCKETS, np.int64), Counter()
        for batch in batches:
            langs.update(batch.column(1).to_pylist())
            for text in batch.column(0).to_pylist():
                df[ngrams(text)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*at, *[-1] * len(langs)], pa.int64()), pa.array([*[None] * len(at), *langs], pa.string()), pa.array([*df[at], *langs.values()], pa.int64())], ["bucket", "lang", "n"]
        )

    total, rows = np.zeros(BUCKETS, np.int64), {}
    counted = docs.select("low", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "bucket long, lang string, n long")
    for r in counted.groupBy("bucket", "lang").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets and languages
        if r["lang"] is None:
            total[r["bucket"]] = r["n"]
        else:
            rows[r["lang"]] = r["n"]
    return total, rows


def dealt_shares(rows: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's rows that a sample of about `most` takes: as many of each, as far as it has them."""
    shares, left = {}, float(most)
    for k, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        take = min(float(n), left / (len(rows) - k))
        shares[lang], left = take / n, left - take
    return shares


class SparseSoftmax:
    """Multinomial logistic regression, trained by follow-the-regularised-leader."""

    def __init__(self, classes: int, alpha: float, l1: float, l2: float) -> None:
        self.alpha, self.l1, self.l2 = alpha, l1, l2
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((1.0 + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = softmax(x @ w)
        g[label] -= 1.0
        g = np.outer(x, g)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, found on a grid of powers."""
    grid = np.exp(np.linspace(-4, 2, 61))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict_language(docs: DataFrame, learn_from=None, max_sample: int = 4000, epochs: int = 3, alpha: float = 0.5, l1: float = 0.02, l2: float = 0.1) -> DataFrame:
    """doc_id, lang_pred and score for each row of `docs` (doc_id, text, lang).

    `learn_from` is a condition on doc_id: text and lang of rows that meet it are learned;
    the weights are fitted on about `max_sample` of them, dealt evenly to the languages (rare ones are taken whole);
    n-gram frequencies come from all.
    """
    docs = _lowered(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang"))
    known = docs.filter(F.col("lang").isNotNull() & F.col("low").isNotNull())
    if learn_from is not None:
        known = known.filter(learn_from)
    df, langs = document_frequencies(known)
    idf = np.log((1.0 + sum(langs.values())) / (1.0 + df)) + 1.0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [ngrams(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in rows], pa.list_(pa.int32()))], ["lang", "at", "n"])

    edges = [(lang, sampled_edge(share)) for lang, share in dealt_shares(langs, max_sample).items()]
    table = docs.sparkSession.createDataFrame(edges, "_lang string, _edge long")  # a row for each language
    drawn = known.withColumn("_lang", F.col("lang").cast("string")).join(F.broadcast(table) if len(edges) <= MOST_BROADCAST else table, "_lang").filter(F.xxhash64(F.lit("sample"), "doc_id", "text") <= F.col("_edge"))
    # rows of equal doc_id, text and lang all fall in or out: they are one row of the sample
    sample = drawn.select("doc_id", "low", "lang").distinct().orderBy(F.xxhash64("doc_id", "low"), "lang").select("low", F.col("lang").cast("string").alias("lang")).mapInArrow(counted, "lang string, at array<int>, n array<int>").toPandas()
    names = sorted(sample["lang"].unique()) if len(sample) else []
    weights, heat = None, 1.0
    if names:
        rows = [(np.asarray(a), _weighted(np.asarray(a), np.asarray(n), idf), names.index(k)) for a, n, k in zip(sample["at"], sample["n"], sample["lang"], strict=True)]
        part = max(1, len(rows) // 5)
        model = SparseSoftmax(len(names), alpha, l1, l2)
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(np.arange(part if len(rows) > 20 else 0, len(rows))):
                model.learn(*rows[i])
        weights = model.weights(np.arange(BUCKETS))
        heat = temperature(np.array([x @ weights[at] for at, x, _ in rows[:part]]), np.array([k for _, _, k in rows[:part]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                if text is None or weights is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, n = ngrams(text)
                p = softmax(_weighted(at, n, idf) @ weights[at] / heat)
                best = int(np.argmax(p))
                langs.append(names[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "low").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op4_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    held_out = fold(F.col("doc_id"), 3) == 1
    return predict_language(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
