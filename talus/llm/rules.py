"""Quality rules: fixed base rules, and gradient-boosted trees over document statistics.

The base rules count words, their characters, symbols, repeated lines and words of repeated five-word
windows. What passes them is judged by trees that are boosted on a bounded sample of labelled rows, from histograms of
binned statistics; on chosen statistics the score may only fall (or only rise). The trees are laid out as
flat arrays of nodes, and whole batches of rows walk all trees at once, level by level.

Edge cases: a null text and an empty one have no words and fail the base rules; with no labelled
rows every score is 0.5, with labels of one class only 0 or 1 (of that class), and the verdict follows; repeated rows are
judged each; texts are read whole, words hashed in slices of bounded size; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm import quality
from talus.llm.common import bounded, byte_views, fold, majority, stored
from talus.llm.hashing import sequence_hashes, word_bounds, word_hashes

#: Words of a window that counts as repeated, and what the base rules ask for.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 0.2
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("word_chars_mean", "symbols_a_char", "dup_lines_a_line", "repeats_a_word", *quality.STATISTICS)
#: Statistics in which the score may only fall (-1).
MONOTONIC = {"symbols_a_char": -1, "dup_lines_a_line": -1, "repeats_a_word": -1, "symbol_end": -1}

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_SPACES = b" \t\n\v\f\r"
#: Bytes of words that are hashed at once.
_SLICE = 1 << 20


def _hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """word_hashes in slices of whole words."""
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(text), _SLICE)), len(starts)))
    parts = [word_hashes(text[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def base_counts(text: np.ndarray | None) -> tuple[list[int], int]:
    """The COUNTS of one text (UTF-8 bytes), and its number of lines with a word."""
    if text is None or not len(text):
        return [0] * len(COUNTS), 0
    starts, ends = word_bounds(text)
    n = len(starts)
    continued = int(np.count_nonzero((text & 0xC0) == 0x80))
    repeated = 0
    if n > WINDOW:
        windows = sequence_hashes(_hashes(text, starts, ends), np.arange(n - WINDOW + 1), WINDOW)
        _, which, each = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(each[which] > 1)
        edge = np.zeros(n + 1, np.int64)
        edge[again] += 1
        edge[again + WINDOW] -= 1
        repeated = int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))
    lines = [x for x in text.tobytes().split(b"\n") if x.strip(_SPACES)]
    return [n, int((ends - starts).sum()) - continued, int(np.count_nonzero(_IS_SYMBOL[text])), len(lines) - len(set(lines)), repeated], len(lines)


def statistics(text: np.ndarray | None) -> tuple[list[int], list[float]]:
    """The COUNTS and the STATISTICS of one text."""
    counts, lines = base_counts(text)
    n, chars, symbols, duplicates, repeats = counts
    return counts, [chars / max(n, 1), symbols / max(chars, 1), duplicates / max(lines, 1), repeats / max(n, 1), *map(float, quality.statistics(text))]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the COUNTS (long) and `stats` (array<double>, in the order of STATISTICS) for each row of `docs`."""
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in byte_views(batch.column(1))]
            counts = [pa.array([c[i] for c, _ in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([s for _, s in rows], kind)], ["doc_id", *COUNTS, "stats"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, stats array<double>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# -- boosted trees ----------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees as flat arrays: a node goes left where its statistic is at most its threshold; leaves point to themselves."""

    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.start)
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
            own = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                node = np.where(rows[own, self.statistic[node]] <= self.threshold[node], self.left[node], self.right[node])
            total[a : a + 4096] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _best_split(g: np.ndarray, h: np.ndarray, codes: np.ndarray, sizes: list[int], signs: np.ndarray, low: float, high: float, l2: float, least: float):
    """(gain, statistic, bin) of the best split of a node's rows, or None; values are held between `low` and `high`."""
    best, all_g, all_h = None, g.sum(), h.sum()
    for f, size in enumerate(sizes):
        if size < 2:
            continue
        left_g = np.cumsum(np.bincount(codes[f], g, size))[:-1]
        left_h = np.cumsum(np.bincount(codes[f], h, size))[:-1]
        right_g, right_h = all_g - left_g, all_h - left_h
        a, b = (np.clip(-gg / (hh + l2), low, high) for gg, hh in ((left_g, left_h), (right_g, right_h)))
        gain = -(left_g * a + 0.5 * (left_h + l2) * a * a + right_g * b + 0.5 * (right_h + l2) * b * b)
        gain[(left_h < least) | (right_h < least) | (signs[f] * (b - a) < 0)] = -np.inf
        at = int(np.argmax(gain))
        if np.isfinite(gain[at]) and (best is None or gain[at] > best[0]):
            best = gain[at], f, at
    return best


def fit_forest(x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Trees boosted on the log loss; `signs` holds +1, -1 or 0 for each statistic: the score may only rise, only fall, or either."""
    share = y.mean() if len(y) else 0.5
    start = 40.0 * (2 * share - 1) if share in (0.0, 1.0) else float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # statistic, threshold, left, right, value
    roots: list[int] = []
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) if len(c) else np.empty(0) for c in x.T]
    codes = np.array([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    sizes, margin = [len(e) + 1 for e in edges], np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me, own_g, own_h = len(nodes), g[rows].sum(), h[rows].sum()
        value = float(np.clip(-own_g / (own_h + l2), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        found = _best_split(g[rows], h[rows], codes[:, rows], sizes, signs, low, high, l2, least) if level < depth else None
        if found is None or found[0] <= -(own_g * value + 0.5 * (own_h + l2) * value * value) + 1e-9:
            margin[rows] += rate * value
            return me
        _, f, at = found
        goes = codes[f, rows] <= at
        parts = rows[goes], rows[~goes]
        middle = float(np.mean([np.clip(-g[p].sum() / (h[p].sum() + l2), low, high) for p in parts]))
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}[int(signs[f])]
        sides = [grow(p, g, h, level + 1, *b) for p, b in zip(parts, bounds, strict=True)]
        nodes[me] = [f, edges[f][at], *sides, 0.0]
        return me

    for _ in range(rounds if 0 < share < 1 and len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-12), 0, -np.inf, np.inf))
    table = np.array(nodes).reshape(-1, 5)
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, int), start, depth)


def fit_rules(stats: DataFrame, labels: DataFrame, train_on: Column | None = None, max_sample: int = 20_000, **options) -> Forest:
    """The forest of about `max_sample` labelled rows of `stats` (doc_id, stats) at most, chosen by a hash of doc_id.

    `train_on` is a condition on doc_id: only labels of rows that meet it are learned.
    """
    known = majority(labels, "quality")
    if train_on is not None:
        known = known.filter(train_on)
    sample = bounded(stats.join(known, "doc_id"), "doc_id", max_sample).select("stats", "label").toPandas()
    rows = np.array(sample["stats"].to_list(), float).reshape(-1, len(STATISTICS))
    table = np.hstack([rows, sample["label"].to_numpy(float)[:, None]])
    table = table[np.lexsort(table.T)]  # sums do not depend on the order in which rows came
    return fit_forest(table[:, :-1], table[:, -1], np.array([MONOTONIC.get(s, 0) for s in STATISTICS]), **options)


def judged(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, keep: float = 0.5, max_sample: int = 20_000, **options) -> DataFrame:
    """doc_id, the COUNTS, base_failed, score (probability that quality is 1) and kept for each row of `docs`."""
    stats = stored(document_statistics(docs), "rules-stats")
    forest = fit_rules(stats, labels, train_on, max_sample, **options)
    at = len(COUNTS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(forest.score(x))], [*batch.schema.names[:at], "score"])

    scored = stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MOST_REPEATED) * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep))


def op11_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept, score and held_out (not learned from) for each document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 3) == 1
    return judged(docs, labels, ~held_out).withColumn("held_out", held_out)
