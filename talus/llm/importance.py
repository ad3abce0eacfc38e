"""Target-distribution importance resampling over hashed word runs, with a position-table CRC.

Features are runs of consecutive words; each falls in the bucket of its CRC-32. A bucket's gain is
the logarithm of how much likelier it is in the target than in the documents, a document's weight the
sum of its features' gains, and documents are drawn without replacement by adding Gumbel noise.

CRC-32 is affine: the CRC of a span is the XOR of what each of its bytes contributes at its distance
from the span's end, and of a constant for the length. All spans of a text are hashed at once: the
contributions are looked up in a table of distances by bytes and joined by `bitwise_xor.reduceat`.
Spans longer than the table are cut into blocks of its depth, whose values are folded in pairs.

Edge cases: a null text and one without words have no features and weight 0; a document of no doc_id
has the noise of an empty one; repeated rows are drawn each; ties go to the smaller doc_id, null ones
first, then to fewer features; with an empty target all gains are those of empty buckets; an
empty table gives no rows; texts and words may be of any length (spans are hashed in slices of
bounded size); other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import byte_views, stored
from talus.operators.validation import ordinal_ranks

#: Distances from the end that the table holds: 2 ** DEPTH_BITS.
DEPTH_BITS = 6
DEPTH = 1 << DEPTH_BITS
#: Bytes of spans that are looked up at once.
SLICE = 1 << 18
_POLYNOMIAL, _ALL = 0xEDB88320, np.uint32(0xFFFFFFFF)


def _words_table() -> np.ndarray:
    """Each byte in lower case, or 0 if it stands in no word; bytes of characters beyond ASCII all do."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        ch = chr(b).lower() if b < 128 else ""
        table[b] = b if b >= 128 else ord(ch) if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else 0
    return table


_WORD = _words_table()


# -- CRC-32 by position -----------------------------------------------------------------------


@cache
def _step() -> np.ndarray:
    """What one byte contributes at distance 0."""
    s = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        s = np.where(s & 1, (s >> 1) ^ np.uint32(_POLYNOMIAL), s >> 1)
    return s


def _by_bytes(basis: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given for each bit, as a table for each of the four bytes."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        out[bit // 8, (np.arange(256) >> (bit % 8) & 1).astype(bool)] ^= basis[bit]
    return out


def _apply(op: np.ndarray, s: np.ndarray) -> np.ndarray:
    return op[0][s & 255] ^ op[1][s >> 8 & 255] ^ op[2][s >> 16 & 255] ^ op[3][s >> 24]


@cache
def _advance(power: int) -> np.ndarray:
    """The map that 2 ** power bytes of zero make of a value."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power == 0:
        return _by_bytes(_step()[bits & 255] ^ (bits >> 8))
    half = _advance(power - 1)
    return _by_bytes(_apply(half, _apply(half, bits)))


@cache
def _places() -> np.ndarray:
    """[distance from the end, byte] -> contribution."""
    rows = [_step()]
    for _ in range(DEPTH - 1):
        rows.append(_apply(_advance(0), rows[-1]))
    return np.array(rows)


def _length_constant(n: int) -> np.uint32:
    """What the length alone contributes: the CRC of n bytes of zero."""
    s = np.array([_ALL])
    for power in range(n.bit_length()):
        if n >> power & 1:
            s = _apply(_advance(power), s)
    return s[0] ^ _ALL


@cache
def _constants() -> np.ndarray:
    return np.array([_length_constant(n) for n in range(DEPTH + 1)], np.uint32)


def _folded(span: np.ndarray) -> np.uint32:
    """The CRC of one long span: its blocks' values, folded in pairs."""
    head = len(span) % DEPTH
    blocks = [np.concatenate([np.zeros(DEPTH - head, np.uint8), span[:head]]).reshape(1, DEPTH)] if head else []
    body = span[head:].reshape(-1, DEPTH)
    blocks += [body[i : i + SLICE // DEPTH] for i in range(0, len(body), SLICE // DEPTH)]
    distance = np.arange(DEPTH - 1, -1, -1)
    values, power = np.concatenate([np.bitwise_xor.reduce(_places()[distance, b], axis=1) for b in blocks]), DEPTH_BITS
    while len(values) > 1:
        if len(values) % 2:
            values = np.concatenate([np.zeros(1, np.uint32), values])  # zeros in front contribute nothing
        values, power = _apply(_advance(power), values[::2]) ^ values[1::2], power + 1
    return values[0] ^ _length_constant(len(span))


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[start:end] for each span (none of them empty)."""
    out, n = np.empty(len(starts), np.uint32), ends - starts
    for i in np.flatnonzero(n > DEPTH):
        out[i] = _folded(data[starts[i] : ends[i]])
    short = np.flatnonzero(n <= DEPTH)
    total = np.concatenate([[0], np.cumsum(n[short])])
    cuts = np.searchsorted(total, np.arange(0, total[-1] + SLICE, SLICE))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b and a < len(short):
            own = short[a:b]
            first = np.concatenate([[0], np.cumsum(n[own])])
            left = np.repeat(first[1:], n[own]) - 1 - np.arange(first[-1])  # bytes to the span's end
            out[own] = np.bitwise_xor.reduceat(_places()[left, data[np.repeat(ends[own], n[own]) - 1 - left]], first[:-1])
    return out ^ np.where(n <= DEPTH, _constants()[np.minimum(n, DEPTH)], 0).astype(np.uint32)


def features(text: np.ndarray, buckets: int, longest: int = 1) -> np.ndarray:
    """The bucket of each run of 1 to `longest` consecutive words of a text (UTF-8 bytes), repeats included."""
    low = _WORD[text]
    inside = low > 0
    before = np.concatenate([[False], inside[:-1]])
    flat = np.where(inside, low, np.uint8(32))[inside | before]  # words with one space behind each
    edge = np.flatnonzero(flat == 32)
    ends = np.append(edge, len(flat)) if len(flat) and flat[-1] != 32 else edge
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
    runs = [crc_of_spans(flat, starts[: len(starts) - k], ends[k:]) for k in range(min(longest, len(starts)))]
    return np.concatenate(runs).astype(np.int64) % buckets if runs else np.empty(0, np.int64)


# -- counts, weights and draws ----------------------------------------------------------------


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 1) -> np.ndarray:
    """How many features of the texts (column `text`) fall in each bucket; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in byte_views(batch.column(0)):
                if text is not None:
                    own += np.bincount(features(text, buckets, longest), minlength=buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets, whatever the input
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: float = 1000.0) -> np.ndarray:
    """floor(scale * log likelihood ratio) of each bucket, with one added to each count."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(scale * np.log((t + 1.0) * (s.sum() + k) / ((s + 1.0) * (t.sum() + k)))).astype(np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """doc_id, n_features and weight for each row of `docs`: how much its features favour the target's texts.

    The documents are read twice: for the buckets' counts, and for the weights.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, np.int64) if t is None else features(t, buckets, longest) for t in byte_views(batch.column(1))]
            columns = [batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([int(gain[x].sum()) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_features long, weight long")


def noise(key: Column, seed: int, scale: float = 1000.0) -> Column:
    """floor(scale * Gumbel noise) by the hash of seed and key: the same wherever and whenever it is drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-scale) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int, least_features: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 0) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1, null if not drawn) for each row of `docs`.

    Of the rows with `least_features` features, `percent` in a hundred are drawn: those of the highest scores.
    Ranks are counted within ranges of scores, so that no task sorts all rows.
    """
    scored = stored(importance_weights(docs, target, buckets, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance")
    able = scored.filter(F.col("n_features") >= least_features)
    drawn = able.count() * percent // 100
    placed = able.withColumns({"_down": -F.col("score"), "_tie": F.struct("doc_id", "n_features")})
    ranked = ordinal_ranks(placed, [], "_down", "_tie").select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    rest = scored.filter((F.col("n_features") < least_features) | F.col("n_features").isNull())
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def op12_importance(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each document: a tenth is drawn towards the benchmark's words."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, benchmark, percent=10, seed=2024)


SQL = r"""
WITH RECURSIVE steps AS (
  SELECT b, 0 AS i, b AS v FROM (SELECT unnest(range(256))::BIGINT AS b)
  UNION ALL
  SELECT b, i + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE i < 8),
bytes AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE i = 8),
all_texts AS (
  SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
words AS (
  SELECT own, doc_id, row, word, count(*) AS n
  FROM (SELECT own, doc_id, row, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
        FROM (SELECT *, row_number() OVER () AS row FROM all_texts))
  GROUP BY ALL),
vocabulary AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
crcs AS (
  SELECT word, xor(list_reduce(
           list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
           lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM vocabulary, bytes),
hashed AS (SELECT own, doc_id, row, bucket, n FROM words JOIN crcs USING (word)),
counts AS (
  SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM hashed GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS total_s, coalesce(sum(t), 0)::DOUBLE AS total_t FROM counts),
gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0)::DOUBLE + 1) * (total_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (total_t + 10000))))::BIGINT AS gain
  FROM counts, sums),
weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM hashed JOIN gains USING (bucket) WHERE own GROUP BY row),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM (SELECT * FROM (SELECT *, row_number() OVER () AS row FROM all_texts) WHERE own) d LEFT JOIN weights USING (row)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
         count(*) FILTER (n_features >= 20) OVER () AS able
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * able // 100 THEN r END AS rank FROM ranked
"""
