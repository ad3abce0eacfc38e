"""Mixing sources to target weights: temperature mixing, with DataFrame functions only.

The share of tokens of each source is raised to an exponent and normalised. The
exponent is bisected until the weights have a target entropy, or, where that would
repeat a source too often, until no source is repeated more often than the limit. Each
source then gets its part of the token budget: whole passes over its documents, and for
the rest of the part a permutation of its blocks, cut where the budget ends.

Edge cases: a null source is a source of its own; a null text or one without words has no
tokens and is never drawn (n_copies 0); repeated rows are drawn each; ties in the
permutation fall to the smaller doc_id; a single source gets the whole budget; where no
exponent gives weights of the target entropy (as when all shares are equal), sources keep their natural
weights and target_met is false (ValueError if `strict`); an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import stored

WORD = "[^\\x20\\x09-\\x0D]+"
#: Halvings of the exponent's interval, and how many of them one job evaluates.
STEPS, AT_ONCE = 30, 5
#: Documents of a block at least; a source of very many has blocks in proportion to the root of their number.
BLOCK_DOCS, ROOT_BLOCKS = 64, 16
#: The largest exponent that is tried.
MOST = 1024.0


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens (words between white space) and text_key (a hash of the text) for each row."""
    return docs.select(_text_key(), "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def _measures(shares: DataFrame, exponents: list[float], budget_share: float) -> list[tuple[float, float]]:
    """Entropy of the weights and largest repetition of a source, for each exponent."""
    p, out = F.col("share"), []
    top = shares.agg(F.max("share")).first()[0]
    if top is None:
        return [(0.0, 0.0)] * len(exponents)
    q = p / F.lit(top)  # against the largest share, so that large exponents leave something
    for i, a in enumerate(exponents):
        raised = F.pow(q, F.lit(a))
        out += [F.sum(raised).alias(f"z{i}"), F.sum(raised * F.ln(q)).alias(f"s{i}"), F.max(raised / p).alias(f"r{i}")]
    r = shares.agg(*out).first()
    return [(math.log(r[f"z{i}"]) - a * r[f"s{i}"] / r[f"z{i}"], budget_share * r[f"r{i}"] / r[f"z{i}"]) for i, a in enumerate(exponents)]


def bisect_exponent(shares: DataFrame, too_flat, budget_share: float) -> float | None:
    """The smallest exponent at which `too_flat(entropy, repetition)` no longer holds, to 2^-STEPS of the interval it lies in.

    The interval is from 0 to 1, or up to the first power of two at which it no longer holds;
    None if there is none up to MOST. One job evaluates all midpoints that the next AT_ONCE halvings could ask for.
    """
    if not too_flat(*_measures(shares, [0.0], budget_share)[0]):
        return 0.0
    powers = [2.0**i for i in range(int(math.log2(MOST)) + 1)]
    enough = [p for p, m in zip(powers, _measures(shares, powers, budget_share), strict=True) if not too_flat(*m)]
    if not enough:
        return None
    low, high = 0.0, enough[0]
    for _ in range(STEPS // AT_ONCE):
        parts = 2**AT_ONCE
        grid = [low + (high - low) * i / parts for i in range(parts + 1)]
        flat = [True, *(too_flat(*m) for m in _measures(shares, grid[1:-1], budget_share)), False]
        low, high = next((a, b) for (a, b), (x, y) in zip(pairwise(grid), pairwise(flat), strict=True) if x and not y)
    return high


def _shuffled(seed: int, *of: Column) -> Column:
    """A hash that orders a permutation."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in of)))


def mix(docs: DataFrame, entropy_share: float | None = None, max_repetition: float | None = None, budget_tokens: int | None = None, seed: int = 0, strict: bool = False) -> DataFrame:
    """How often each document is drawn, and where.

    entropy_share: target entropy of the weights, as a share of the largest possible.
    max_repetition: no source is read more often than this (ValueError if the budget asks for more than that of all of them).
    budget_tokens: tokens to draw; as many as there are by default.
    strict: a target entropy that no exponent meets is an error; else natural weights are taken.
    Returns doc_id, source, text_key (a hash of the text), n_tokens, weight (of the source), block, slot (place in its
    source's permutation, from 0 to 1, by which sources are interleaved), n_copies and target_met.
    """
    tokens = stored(token_counts(docs), "mix-tokens")
    sources = stored(tokens.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs")), "mix-sources")
    totals = sources.agg(F.sum("source_tokens").alias("t"), F.sum(F.when(F.col("source_tokens") > 0, 1)).alias("k")).first()
    total, k = totals["t"] or 0, totals["k"] or 0
    budget = total if budget_tokens is None else budget_tokens
    shares = sources.filter("source_tokens > 0").withColumn("share", F.col("source_tokens") / F.lit(float(max(total, 1))))
    budget_share = budget / max(total, 1)
    exponent, met = 1.0, True
    if entropy_share is not None and k:
        target = entropy_share * math.log(k)
        found = bisect_exponent(shares, lambda entropy, _: entropy > target, budget_share)
        exponent, met = (1.0, False) if found is None else (found, True)
        if strict and not met:
            raise ValueError("no exponent gives weights that meet the target")
    if max_repetition is not None and k and (entropy_share is None or _measures(shares, [exponent], budget_share)[0][1] > max_repetition):
        if budget_share > max_repetition:
            raise ValueError(f"{budget} tokens are more than {max_repetition} times all of them")
        exponent = bisect_exponent(shares, lambda _, repetition: repetition > max_repetition * (1 + 1e-12), budget_share)
    top = shares.agg(F.max("share")).first()[0] or 1.0
    z = shares.agg(F.sum(F.pow(F.col("share") / F.lit(top), F.lit(exponent))).alias("z")).first()["z"] or 1.0
    n_blocks = F.ceil(F.least(F.col("source_docs") / BLOCK_DOCS, ROOT_BLOCKS * F.sqrt("source_docs"))).cast("int")
    plan = (
        shares.withColumn("weight", F.pow(F.col("share") / F.lit(top), F.lit(exponent)) / F.lit(z))
        .withColumn("target", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
        .withColumn("passes", F.floor(F.col("target") / F.col("source_tokens")).cast("long"))
        .select(F.coalesce("source", F.lit("\0")).alias("key"), "weight", "source_tokens", "passes", (F.col("target") - F.col("passes") * F.col("source_tokens")).alias("rest"), n_blocks.alias("n_blocks"))
    )
    key = F.coalesce("source", F.lit("\0"))
    rows = (
        tokens.withColumn("key", key).join(plan, "key", "left")
        .withColumn("block", F.when(F.col("n_blocks").isNotNull(), F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % F.col("n_blocks")).cast("int"))
    )
    block_order = Window.partitionBy("key").orderBy(_shuffled(seed, F.col("key"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.filter("block is not null").groupBy("key", "block").agg(F.sum("n_tokens").alias("block_tokens")).select("key", "block", F.coalesce(F.sum("block_tokens").over(block_order), F.lit(0)).alias("block_start"))
    doc_order = Window.partitionBy("key", "block").orderBy(_shuffled(seed, F.col("doc_id")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(blocks, ["key", "block"], "left").withColumn("end", F.col("block_start") + F.sum("n_tokens").over(doc_order))
    drawn = (F.col("n_tokens") > 0) & F.col("block").isNotNull()
    return placed.select(
        "doc_id", "source", "text_key", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.when(drawn, F.col("block")).alias("block"),
        F.when(drawn, (F.col("end") - F.col("n_tokens")) / F.col("source_tokens")).alias("slot"),
        F.when(drawn, F.col("passes") + (F.col("end") <= F.col("rest")).cast("long")).otherwise(F.lit(0)).cast("long").alias("n_copies"),
        F.lit(met).alias("target_met"),
    )


def with_draws(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are drawn, with all their columns and n_copies, slot and weight; see mix.

    Rows that are equal in doc_id, source and text are drawn alike, as often as the one drawn most.
    """
    drawn = mix(docs, **options).filter("n_copies > 0").groupBy("doc_id", "source", "text_key").agg(F.max("n_copies").alias("n_copies"), F.min("slot").alias("slot"), F.max("weight").alias("weight"))
    drawn = drawn.select(F.struct(*drawn.columns).alias("d"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), _text_key())
    same = F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("r.source").cast("string").eqNullSafe(F.col("d.source")) & (F.col("text_key") == F.col("d.text_key"))
    return rows.join(drawn, same).select("r.*", "d.n_copies", "d.slot", "d.weight")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """How often each document is drawn at 98 % of the largest entropy, no source more than four times."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), entropy_share=0.98, max_repetition=4.0).drop("text_key")


SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
sources AS (
  SELECT source, sum(n_tokens)::BIGINT AS source_tokens, count(*) AS source_docs FROM tokens GROUP BY source),
total AS (SELECT sum(source_tokens)::BIGINT AS t, count(*) FILTER (source_tokens > 0) AS k FROM sources),
shares AS (
  SELECT *, share / max(share) OVER () AS q
  FROM (SELECT s.*, source_tokens / t::DOUBLE AS share, t, k FROM sources s, total WHERE source_tokens > 0)),
tries AS (
  SELECT e, ln(sum(pow(q, e))) - e * sum(pow(q, e) * ln(q)) / sum(pow(q, e)) > 0.98 * ln(max(k)) AS flat
  FROM shares, (SELECT pow(2.0::DOUBLE, unnest(range(11))) AS e) GROUP BY e),
halving(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, (SELECT min(e) FROM tries WHERE NOT flat)
  UNION ALL
  SELECT i + 1,
         CASE WHEN flat THEN (low + high) / 2 ELSE low END,
         CASE WHEN flat THEN high ELSE (low + high) / 2 END
  FROM (SELECT h.i, h.low, h.high,
               ln(sum(pow(q, (low + high) / 2))) - (low + high) / 2 * sum(pow(q, (low + high) / 2) * ln(q)) / sum(pow(q, (low + high) / 2)) > 0.98 * ln(max(k)) AS flat
        FROM halving h, shares WHERE h.i < 30 GROUP BY h.i, h.low, h.high)),
first_exponent AS (SELECT coalesce(high, 1.0) AS a, high IS NOT NULL AS met FROM halving WHERE i = 30),
repeating(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
         CASE WHEN flat THEN (low + high) / 2 ELSE low END,
         CASE WHEN flat THEN high ELSE (low + high) / 2 END
  FROM (SELECT r.i, r.low, r.high, max(pow(q, (low + high) / 2) / share) / sum(pow(q, (low + high) / 2)) > 4.0 AS flat
        FROM repeating r, shares WHERE r.i < 30 GROUP BY r.i, r.low, r.high)),
exponent AS (
  SELECT CASE WHEN (SELECT max(pow(q, a) / share) / sum(pow(q, a)) FROM shares) > 4.0
              THEN (SELECT high FROM repeating WHERE i = 30) ELSE a END AS a, met
  FROM first_exponent),
plan AS (
  SELECT source, source_tokens, weight, n_blocks, target // source_tokens AS passes, target % source_tokens AS rest
  FROM (SELECT *, floor(weight * t::DOUBLE)::BIGINT AS target FROM (
    SELECT source, source_tokens, t, pow(q, a) / sum(pow(q, a)) OVER () AS weight,
           ceil(least(source_docs / 64.0, 16 * sqrt(source_docs)))::BIGINT AS n_blocks FROM shares, exponent))),
blocked AS (
  SELECT d.doc_id, d.source, d.n_tokens, p.weight, p.source_tokens, p.passes, p.rest,
         (('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT % p.n_blocks)::INT AS block
  FROM tokens d LEFT JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
blocks AS (
  SELECT source, block, coalesce(sum(block_tokens) OVER (
           PARTITION BY source ORDER BY md5('0|' || coalesce(source, chr(0)) || '|' || block::VARCHAR), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_start
  FROM (SELECT source, block, sum(n_tokens) AS block_tokens FROM blocked WHERE block IS NOT NULL GROUP BY source, block)),
placed AS (
  SELECT b.*, k.block_start + sum(n_tokens) OVER (
           PARTITION BY b.source, b.block ORDER BY md5('0|' || b.doc_id::VARCHAR), b.doc_id, b.n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS last
  FROM blocked b LEFT JOIN blocks k ON b.source IS NOT DISTINCT FROM k.source AND b.block = k.block)
SELECT doc_id, source, n_tokens, coalesce(weight, 0.0) AS weight,
       CASE WHEN n_tokens > 0 AND block IS NOT NULL THEN block END AS block,
       CASE WHEN n_tokens > 0 AND block IS NOT NULL THEN (last - n_tokens) / source_tokens::DOUBLE END AS slot,
       (CASE WHEN n_tokens > 0 AND block IS NOT NULL THEN passes + (last <= rest)::BIGINT ELSE 0 END)::BIGINT AS n_copies,
       (SELECT met FROM exponent) AS target_met
FROM placed
"""
