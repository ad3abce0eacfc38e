"""Benchmark decontamination with a distributed positional inverted index, with DataFrame functions only.

The words of the training documents that stand in the benchmark are postings (term,
document, position), which are made from the texts once and stored. For each window of a
benchmark item the terms that are rarest in this index are chosen; their postings, moved by
the term's offset in the window, are intersected, and what is left is compared with the
words of those documents that it lies in. A proximity search over the same index finds
documents that hold an item's rarest terms close together in any order.

Edge cases: null and empty texts have no words and match nothing; an item of fewer
words than a window is one window; equal windows of several items count for each; a null
item_id is listed as empty text; repeated rows, and rows of one doc_id (or none) with
different texts, are judged each; empty tables give no hits or no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import stored

WINDOW = 13
#: Terms of a window whose postings are intersected.
RAREST = 2
#: Terms of an item that a proximity match holds (or all that the documents have), and words among which they stand.
NEAR_TERMS, NEAR_WORDS = 4, 30
#: A benchmark of more rows than this is joined by shuffles, not by broadcasts.
MOST_BROADCAST = 200_000
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: A-Z in lower case, cut at ASCII characters that are neither letter nor digit."""
    text = text.cast("string")
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.filter(F.split(F.coalesce(low, F.lit("")), _BETWEEN, -1), lambda w: w != "")


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """window_id, words and items (ids as text) for each different window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.slice("w", i + 1, F.lit(n)))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("window_id", F.xxhash64("words"))


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


#: What tells documents apart: rows of one doc_id may have different texts, and equal ones are judged alike.
_KEY = ["doc_id", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), "text")


def postings(docs: DataFrame, vocabulary: DataFrame, few: bool) -> DataFrame:
    """The positional index: doc_id, text_key, pos, term for each word that the vocabulary (term) has."""
    each = _keyed(docs).select(*_KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return each.join(_small(vocabulary, few), "term").select(*_KEY, "pos", "term")


@dataclass(frozen=True)
class Index:
    """The stored postings of documents, restricted to the words of a benchmark, and how many there are of each term."""

    lists: DataFrame
    counts: DataFrame
    windows: DataFrame
    items: DataFrame
    few: bool


def build_index(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> Index:
    """The index of `docs` for the windows of n words and the items of a benchmark; the texts are cut into words once."""
    few = benchmark.count() <= MOST_BROADCAST // 100  # an item has about a hundred windows at most where this holds; else they are shuffled
    wins = windows(benchmark, n)
    if few:
        wins = stored(wins, "index-windows")
        few = wins.count() <= MOST_BROADCAST
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    vocabulary = items.select(F.explode("w").alias("term")).distinct()
    lists = stored(postings(docs.select("doc_id", "text"), vocabulary, few), "index-postings")
    return Index(lists, stored(lists.groupBy("term").agg(F.count("*").alias("n_postings")), "index-counts"), wins, items, few)


def rarest_terms(index: Index, terms: DataFrame, by: str, n: int, all_held: bool) -> DataFrame:
    """Of `terms` (`by`, term, offset) the n different terms of each `by` that are rarest in the index; rank counts from 0.

    With `all_held` a `by` with a term that the index lacks is left out; else such terms are passed over.
    """
    once = terms.groupBy(by, "term").agg(F.min("offset").alias("offset")).join(index.counts, "term", "left")
    if all_held:
        fewest = F.min(F.coalesce("n_postings", F.lit(0))).over(Window.partitionBy(by))
        once = once.withColumn("fewest", fewest)
    held = once.filter("fewest > 0" if all_held else "n_postings > 0").drop("fewest")
    rank = F.row_number().over(Window.partitionBy(by).orderBy("n_postings", "offset")) - 1
    chosen = held.withColumn("rank", rank).filter(F.col("rank") < n).drop("n_postings")
    return chosen.withColumn("n_terms", F.count("*").over(Window.partitionBy(by)))


def phrase_candidates(index: Index) -> DataFrame:
    """doc_id, text_key, window_id, start: where the chosen terms of a window stand at their offsets."""
    terms = index.windows.select("window_id", F.posexplode("words").alias("offset", "term"))
    seeds = rarest_terms(index, terms, "window_id", RAREST, True)
    lists = index.lists.join(_small(seeds, index.few), "term").select(*_KEY, "window_id", (F.col("pos") - F.col("offset")).alias("start"), "rank", "n_terms").filter("start >= 0")
    met = lists.groupBy(*_KEY, "window_id", "start", "n_terms").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("ranks"))
    return met.filter(F.bit_count("ranks") == F.col("n_terms")).select(*_KEY, "window_id", "start")


def phrase_matches(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, text_key, start, window_id: each occurrence of a window in the documents, confirmed on their words."""
    candidates = stored(phrase_candidates(index), "index-candidates")
    met = candidates.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    same_row = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key"))
    # a merge join at every size: the documents with candidates grow with the input, and small inputs should plan like large ones
    texts = _keyed(docs).join(met.hint("merge"), same_row, "left_semi").dropDuplicates(_KEY).select(*_KEY, words(F.col("text")).alias("w"))
    asked = candidates.join(_small(index.windows.select("window_id", "words"), index.few), "window_id").withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
    held = F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words")
    return texts.join(asked.hint("merge"), same_row).filter(held).select(*_KEY, "start", "window_id")


def proximity_matches(index: Index, n_terms: int = NEAR_TERMS, within: int = NEAR_WORDS) -> DataFrame:
    """doc_id, text_key, item: documents that hold the item's rarest terms, n_terms of them or all that the index has, within so many words.

    Positions meet in cells of `within` words, each with the one after it, so that only
    documents with all terms near each other are put in order.
    """
    terms = index.items.select("item", F.posexplode("w").alias("offset", "term"))
    chosen = rarest_terms(index, terms, "item", n_terms, False)
    lists = index.lists.join(_small(chosen, index.few), "term").select(*_KEY, "item", "pos", "rank", "n_terms")
    cell = F.floor(F.col("pos") / within)
    dealt = lists.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    bit = F.bit_or(F.expr("shiftleft(1, rank)"))
    close = dealt.groupBy(*_KEY, "item", "cell", "n_terms").agg(bit.alias("ranks"), F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("at"))
    close = close.filter(F.bit_count("ranks") == F.col("n_terms"))
    # a span of `within` words from each position of the cell
    ranks_from = lambda a: F.size(F.array_distinct(F.transform(F.filter("at", lambda b: (b["pos"] >= a["pos"]) & (b["pos"] < a["pos"] + within)), lambda b: b["rank"])))
    return close.filter(F.exists("at", lambda a: ranks_from(a) == F.col("n_terms"))).select(*_KEY, "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, proximity: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a hit), items (ids as text, sorted) for each row of `docs`.

    With `proximity` also near_items: those that a proximity search finds.
    """
    docs = docs.select("doc_id", "text")
    index = build_index(docs, benchmark, n)
    out = _keyed(docs).select(*_KEY, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    hits = phrase_matches(docs, index).join(_small(index.windows, index.few), "window_id")
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.size("words") - 1))))).cast("long")
    found = hits.groupBy(*_KEY).agg(covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    parts = [(found, {"n_hit": F.lit(0).cast("long"), "items": F.expr("cast(array() as array<string>)")})]
    if proximity:
        near = proximity_matches(index).groupBy(*_KEY).agg(F.array_sort(F.collect_set("item")).alias("near_items"))
        parts.append((near, {"near_items": F.expr("cast(array() as array<string>)")}))
    for part, none in parts:
        renamed = part.withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
        same_row = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key"))
        out = out.join(renamed, same_row, "left").drop("found_id", "found_key").withColumns({c: F.coalesce(c, empty) for c, empty in none.items()})
    return out.drop("text_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not contaminated."""
    index = build_index(docs, benchmark, n)
    hits = phrase_matches(docs, index).join(_small(index.windows, index.few), "window_id")
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.size("words") - 1))))).cast("long")
    found = hits.groupBy(*_KEY).agg(covered.alias("n_hit")).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "n_hit")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.col("text").alias("given"), whole)
    same_row = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key"))
    # words are counted for documents with hits only
    bad = F.col("n_hit").isNotNull() & is_contaminated(F.col("n_hit"), F.size(words(F.col("given"))))
    return rows.join(found.hint("merge"), same_row, "left").filter(~bad).select("row.*")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Whether a twentieth of the words or more are inside hits."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the items near (n_near, near_sha256) for each document."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return contamination(docs, benchmark, proximity=True).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"), digest("near_items").alias("near_sha256"),
    )


SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, len(w[i:i + 12]) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, x.item FROM places p JOIN wins x ON p.n = x.n AND p.phrase = x.phrase),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id),
terms AS (SELECT item, term, min(i) AS place FROM (SELECT item, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM items) GROUP BY 1, 2),
posts AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM docs) SEMI JOIN terms USING (term)),
rare AS (
  SELECT item, term, count(*) OVER (PARTITION BY item) AS n_terms FROM (
    SELECT t.item, t.term, row_number() OVER (PARTITION BY t.item ORDER BY c.n, t.place) AS rank
    FROM terms t JOIN (SELECT term, count(*) AS n FROM posts GROUP BY term) c USING (term)) WHERE rank <= 4),
spans AS (
  SELECT doc_id, item, n_terms, count(DISTINCT term) OVER (PARTITION BY doc_id, item ORDER BY pos RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS met
  FROM posts JOIN rare USING (term)),
close AS (SELECT doc_id, count(DISTINCT item) AS n_near, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM spans WHERE met = n_terms GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated,
       coalesce(k.n_near, 0)::BIGINT AS n_near, sha256(coalesce(k.ids, '')) AS near_sha256
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id) LEFT JOIN close k USING (doc_id)
"""
