"""Substring dedup: passages of many words that stand in an earlier document are found and removed.

1. Every window of words has an anchor: the least hash among its short phrases. Windows
   that are equal have equal anchors, so only anchors that stand in two documents matter.
2. Runs of windows with such an anchor are compared by hash: where a whole run stands in
   an earlier document, it is claimed from the first such document; the windows of
   the runs that are the first of their kind are compared one by one.
3. Claimed passages are taken, as words, from the documents that hold them first and
   compiled to Aho-Corasick automata over word numbers, one for each shard of
   documents with only the passages that these can hold. The documents are streamed
   through their shard's automaton, which confirms the words and finds every occurrence.

Documents whose text equals that of an earlier one skip this: all their windows stand there.

Edge cases: null and empty texts have no words; a text shorter than a window loses
nothing; repeated rows of one doc_id are no smaller than each other, and both stay; a row
without doc_id is compared with nothing and stays; an empty table gives no rows; texts
are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import byte_views, integer_id, stored
from talus.llm.hashing import sequence_hashes, word_bounds, word_hashes

WINDOW = 50
#: Words of the phrases among which a window's anchor is chosen.
PHRASE = 10
#: Documents of a shard, on average.
SHARD_DOCS = 400
#: Words of passages that one row asks of a first document, on average, and bytes of passages in a batch.
PART_WORDS, BATCH_BYTES = 1 << 18, 1 << 25

def window_anchors(words: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """The anchor of each window of words."""
    least = sequence_hashes(words, np.arange(len(words) - phrase + 1), phrase)
    span, width = window - phrase + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (span - width)], least[span - width :]) if span > width else least


def _runs(anchors: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of windows that share a wanted anchor."""
    cut = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(anchors)]]) - 1
    keep = np.isin(anchors[first], wanted)
    return first[keep], last[keep]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id, copy_key (digest of the text), n_words, all_sha256 (of all words) and anchors for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, shas, anchors = [], [], [], []
            for view in byte_views(batch.column(1)):
                text = np.empty(0, np.uint8) if view is None else view
                raw = text.tobytes()
                starts, ends = word_bounds(text)
                keys.append(hashlib.md5(raw).digest())
                counts.append(len(starts))
                shas.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                anchors.append(np.unique(window_anchors(word_hashes(text, starts, ends), window, phrase)).view(np.int64) if len(starts) >= window else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "copy_key", "n_words", "all_sha256", "anchors"])

    return docs.mapInArrow(run, "doc_id long, copy_key binary, n_words long, all_sha256 string, anchors array<long>")


def _run_rows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """code, doc_id, pos, n: each run of wanted windows of a document, n words from word pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, (text, wanted) in enumerate(zip(byte_views(batch.column(1)), batch.column(2), strict=True)):
                words = word_hashes(text, *word_bounds(text))
                first, last = _runs(window_anchors(words, window, phrase), wanted.values.to_numpy(zero_copy_only=False).view(np.uint64))
                n = last - first + window
                codes = sequence_hashes(words, first, n)
                for part, x in zip(out, (codes, np.full(len(codes), ids[i], np.int64), first, n), strict=True):
                    part.append(x)
            code, doc, pos, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
            yield pa.RecordBatch.from_arrays([_signed(code), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], ["code", "doc_id", "pos", "n"])

    return docs.select("doc_id", "text", "wanted").mapInArrow(run, "code long, doc_id long, pos int, n int")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """code, doc_id, pos, n: each window of the runs (`pos` and `n`, arrays) of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, (text, pos, n) in enumerate(zip(byte_views(batch.column(1)), batch.column(2), batch.column(3), strict=True)):
                words = word_hashes(text, *word_bounds(text))
                own = [np.arange(p, p + k - window + 1) for p, k in zip(pos.values.to_numpy(), n.values.to_numpy(), strict=True)]
                at = np.unique(np.concatenate(own))
                codes = sequence_hashes(words, at, window)
                for part, x in zip(out, (codes, np.full(len(codes), ids[i], np.int64), at), strict=True):
                    part.append(x)
            code, doc, pos = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
            yield pa.RecordBatch.from_arrays([_signed(code), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(np.full(len(pos), window, np.int32))], ["code", "doc_id", "pos", "n"])

    return docs.mapInArrow(run, "code long, doc_id long, pos int, n int")


def _with_first(rows: DataFrame) -> DataFrame:
    """`rows` with the first document that holds the same words (from_id) and the place there (from_pos).

    The first ones are stored, so that the join deals both sides anew and Spark can split a code that very many rows have.
    """
    first = stored(rows.groupBy("code", "n").agg(F.min(F.struct("doc_id", "pos")).alias("f")), "phrases-firsts")
    return rows.join(first, ["code", "n"]).select("doc_id", "pos", "n", F.col("f.doc_id").alias("from_id"), F.col("f.pos").alias("from_pos"))


def _claims(rows: DataFrame) -> DataFrame:
    """Those of `rows` that stand in an earlier document."""
    return rows.filter("doc_id > from_id").select("doc_id", "pos", "n", "from_id", "from_pos")


def _passages(claims: DataFrame, window: int) -> DataFrame:
    """doc_id, from_id, from_pos, n: the claims of each document, with those that continue each other joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = own.values
                pos, n, src, at = (table.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                order = np.lexsort((pos, pos - at, src))
                pos, n, src, at = pos[order], n[order], src[order], at[order]
                new = np.ones(len(pos), bool)
                reach = pos + n - window + 1  # the window after the last of this claim
                new[1:] = (src[1:] != src[:-1]) | (pos[1:] - at[1:] != pos[:-1] - at[:-1]) | (pos[1:] > reach[:-1])
                begin = np.flatnonzero(new)
                end = np.maximum.reduceat(pos + n, begin)
                out += zip([doc] * len(begin), src[begin].tolist(), at[begin].tolist(), (end - pos[begin]).tolist(), strict=True)
            doc, src, at, n = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(src, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "from_id", "from_pos", "n"])

    grouped = claims.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n", "from_id", "from_pos")).alias("own"))
    return grouped.mapInArrow(run, "doc_id long, from_id long, from_pos int, n int")


def _phrases(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """shard, from_id, phrase: the words of each passage wanted by a shard, from the document that holds it first.

    A first document of which very many shards want passages is dealt, with its text, to as many parts as they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            shards, ids, phrases = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(ids, pa.int64()), pa.array(phrases, pa.binary())], ["shard", "from_id", "phrase"])

        rows, size = [], 0
        for batch in batches:
            for doc, view, own in zip(batch.column(0).to_pylist(), byte_views(batch.column(1)), batch.column(2), strict=True):
                words = view.tobytes().split()
                for w in own.as_py():
                    rows.append((w["shard"], doc, b" ".join(words[w["from_pos"] : w["from_pos"] + w["n"]])))
                    size += len(rows[-1][2])
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    wanted = stored(wanted, "phrases-wanted")
    # stored, so that the join can split a first document that very many passages come from
    parts = stored(wanted.groupBy("from_id").agg(F.ceil(F.sum("n") / PART_WORDS).cast("int").alias("parts")), "phrases-parts")
    part = F.pmod(F.xxhash64("shard", "from_pos", "n"), F.col("parts")).cast("int").alias("part")
    own = wanted.join(parts, "from_id").groupBy(F.col("from_id").alias("doc_id"), part).agg(F.collect_list(F.struct("shard", "from_pos", "n")).alias("own"))
    texts = docs.join(parts, F.col("doc_id") == F.col("from_id")).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")
    # a broadcast would leave all parts of a document in the task that dealt them out
    return texts.join(own.hint("merge"), ["doc_id", "part"]).select("doc_id", "text", "own").mapInArrow(run, "shard long, from_id long, phrase binary")


def locate(phrases: pd.DataFrame, docs: pd.DataFrame, window: int) -> pd.DataFrame:
    """doc_id, key (digest of the text), n_removed, kept of the documents of one shard, by an automaton over the shard's passages."""
    numbers: dict[bytes, int] = {}
    number = lambda words: tuple(numbers.setdefault(w, len(numbers)) for w in words)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for src, phrase in sorted(zip(phrases["from_id"], phrases["phrase"], strict=True), reverse=True):  # the smallest id is added last and stays
        key = number(phrase.split())
        automaton.add_word(key, (src, len(key)))
    automaton.make_automaton()
    out = []
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        words = text.encode().split()
        change = np.zeros(len(words) + 1, np.int64)
        for end, (src, n) in automaton.iter(number(words)):
            if src < doc:
                change[end + 1 - n] += 1
                change[end + 1] -= 1
        covered = np.cumsum(change[:-1]) > 0
        kept = b" ".join(w for w, gone in zip(words, covered.tolist(), strict=True) if not gone)
        out.append((doc, hashlib.md5(text.encode()).digest(), int(covered.sum()), kept.decode()))
    return pd.DataFrame(out, columns=["doc_id", "key", "n_removed", "kept"])


def remove_repeated(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """What is left of the documents without passages of `window` words that stand in an earlier one.

    Returns one row for each input row with doc_id, n_words, n_removed, kept_sha256 (of the
    words left), and the documents that lost words and are no copies of an earlier one:
    doc_id, key (MD5 of the text), n_removed, kept (the words left).
    """
    docs = docs.select(integer_id(docs), F.col("text").cast("string").alias("text"))
    scanned = stored(_scan(docs, window, phrase), "phrases-scan")
    identified = scanned.filter("doc_id is not null")
    # what is joined back by a key that many rows may share is stored first: so Spark can split the key in the join
    firsts = stored(identified.groupBy("copy_key").agg(F.min("doc_id").alias("first_id")), "phrases-copies")
    anchors = identified.join(firsts, "copy_key").filter("doc_id = first_id").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = stored(anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"), "phrases-shared")
    wanted = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("wanted"))
    held = stored(docs.filter("text is not null").join(wanted, "doc_id").dropDuplicates(["doc_id", "text"]), "phrases-held")
    runs = stored(_with_first(_run_rows(held, window, phrase)), "phrases-runs")
    unmatched = runs.filter("doc_id = from_id").groupBy("doc_id").agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"))
    rows = stored(_window_rows(held.select("doc_id", "text").join(unmatched, "doc_id"), window), "phrases-windows")
    claims = _claims(runs).unionByName(_claims(_with_first(rows)))
    passages = stored(_passages(claims, window), "phrases-passages")
    targets = passages.select("doc_id").distinct()
    n_shards = max(1, targets.count() // SHARD_DOCS)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).alias("shard")
    phrases = _phrases(passages.select(shard, "from_id", "from_pos", "n").distinct(), held)
    streamed = held.select("doc_id", "text").join(targets, "doc_id").select(shard, "doc_id", "text")
    changed = (
        phrases.groupBy("shard").cogroup(streamed.groupBy("shard"))
        .applyInPandas(lambda a, b: locate(a, b, window), "doc_id long, key binary, n_removed long, kept string")
    )
    changed = stored(changed.filter("n_removed > 0"), "phrases-changed")
    cut = changed.select("doc_id", F.col("key").alias("copy_key"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    summary = scanned.join(firsts, "copy_key", "left").join(cut, ["doc_id", "copy_key"], "left")
    copied = (F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= window)
    return summary.select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    ), changed


def op3_phrases(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document."""
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS m FROM wins GROUP BY h),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM wins JOIN firsts USING (h) WHERE m < doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
