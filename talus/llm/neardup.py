"""MinHash near-dedup: a chosen-path set similarity join and the components of its links.

Documents are sets of word shingles. Documents with equal sets are one class, which the
smallest doc_id stands for. Each class has a signature of minwise tokens. In a tree every
node chooses, by a hash of the path that leads to it, a few coordinates that the path has not
used, and each of its classes descends into one child for each of them: the one of its
minwise token there. A node of few classes is compared exhaustively, a larger one branches
on. Independent trees are repeated until a pair at the threshold meets with the target recall.

A large node whose classes are all alike would not get smaller by branching. It is linked
through representatives: the classes nearest to the commonest token of each coordinate are
compared with all others, block by block; nodes that have the same nearest class are treated as
one. What this does not join to the node's largest part is then compared with all of the
node, so that no link to it is lost.

Within a node the signatures show which classes may be similar (a cut four standard
deviations below the threshold); their full sets are then fetched and intersected, and
only what the full sets confirm is a link. Components are found by alternating
large-star and small-star steps.

Edge cases: null, empty and wordless texts have an empty set, link with nothing and are
kept; texts of fewer words than a shingle are one shingle; repeated rows share their
doc_id and component and are all kept or dropped alike; a row without doc_id is kept; a
doc_id that is no integer is refused (TypeError); an empty table gives no rows; texts are
read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import byte_views, integer_id, stored
from talus.llm.hashing import mixed, sequence_hashes, word_bounds, word_hashes

SHINGLE = 5
COORDINATES = 64
#: Classes of a node that is compared exhaustively, levels of a tree, and coordinates that a node chooses.
NODE, LEVELS, CHOSEN = 512, 4, 2
#: Classes of a large node that show whether it is dense, and its representatives.
SAMPLE, REPRESENTATIVES = 64, 16
#: Shingles that one task holds at once to confirm links; a part with more is confirmed by pairs of pieces.
PART_SHINGLES = 1 << 22

_RANDOM = np.random.default_rng(20180711)
_FACTORS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NUMBERS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64))


def meeting(threshold: float, levels: int) -> float:
    """Probability that a pair at the threshold reaches a common node of some level in one tree.

    Its signatures are taken to agree in one standard deviation less than the threshold.
    """
    p, q = threshold - math.sqrt(threshold * (1 - threshold) / COORDINATES), 1.0
    for _ in range(levels):
        q = 1 - (1 - p * q) ** CHOSEN
    return q


def trees_for(recall: float, threshold: float) -> int:
    """Trees in which a pair at the threshold reaches a common node of the last level with the given recall."""
    q = meeting(threshold, LEVELS)
    return 1 if q >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def shingle_set(text: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text (UTF-8 bytes)."""
    low = _LOWER[text]
    words = word_hashes(low, *word_bounds(low))
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    return np.unique(sequence_hashes(words, np.arange(len(words) - size + 1), size))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minwise hashes of a set."""
    least = np.full(COORDINATES, (1 << 32) - 1, np.uint32)
    for i in range(0, len(shingles), 2048):
        part = (shingles[i : i + 2048, None] * _FACTORS + _SHIFTS) >> np.uint64(32)
        least = np.minimum(least, part.min(axis=0).astype(np.uint32))
    return least


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set_key (digest of the set), n_shingles and signature for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, signatures = [], [], []
            for view in byte_views(batch.column(1)):
                s = shingle_set(view if view is not None else np.empty(0, np.uint8), size)
                keys.append(hashlib.md5(s.tobytes()).digest())
                counts.append(len(s))
                signatures.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "set_key", "n_shingles", "signature"])

    return docs.mapInArrow(run, "doc_id long, set_key binary, n_shingles long, signature binary")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(n, COORDINATES)


def chosen_coordinates(nodes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The coordinates that each node chooses by its path, of those that are not used (bits) on it."""
    order = mixed(nodes[:, None] ^ _NUMBERS)
    taken = (used[:, None] >> np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(1)
    order[taken.astype(bool)] = np.iinfo(np.uint64).max
    return np.argpartition(order, CHOSEN - 1, axis=1)[:, :CHOSEN]


def _children(nodes: np.ndarray, used: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """node, used, id: the children into which classes (signatures m) descend."""
    at = chosen_coordinates(nodes, used)
    token = np.take_along_axis(m, at, 1).astype(np.uint64)
    child = mixed(nodes[:, None] * np.uint64(3) + mixed(token + (at.astype(np.uint64) + np.uint64(1) << np.uint64(32))))
    path = used[:, None] | np.uint64(1) << at.astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(child.ravel().view(np.int64)), pa.array(path.ravel().view(np.int64)), pa.array(np.repeat(ids, CHOSEN))], ["node", "used", "id"])


def _roots(classes: DataFrame, trees: int) -> DataFrame:
    """node, used, id: the children of the root of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, m = batch.num_rows, batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)
            for root in mixed(np.arange(1, trees + 1, dtype=np.uint64)):
                yield _children(np.full(n, root), np.zeros(n, np.uint64), ids, m)

    return classes.select("id", "signature").mapInArrow(run, "node long, used long, id long")


def _branch(rows: DataFrame) -> DataFrame:
    """node, used, id: the children of the nodes of `rows`, which have the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, used = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            yield _children(nodes, used, batch.column(2).to_numpy(), _matrix(batch.column(3), batch.num_rows))

    return rows.select("node", "used", "id", "signature").mapInArrow(run, "node long, used long, id long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal first column, which is sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        at = 0
        for cut in [*cuts.tolist(), batch.num_rows]:
            if held and held[-1].column(0)[0].as_py() != key[at]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(at, cut - at))
            at = cut
    if held:
        yield pa.concat_batches(held)


def _components(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric Boolean matrix reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _may_be_similar(signatures: np.ndarray, least: int) -> np.ndarray:
    n = len(signatures)
    equal = np.zeros((n, n), np.uint8)
    for c in range(COORDINATES):
        column = signatures[:, c]
        equal += column[:, None] == column[None, :]
    return equal >= least


def _pieces(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in order, cut where their sizes add up to more than `most`."""
    piece = np.zeros(len(sizes), int)
    held = 0
    for i, n in enumerate(sizes.tolist()):
        new = held and held + n > most
        piece[i] = (piece[i - 1] if i else 0) + bool(new)
        held = n if new else held + n
    return [np.flatnonzero(piece == k) for k in range(piece[-1] + 1)] if len(piece) else []


def _similar_parts(nodes: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """part, id: within each node, the classes that signatures connect; equal parts of several nodes have the same name.

    Classes of one `label` (if `nodes` has one) are known to be connected, and are not compared with each other.
    A part with very many shingles is dealt as pairs of its pieces.
    """
    labelled = "label" in nodes.columns

    def emit(ids: np.ndarray) -> pa.RecordBatch:
        name = int.from_bytes(hashlib.md5(ids.tobytes()).digest()[:8], "little", signed=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name)), pa.array(ids)], ["part", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            n = group.num_rows
            ids, m, sizes = group.column(1).to_numpy(), _matrix(group.column(2), n), group.column(3).to_numpy()
            linked = _may_be_similar(m, least)
            if labelled:
                label = group.column(4).to_numpy()
                linked &= label[:, None] != label[None, :]
                np.fill_diagonal(linked, True)
            found = _components(linked)
            for k in np.flatnonzero(np.bincount(found, minlength=n) > 1):
                rows = np.flatnonzero(found == k)
                rows = rows[np.argsort(ids[rows])]
                pieces = _pieces(sizes[rows], PART_SHINGLES // 2)
                for i, a in enumerate(pieces):
                    for b in pieces[i + 1 :] if len(pieces) > 1 else [a[:0]]:
                        yield emit(ids[rows[np.concatenate([a, b])]])

    dealt = nodes.join(classes.select("id", "signature", "n_shingles"), "id").select("node", "id", "signature", "n_shingles", *(["label"] if labelled else []))
    return dealt.repartition("node").sortWithinPartitions("node").mapInArrow(run, "part long, id long").distinct()


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, size).tobytes() for x in byte_views(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles binary")


def similar_pairs(sets: list[np.ndarray], numerator: int, denominator: int) -> np.ndarray:
    """Which sets are similar: denominator x intersection >= numerator x union, on all elements."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    shared = df[at] > 1
    rows, at = rows[shared], np.unique(at[shared], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    inter = np.zeros((n, n))
    width = max(256, (1 << 22) // n)
    for begin in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, (begin, begin + width))
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], at[a:b] - begin] = 1
        inter += part @ part.T
    inter = inter.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    out = denominator * inter >= numerator * union
    np.fill_diagonal(out, False)
    return out


def _links(parts: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """a, b: within each part, the smallest id of each component of confirmed links, and its other ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids = group.column(1).to_numpy()
            order = np.argsort(ids, kind="stable")
            own = [np.frombuffer(x, np.uint64) for x in group.column(2).to_pylist()]
            label = _components(similar_pairs([own[i] for i in order], numerator, denominator))
            a, b = ids[order][label], ids[order]
            keep = a != b
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    dealt = parts.join(sets, "id").select("part", "id", "shingles").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _confirmed(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """a, b: links between the classes of `nodes` (node, id and perhaps label), confirmed on their full sets."""
    threshold = numerator / denominator
    least = math.floor(COORDINATES * threshold - 4 * math.sqrt(COORDINATES * threshold * (1 - threshold)))
    parts = stored(_similar_parts(nodes, classes, least), "neardup-parts")
    wanted = parts.select("id").distinct()
    # a merge join at every size: `wanted` grows with the input, and small inputs should plan like large ones
    sets = _sets(docs.filter("text is not null").withColumnRenamed("doc_id", "id").join(wanted.hint("merge"), "id"), size)
    return _links(parts, sets, numerator, denominator)


def _centres(large: DataFrame, threshold: float) -> DataFrame:
    """node, n, centre (the commonest token of each coordinate, in a sample) and dense (whether classes agree with it) of large nodes."""
    order = Window.partitionBy("node").orderBy(F.xxhash64(F.lit("centre"), "id"))
    sample = large.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE)

    def centre(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(len(frame), COORDINATES)
        middle = np.empty(COORDINATES, np.uint32)
        for c in range(COORDINATES):
            values, counts = np.unique(m[:, c], return_counts=True)
            middle[c] = values[np.argmax(counts)]
        return pd.DataFrame({"node": frame["node"].iloc[:1], "n": frame["n"].iloc[:1], "centre": [middle.tobytes()], "dense": [bool((m == middle).mean() >= threshold**2)]})

    return sample.groupBy("node").applyInPandas(centre, "node long, n long, centre binary, dense boolean")


def _representatives(rows: DataFrame) -> DataFrame:
    """node, id, k: the classes of each node (with its `centre`) whose signatures agree most with the centre, k from 1."""

    def agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            same = (_matrix(batch.column(2), n) == _matrix(batch.column(3), n)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same.astype(np.int32))], ["node", "id", "same"])

    scored = rows.select("node", "id", "signature", "centre").mapInArrow(agreements, "node long, id long, same int")
    order = Window.partitionBy("node").orderBy(F.desc("same"), "id")
    return scored.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= REPRESENTATIVES).select("node", "id", "k")


def _united(alike: DataFrame, representatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large nodes (node, id, n) and their representatives (node, id), with nodes that have the same first representative made one."""
    first = stored(representatives.filter("k = 1").select("node", F.col("id").alias("first")), "neardup-first")
    of = lambda df: df.join(first, "node").select(F.col("first").alias("node"), "id").distinct()
    rows = stored(of(alike.select("node", "id")), "neardup-united")
    sizes = stored(rows.groupBy("node").agg(F.count("*").alias("n")), "neardup-united-sizes")
    return rows.join(sizes, "node"), of(representatives.select("node", "id"))


def _block(n: int, name: str):
    """A number from 0 to n_blocks - 1 for each class; blocks have about n classes."""
    n_blocks = F.ceil(F.col("n") / max(n, 1)).cast("int")
    return n_blocks, F.pmod(F.xxhash64(F.lit(name), "id"), n_blocks).cast("int")


def through_representatives(dense: DataFrame, representatives: DataFrame) -> DataFrame:
    """node, id: dense nodes (node, id, n) as blocks, each with the node's representatives."""
    n_blocks, block = _block(NODE // 2, "block")
    own = dense.select(F.xxhash64("node", block).alias("node"), "id")
    sizes = dense.select("node", "n").distinct()
    sent = representatives.join(sizes, "node").select("node", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("b"), "id")
    return own.unionByName(sent.select(F.xxhash64("node", "b").alias("node"), "id")).distinct()


def rest_with_all(dense: DataFrame, components: DataFrame) -> DataFrame:
    """node, id, label: what is not in the largest known component of its dense node, block by block with all of the node."""
    rows = dense.join(components, "id", "left").select("node", "id", "n", F.coalesce("component", "id").alias("label"))
    rows = stored(rows, "neardup-labels")
    sizes = rows.groupBy("node", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("node").agg(F.max_by("label", F.struct("k", "label")).alias("main"), (F.sum("k") - F.max("k")).alias("n_rest"))
    main = stored(main.filter("n_rest > 0"), "neardup-main")
    rows = rows.join(main, "node")
    n_rest, in_rest = F.ceil(F.col("n_rest") / NODE).cast("int"), F.col("label") != F.col("main")
    n_all, block = _block(NODE, "all")
    rest_block = F.pmod(F.xxhash64(F.lit("rest"), "id"), n_rest).cast("int")
    every = rows.select("node", F.explode(F.sequence(F.lit(0), n_rest - 1)).alias("i"), block.alias("j"), "id", "label")
    rest = rows.filter(in_rest).select("node", rest_block.alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"), "id", "label")
    return every.unionByName(rest).select(F.xxhash64("node", "i", "j").alias("node"), "id", "label").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id it reaches) for each id of `edges` (a, b) but the smallest ones."""

    def tally(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = tally(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = stored(large, "edges-large")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small, "edges-small")
        now = tally(edges)
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, numerator: int = 80, denominator: int = 100, size: int = SHINGLE, recall: float = 0.999) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    Linked are documents with denominator x intersection >= numerator x union of their sets.
    """
    threshold = numerator / denominator
    docs = docs.select(integer_id(docs), F.col("text").cast("string").alias("text"))
    scanned = stored(_scan(docs, size), "neardup-scan")
    members = scanned.filter("doc_id is not null and n_shingles > 0")
    least = F.min(F.struct("doc_id", "signature", "n_shingles")).alias("m")
    classes = stored(members.groupBy("set_key").agg(least).select("set_key", F.col("m.doc_id").alias("id"), F.col("m.signature").alias("signature"), F.col("m.n_shingles").alias("n_shingles")), "neardup-classes")
    signatures = classes.select("id", "signature")
    confirmed = lambda nodes: _confirmed(nodes, classes, docs, size, numerator, denominator)

    rows, small, dense = stored(_roots(classes, trees_for(recall, threshold)), "neardup-level"), [], []
    for level in range(1, LEVELS + 1):
        # stored, so that the join deals both sides anew and Spark can split a node that very many classes share
        sizes = stored(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "neardup-sizes")
        met = rows.join(sizes, "node")
        small.append(met.filter(F.col("n") <= NODE).select("node", "id"))
        large = met.filter(F.col("n") > NODE).join(signatures, "id").select("node", "used", "id", "n", "signature")
        large = stored(large, "neardup-large")
        if large.isEmpty():
            break
        centres = stored(_centres(large, threshold), "neardup-centres")
        found = large.join(centres.drop("n"), "node")
        stays = F.col("dense") | F.lit(level == LEVELS)
        dense.append(found.filter(stays).select("node", "id", "n", "signature", "centre"))
        if level < LEVELS:
            rows = stored(_branch(found.filter(~F.col("dense"))), "neardup-level")
    nodes, links = small[0], None
    for more in small[1:]:
        nodes = nodes.unionByName(more)
    if dense:
        alike = dense[0]
        for more in dense[1:]:
            alike = alike.unionByName(more)
        alike = stored(alike, "neardup-dense")
        united, representatives = _united(alike, stored(_representatives(alike), "neardup-representatives"))
        links = stored(confirmed(through_representatives(united, representatives)), "neardup-links")
        rest = rest_with_all(united, connected(links))
        nodes = nodes.withColumn("label", F.col("id")).unionByName(rest)
    more = confirmed(nodes)
    components = connected(more if links is None else links.unionByName(more))
    named = classes.select("set_key", "id").join(components, "id", "left").select("set_key", F.coalesce("component", "id").alias("found"))
    out = scanned.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("found", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_neardup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document, linked from 85 % on."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85, 100)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id ON a = d.doc_id
"""
