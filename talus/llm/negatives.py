"""Hard-negative mining with lists that the anchors of a cluster share.

Anchors are clustered by direction. No score of an anchor u in a cluster with a candidate i exceeds
|u| |i| cos(max(0, angle(i, centre) - radius)), the radius being the largest angle of a member: for each cluster,
candidates are sorted by this bound once, and every member walks the list until the bound of what is
left is below what it still seeks. Candidates are dealt to parts of bounded size and anchors to
groups; a pair of group and part is one task's work, with a list of the part for each of the
group's clusters, and pairs whose bound is below what all members seek are not made at all.

First the positives: the best rows of the anchor's label, in the parts nearest to it, then in the others as far
as these can hold better ones. Then, for each positive's score, the best rows of other labels within
a window below it, over all parts that can reach the window.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part; of rows
of one id, that of the smallest label and vector does; vectors of different lengths are
continued by zeros; equal vectors of one label are one class, of which only the smallest ids can be among
the first; ties go to the smaller id; zero vectors score 0 with all; a positive of negative score has
no window; without anchors or candidates there are no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import sampled, stored

#: Anchors of a group and candidates of a part, at most about; members that walk at once, and steps of their walk.
GROUP, PART, AT_ONCE, STEP = 2048, 4096, 256, 512
#: Label buckets, clusters of anchors and cells of candidates at most, and rows that their centres are fitted on.
BUCKETS, CLUSTERS, CELLS, SAMPLE = 32, 256, 256, 8192
#: Added to bounds, as a share of both lengths, against rounding.
SLACK = 1e-6


def integer_vectors(rows: DataFrame, vec_id: str, label: Column, vector: str, scale: float) -> DataFrame:
    """vec_id, label and v (floor(scale * component), as doubles) of the rows that take part, one for each id."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    whole = ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    known = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(whole, v).alias("v")).dropna()
    first = Window.partitionBy("vec_id").orderBy("label", "v")
    return known.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    for row, v in zip(out, column.to_pylist(), strict=True):
        row[: len(v)] = v
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(length, 1e-300)[:, None], length


def directions(rows: DataFrame, n: int, k: int, width: int) -> np.ndarray:
    """Centres of k clusters by direction, fitted on about SAMPLE of the n rows."""
    sample = rows if n <= SAMPLE else rows.filter(sampled(SAMPLE / n, "vec_id"))
    got = sample.select("vec_id", "v").toPandas().sort_values("vec_id")
    x, _ = _unit(_matrix(pa.array(got["v"].to_list(), pa.list_(pa.float64())), width))
    if not len(x):
        return np.zeros((1, width))
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(8 if k > 1 else 1):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        new, length = _unit(sums)
        centres = np.where(length[:, None] > 0, new, centres)
    return centres


def _nearest(rows: DataFrame, centres: np.ndarray, name: str) -> DataFrame:
    """`rows` with the number of the nearest centre, the angle to it and the vector's length."""
    at, fields = rows.columns.index("v"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for batch in batches:
            x, length = _unit(_matrix(batch.column(at), centres.shape[1]))
            cosine = x @ centres.T
            own = np.argmax(cosine, axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(x)), own], -1, 1))
            columns = [*batch.columns, pa.array(own, pa.int32()), pa.array(angle), pa.array(length)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, name, "angle", "length"])

    return rows.mapInArrow(run, f"{fields}, {name} int, angle double, length double")


def _dealt(rows: DataFrame, outer: str, inner: str, size: int, name: str, pack: bool) -> tuple[DataFrame, DataFrame]:
    """`rows` with `name`, a number of a set of about `size` rows of one `outer`, and the first and last number of each outer.

    Where `pack`, small inners of an outer share a set; large ones are split by a hash of the id.
    """
    spark = rows.sparkSession
    counts = sorted(tuple(r) for r in rows.groupBy(outer, inner).count().collect())  # buckets times centres at most
    plan, ends, at, filled = [], [], -1, size
    for i, (o, k, n) in enumerate(counts):
        new = not i or counts[i - 1][0] != o
        split = -(-n // size)
        if new or not pack or split > 1 or filled + n > size:
            at, filled = at + 1, 0
            if new:
                ends.append([o, at, at])
        plan.append((o, k, at, split))
        at, filled = at + split - 1, size if split > 1 else filled + n
        ends[-1][2] = at
    table = spark.createDataFrame(plan, f"{outer} int, {inner} int, _first long, _split long")
    own = F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_split"))
    return rows.join(F.broadcast(table), [outer, inner]).withColumn(name, own).drop("_first", "_split"), spark.createDataFrame([tuple(e) for e in ends], f"{outer} int, _low long, _high long")


def _lists(anchors: pa.Table, candidates: pa.Table, centres: np.ndarray):
    """For each cluster of the anchors: its members' numbers, candidates in order of their bound, and the bounds for anchors of length 1."""
    width = centres.shape[1]
    x, ids = _matrix(candidates["v"], width), candidates["vec_id"].to_numpy()
    y, length = _unit(x)
    cluster, angle = anchors["cluster"].to_numpy(), anchors["angle"].to_numpy()
    u = _matrix(anchors["v"], width)
    for c in np.unique(cluster):
        members = np.flatnonzero(cluster == c)
        away = np.arccos(np.clip(y @ centres[c], -1, 1))
        bound = length * (np.cos(np.maximum(0.0, away - angle[members].max())) + SLACK)
        order = np.lexsort((ids, -bound))
        yield u, x, members, order, bound[order]


def _walk(u: np.ndarray, length: np.ndarray, x: np.ndarray, bound: np.ndarray, allowed: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores of members with the candidates of a list, -inf beyond where a member stops, and for each window the k-th best in it.

    `windows`: lowest and highest score sought by each member; a member stops where no
    candidate left can be among the k best of any of its windows.
    """
    scores = np.full((len(u), len(x)), -np.inf)
    best = [np.full((len(u), k), -np.inf) for _ in windows]
    active = np.arange(len(u))
    for a in range(0, len(x), STEP):
        sought = np.min([np.where(low > high, np.inf, np.maximum(low, b.min(axis=1)))[active] for (low, high), b in zip(windows, best, strict=True)], axis=0)
        active = active[length[active] * bound[a] >= sought]
        if not len(active):
            break
        part = slice(a, a + STEP)
        found = np.where(allowed[active, part], u[active] @ x[part].T, -np.inf)
        scores[active, part] = found
        for (low, high), b in zip(windows, best, strict=True):
            inside = np.where((found >= low[active, None]) & (found <= high[active, None]), found, -np.inf)
            both = np.hstack([b[active], inside])
            b[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    return scores, [b.min(axis=1) for b in best]


def _first(member: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each member, by score and then id."""
    order = np.lexsort((ids, -score, member))
    own = member[order]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, int)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < k]


def _seek(anchors: pa.Table, candidates: pa.Table, centres: np.ndarray, same: bool, windows: np.ndarray, k: int):
    """(anchor's number, window's number, candidate's number, score): the first k of each anchor and window in one part.

    `windows` is [anchor, window, (lowest, highest)].
    """
    ids, labels = candidates["vec_id"].to_numpy(), candidates["label"].to_numpy()
    own_ids, own_labels, lengths = (anchors[c].to_numpy() for c in ("vec_id", "label", "length"))
    for u, x, members, order, bound in _lists(anchors, candidates, centres):
        listed, near = x[order], ids[order]
        for a in range(0, len(members), AT_ONCE):
            m = members[a : a + AT_ONCE]
            allowed = ((own_labels[m, None] == labels[order]) == same) & (own_ids[m, None] != near)
            each = [(windows[m, j, 0], windows[m, j, 1]) for j in range(windows.shape[1])]
            scores, kth = _walk(u[m], lengths[m], listed, bound, allowed, each, k)
            for j, ((low, high), least) in enumerate(zip(each, kth, strict=True)):
                row, col = np.nonzero((scores >= np.maximum(low, least)[:, None]) & (scores <= high[:, None]) & np.isfinite(scores))
                keep = _first(row, scores[row, col], near[col], k)
                yield m[row[keep]], j, order[col[keep]], scores[row[keep], col[keep]]


class _Mine:
    """Anchors and candidates as they are dealt out, with their centres."""

    def __init__(self, rows: DataFrame, is_anchor: Column, k: int) -> None:
        first = Window.partitionBy("label", "v").orderBy("vec_id")
        classes = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).drop("_n")
        bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")
        n = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a"), F.max(F.size("v")).alias("w")).first()
        self.n_anchors, self.width = n["a"], n["w"] or 0
        if not self.n_anchors:
            return
        anchors = rows.filter(is_anchor)
        self.centres = directions(anchors, n["a"], max(1, min(CLUSTERS, math.isqrt(n["a"]))), self.width)
        self.cells = directions(rows, n["n"], max(1, min(CELLS, n["n"] // (BUCKETS * PART))), self.width)
        self.anchors = stored(_nearest(anchors.withColumn("bucket", bucket), self.centres, "cluster"), "negatives-anchors")
        cut, self.parts_of = _dealt(_nearest(classes.withColumn("bucket", bucket), self.cells, "cell"), "bucket", "cell", PART, "part", pack=False)
        self.parts = stored(cut, "negatives-parts")
        self.all_parts = tuple(self.parts_of.agg(F.min("_low"), F.max("_high")).first())
        self.summary = self.parts.groupBy("part", "cell").agg(F.max("length").alias("longest"), F.max("angle").alias("spread"))
        cosine = np.clip(self.centres @ self.cells.T, -1, 1)
        between = [(int(c), int(d), float(np.arccos(cosine[c, d])), bool(d == np.argmax(cosine[c]))) for c in range(len(self.centres)) for d in range(len(self.cells))]
        self.between = rows.sparkSession.createDataFrame(between, "cluster int, cell int, apart double, home boolean")  # clusters times cells at most

    def pairs(self, members: DataFrame, ranges: DataFrame | tuple[int, int], outer: str, home: bool | None) -> DataFrame:
        """(group, part) in which some member may find what it seeks (`floor`), by the bound of a whole part.

        `home`: only parts nearest to a cluster of the group, or only others.
        """
        clusters = members.groupBy("group", outer, "cluster").agg(F.max("angle").alias("radius"), F.max("length").alias("most"), F.min("floor").alias("floor"))
        if isinstance(ranges, tuple):  # all parts
            clusters = clusters.withColumns({"_low": F.lit(ranges[0]).cast("long"), "_high": F.lit(ranges[1]).cast("long")})
        else:
            clusters = clusters.join(F.broadcast(ranges), outer)
        near = clusters.withColumn("part", F.explode(F.sequence("_low", "_high"))).join(self.summary, "part").join(F.broadcast(self.between), ["cluster", "cell"])
        angle = F.greatest(F.lit(0.0), F.col("apart") - F.col("spread") - F.col("radius"))
        reach = F.col("most") * F.col("longest") * (F.cos(angle) + SLACK)
        able = near.groupBy("group", "part").agg(F.bool_or(reach >= F.col("floor")).alias("able"), F.bool_or("home").alias("home")).filter("able")
        return (able if home is None else able.filter(F.col("home") == home)).select(F.col("group").cast("long").alias("group"), F.col("part").cast("long").alias("part"))  # both sides of a co-group are dealt by the same type

    def sought(self, members: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
        pairs = stored(pairs, "negatives-pairs")
        left = members.join(pairs, "group").groupBy("group", "part")
        right = self.parts.select("part", "vec_id", "label", "v").join(pairs.select(F.col("group").alias("for_group"), "part"), "part").groupBy("for_group", "part")
        return left.cogroup(right).applyInArrow(run, schema)

    def positives(self, k: int) -> DataFrame:
        """anchor_id, positive_id, positive_score: the first k rows of the same label."""
        centres = self.centres

        def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
            low = anchors["floor"].to_numpy()
            windows = np.stack([low, np.full(len(low), np.inf)], axis=1)[:, None, :]
            out = list(_seek(anchors, candidates, centres, True, windows, k)) if anchors.num_rows and candidates.num_rows else []
            who, near, score = (np.concatenate([x[i] for x in out]) if out else np.empty(0) for i in (0, 2, 3))
            own, ids = anchors["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
            return pa.table({"anchor_id": own[who.astype(int)], "positive_id": ids[near.astype(int)], "positive_score": score.astype(np.int64)})

        schema = "anchor_id long, positive_id long, positive_score long"
        best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        top = lambda df: df.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")
        members, _ = _dealt(self.anchors, "bucket", "cluster", GROUP, "group", pack=True)
        members = members.withColumn("floor", F.lit(-math.inf))
        found = stored(top(self.sought(members, self.pairs(members, self.parts_of, "bucket", True), run, schema)), "negatives-nearest")
        if len(self.cells) == 1:  # all parts are of the nearest cell
            return found
        floors = found.groupBy("anchor_id").agg(F.when(F.count("*") >= k, F.min("positive_score")).alias("least"))
        later = members.drop("floor").join(floors.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce(F.col("least").cast("double"), F.lit(-math.inf))).drop("least")
        later = stored(later, "negatives-floors")
        return stored(top(found.unionByName(self.sought(later, self.pairs(later, self.parts_of, "bucket", False), run, schema))), "negatives-positives")

    def negatives(self, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
        """anchor_id, positive_score, negative_id, negative_score, rank: the first k rows of other labels in each window."""
        centres = self.centres

        def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
            asked = anchors["scores"].to_pylist()
            most = max(map(len, asked), default=0)
            p = np.array([[*s, *[-1.0] * (most - len(s))] for s in asked], float).reshape(len(asked), most)
            windows = np.stack([np.where(p < 0, np.inf, np.ceil(low * p / 100)), np.where(p < 0, -np.inf, np.floor(high * p / 100))], axis=2)
            out = list(_seek(anchors, candidates, centres, False, windows, k)) if most and candidates.num_rows else []
            who, near, score = (np.concatenate([x[i] for x in out]).astype(int) if out else np.empty(0, int) for i in (0, 2, 3))
            which = np.concatenate([np.full(len(x[0]), x[1]) for x in out]) if out else np.empty(0, int)
            own, ids = anchors["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
            return pa.table({"anchor_id": own[who], "positive_score": p[who, which].astype(np.int64), "negative_id": ids[near], "negative_score": score})

        scores = positives.filter("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))  # as many as positives asked for
        members = self.anchors.withColumn("outer", F.lit(0)).join(scores.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("floor", F.array_min("scores") * (low / 100))
        members = stored(_dealt(members, "outer", "cluster", GROUP, "group", pack=True)[0], "negatives-windows")
        found = self.sought(members, self.pairs(members, self.all_parts, "outer", None), run, "anchor_id long, positive_score long, negative_id long, negative_score long")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for `rows` of vec_id, label and v (see integer_vectors).

    For each of an anchor's first `positives` rows of its label, the first `negatives` rows of other labels whose
    score is from `low` to `high` hundredths of the positive's.
    """
    rows = stored(rows, "negatives-rows")
    mine = _Mine(rows, is_anchor, max(positives, negatives))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not mine.n_anchors:
        return rows.sparkSession.createDataFrame([], schema)
    found = mine.positives(positives)
    return found.join(mine.negatives(found, negatives, low, high), ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: five for each of an anchor's five positives."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(integer_vectors(vectors, "vec_id", label, "embedding", 256.0), F.col("vec_id") % 100 == 0)


SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id))::INT AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""
