"""Operators that score zones against places: nearest distances, ROC, bootstrap, permutation, regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.geo import haversine_km
from talus.operators.exposure import points_in_polygons, polygon_edges
from talus.sources.storage import stored


#: Zones of a leaf, levels of the tree of cells, and bits of each level: a cell has 8 x 8 x 8 parts.
LEAF, LEVELS, BITS = 64, 7, 3
_FINEST = LEVELS * BITS


def _on_sphere(df: DataFrame, lon: str, lat: str, name: str) -> DataFrame:
    """`df` with coordinates of places on the unit sphere (`name`: an array), and as whole numbers _x, _y, _z of 2 ** _FINEST."""
    a, b = F.radians(F.col(lon)), F.radians(F.col(lat))
    df = df.withColumn(name, F.array(F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)))
    whole = lambda c: F.least(F.floor((c + 1.0) * 2.0 ** (_FINEST - 1)), F.lit(2**_FINEST - 1)).cast("long")
    return df.withColumns({c: whole(F.get(name, F.lit(i))) for i, c in enumerate(("_x", "_y", "_z"))})


def _cell(bits: str) -> Column:
    """The cell of a place with so many bits of its coordinates: their number, and its place among the cells of that size."""
    part = lambda c: F.expr(f"shiftright({c}, {_FINEST} - {bits})").alias(c)
    return F.struct(F.expr(f"cast({bits} as int)").alias("bits"), part("_x"), part("_y"), part("_z"))


def _bounds(a: str, b: str, radius: Column) -> tuple[Column, Column]:
    """The least and the largest distance (km) of an edge in cell b from a place in cell a, `radius` being the largest in b."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c in ("_x", "_y", "_z"):
        side = lambda cell: F.pow(F.lit(2.0), F.lit(_FINEST) - F.col(f"{cell}.bits"))
        a0, b0 = F.col(f"{a}.{c}") * side(a), F.col(f"{b}.{c}") * side(b)
        gap = F.greatest(a0 - b0 - side(b), b0 - a0 - side(a), F.lit(0.0))
        reach = F.greatest(a0 + side(a) - b0, b0 + side(b) - a0)
        near, far = near + gap * gap, far + reach * reach
    return _arc(near) - radius, _arc(far) - radius


def _arc(square: Column) -> Column:
    """Kilometres of a chord, from its square in units of the finest cells."""
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(square) / 2.0**_FINEST))


def _ends(radius: Column) -> tuple[Column, Column]:
    """The least and the largest distance (km) of the edge of zone _zone from a place in cell _q."""
    side, near, far = F.pow(F.lit(2.0), F.lit(_FINEST) - F.col("_q.bits")), F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        at = (F.col(f"_zone.{c}") + 1.0) * 2.0 ** (_FINEST - 1) - F.col(f"_q._{c}") * side
        gap, reach = F.greatest(-at, at - side, F.lit(0.0)), F.greatest(at, side - at)
        near, far = near + gap * gap, far + reach * reach
    return _arc(near) - radius, _arc(far) - radius


def _parallel(df: DataFrame) -> int:
    """Tasks for few rows with much work, which would be put together by their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _square(z: Column) -> Column:
    """Square of the chord from a place to a zone of a list."""
    return sum((z[c] - F.col(f"_h{c}")) * (z[c] - F.col(f"_h{c}")) for c in "xyz")


#: Zones of a list, and points of a cell that meet it in one row; points that a cell holds on average, unless there are few cells; rows of a task.
LIST, HOT, SHARED, FEW, ROWS = 1024, 4096, 512, 256, 128


def _first_nearest(here: np.ndarray, there: np.ndarray, radius: np.ndarray | None) -> np.ndarray:
    """For each place (column of x, y, z) the first of the zones that are nearest to it, by their middles or, with radii, by their edges; in blocks that stay in the processor's cache."""
    out, step = np.empty(here.shape[1], np.int32), max(1, 2**16 // max(there.shape[1], 1))
    for i in range(0, here.shape[1], step):
        d = [there[k][None, :] - here[k, i : i + step, None] for k in range(3)]
        square = (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2]
        away = square if radius is None else 2 * 6371.0 * np.arcsin(np.minimum(1.0, np.sqrt(square) / 2)) - radius
        out[i : i + step] = away.argmin(axis=1)
    return out


def _nearest_of_list(edges: bool):
    """Arrays of places and of zones: the place in the list of each place's nearest zone; null without a list."""

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for lists in batches:
            found = [None if x[3] is None else _first_nearest(np.stack(x[:3]), np.stack(x[3:6]), x[6] if edges else None) for x in zip(*lists, strict=True)]
            yield pd.Series(found, dtype=object)

    return nearest


def _bits_of_points(points: DataFrame, shared: list[str], deepest: int) -> int:
    """Bits of the cells of points (with _x, _y, _z): the most, up to twice as wide as the smallest cells of zones, with which cells hold SHARED points or are FEW."""
    most = BITS * deepest - 1
    count = points.agg(F.count("*"), *(F.approx_count_distinct(F.struct(*shared, _cell(str(k)))) for k in range(2, most + 1))).first()
    return max((k for k in range(2, most + 1) if count[k - 1] <= max(FEW, count[0] / SHARED)), default=2)


def _met(points: DataFrame, zones: DataFrame, by: list[str], point: str, zone: str, radius: str | None, best) -> DataFrame:
    """The points, of each group where they do not name one, with `_best`: the least of `best` over lists of zones that may be nearest, among them the nearest.

    Zones lie in the cells of a tree over the globe, which are parted until one holds LEAF zones at most: dense areas have small
    cells, wherever they are. The cells that points lie in, shared by some hundred of them, descend the tree together: of the cells in sight, those go that
    are surely farther than another's farthest end, and the rest are parted, down to the leaves and then to their zones. What is left
    for a cell of points is a list (zone, x, y, z, radius, lon, lat), by name, which its points meet as one row: nothing is shuffled or gathered by
    pairs of points and zones, nor by points and groups: only a cell's points together are asked of each group's list.
    Only lists of more than LIST zones are cut, and points that meet several are put together again.
    Points that lack some of `by` are asked of all groups by one join. Zones at one place are one: that of largest radius, then smallest name.
    Cells in sight and points are dealt to tasks by their keys, however small the tables are in bytes, and cells of many points to several rows; joins are merge
    joins at every size, so that neither points nor zones are gathered in the driver, but a row for each HOT points of a full cell.
    """
    shared, n = [c for c in by if c in points.columns], _parallel(points)
    rest = [c for c in by if c not in shared]
    r = F.lit(0.0) if radius is None else F.col(radius)
    first = F.min(F.struct((-r).alias("less"), F.col(zone).alias("zone"))).alias("_m")
    placed = zones.filter("lon is not null and lat is not null").groupBy(*by, "lon", "lat").agg(first)
    there = F.struct(F.col("_m.zone").alias("zone"), *(F.get("_there", F.lit(i)).alias(c) for i, c in enumerate("xyz")), (-F.col("_m.less")).alias("radius"), "lon", "lat").alias("_zone")
    placed = stored(_on_sphere(placed, "lon", "lat", "_there").select(*by, there, "_x", "_y", "_z"), "nearest-placed")
    levels = F.explode(F.array(*(F.lit(BITS * k) for k in range(1, LEVELS + 1))))
    tree = placed.select(*by, "_zone.radius", "_x", "_y", "_z", levels.alias("_bits")).groupBy(*by, _cell("_bits").alias("_cell"))
    tree = stored(tree.agg(F.count("*").alias("_n"), F.max("radius").alias("_most")), "nearest-tree")
    deepest = (tree.filter((F.col("_n") > LEAF) & (F.col("_cell.bits") < _FINEST)).agg(F.max("_cell.bits")).first()[0] or 0) // BITS + 1
    up = lambda c: F.shiftright(F.col(f"_cell.{c}"), BITS).alias(c)
    parent = F.struct((F.col("_cell.bits") - BITS).alias("bits"), up("_x"), up("_y"), up("_z")).alias("_parent")
    children = tree.select(*by, parent, F.col("_cell").alias("_child"), F.col("_n").alias("_child_n"), F.col("_most").alias("_child_most"))

    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    asked = _on_sphere(points.filter(known), "lon", "lat", "_here")
    asked = asked.withColumn("_q", _cell(str(_bits_of_points(asked, shared, deepest))))
    asked = asked.select(*points.columns, "_q", *(F.get("_here", F.lit(i)).alias(f"_h{c}") for i, c in enumerate("xyz")))
    top = tree.filter(F.col("_cell.bits") == BITS).select(*by, "_cell", "_n", "_most")  # some hundreds of cells of each group at most
    # written out: a shuffle that follows the one of the counts directly is left out, and with it the number of tasks
    sights = stored(asked.groupBy(*shared, "_q").agg(F.count("*").alias("_asked")), "nearest-sights")
    at = sights.drop("_asked")
    seen = (at.join(top, shared) if shared else at.crossJoin(F.broadcast(top))).repartition(n, *by, "_q")
    for level in range(1, deepest + 1):
        near, far = _bounds("_q", "_cell", F.col("_most"))
        least = F.min("_far").over(Window.partitionBy(*by, "_q"))
        seen = seen.withColumns({"_near": near, "_far": far}).withColumn("_least", least).filter(F.col("_near") <= F.col("_least") + 1e-6).drop("_near", "_far", "_least")
        if level < deepest:
            whole = (F.col("_n") <= LEAF) | (F.col("_cell.bits") < BITS * level)
            # what stays whole meets no child, under keys of its own
            nothing = F.struct(F.lit(-1).alias("bits"), *(F.col(f"_q.{c}").alias(c) for c in ("_x", "_y", "_z")))
            parts = seen.withColumn("_parent", F.when(whole, nothing).otherwise(F.col("_cell"))).join(children.hint("merge"), [*by, "_parent"], "left")
            seen = parts.select(*by, "_q", F.coalesce("_child", "_cell").alias("_cell"), F.coalesce("_child_n", "_n").alias("_n"), F.coalesce("_child_most", "_most").alias("_most")).repartition(n, *by, "_q")
    pairs = stored(seen.select(*by, "_q", "_cell", F.ceil(F.sum("_n").over(Window.partitionBy(*by, "_q")) / LIST).alias("_lists")), "nearest-cells")
    near, far = _ends(F.col("_zone.radius"))
    # zones meet the leaves that are in sight, at the depths that these have
    depths = [r[0] for r in pairs.select("_cell.bits").distinct().collect()]
    leaves = placed.withColumn("_bits", F.explode(F.array(*map(F.lit, depths)).cast("array<int>"))).select(*by, "_zone", _cell("_bits").alias("_cell"))
    listed = leaves.join(pairs.hint("merge"), [*by, "_cell"]).withColumns({"_near": near, "_far": far, "_list": F.pmod(F.xxhash64("_zone.lon", "_zone.lat"), F.col("_lists"))})
    listed = listed.groupBy(*by, "_q", "_list").agg(F.collect_list(F.struct("_near", "_zone")).alias("_all"), F.min("_far").alias("_least"))
    left = F.transform(F.filter("_all", lambda z: z["_near"] <= F.col("_least") + 1e-6), lambda z: z["_zone"])
    lists = stored(listed.select(*by, "_q", "_list", F.array_sort(left).alias("_zones")), "nearest-lists")

    hot = F.broadcast(sights.filter(F.col("_asked") > HOT).select(*shared, "_q", F.ceil(F.col("_asked") / HOT).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    lists_of = lists.join(hot, [*shared, "_q"], "left")
    tasks = max(n, math.ceil((lists_of.agg(F.sum(parts)).first()[0] or 0) / ROWS))
    lists_of = lists_of.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    dealt = asked.join(hot, [*shared, "_q"], "left").withColumn("_part", F.pmod(F.xxhash64(point), parts).cast("int")).drop("_parts")
    keys = [*shared, "_q", "_part"]
    here = F.struct(*points.columns, "_hx", "_hy", "_hz")
    groups = dealt.repartition(tasks, *keys).groupBy(*keys).agg(F.collect_list(here).alias("_points"))
    met = groups.join(lists_of.repartition(tasks, *keys).hint("merge"), keys, "inner" if rest else "left")
    met = met.withColumn("_i", _nearest_of_list(radius is not None)(*(f"_points._h{c}" for c in "xyz"), *(f"_zones.{c}" for c in "xyz"), "_zones.radius"))
    chosen = F.transform("_points", lambda p, k: F.struct(p.alias("p"), F.get("_zones", F.get("_i", k)).alias("z")))
    met = met.select(*rest, F.explode(chosen).alias("_e")).select(*rest, "_e.p.*", F.col("_e.z").alias("_z"))
    met = met.select(*points.columns, *rest, F.when(F.col("_z").isNotNull(), best(F.col("_z"))).alias("_best"))
    if not lists.filter("_list > 0").isEmpty():
        met = met.groupBy(*by, point).agg(F.first(F.struct(*points.columns)).alias("_p"), F.min("_best").alias("_best")).select("_p.*", *rest, "_best")
    nowhere = points.filter(~known)  # in no group's cells
    if rest:
        nowhere = nowhere.crossJoin(F.broadcast(zones.select(*rest).distinct()))
    return met.unionByName(nowhere.withColumn("_best", F.lit(None).cast(met.schema["_best"].dataType)))


def nearest_zone(points: DataFrame, zones: DataFrame, by: list[str], point: str, zone: str) -> DataFrame:
    """For each point the distance (km) to the nearest zone, and which; null where a group has no zone or the point no place.

    Points (each once) that lack columns of `by` have a row for each group of them that there is.
    """
    best = lambda z: F.struct(_square(z).alias("square"), z["zone"].alias("zone"), z["lon"].alias("lon"), z["lat"].alias("lat"))
    met = _met(points, zones, by, point, zone, None, best)
    km = F.when(F.col("_best").isNotNull(), haversine_km(F.col("lon"), F.col("lat"), F.col("_best.lon"), F.col("_best.lat")))
    return met.select(*(c for c in met.columns if c != "_best"), km.alias("nearest_km"), F.col("_best.zone").alias("nearest_zone"))


def nearest_edge(points: DataFrame, zones: DataFrame, by: list[str], point: str, radius: str) -> DataFrame:
    """`by`, `point`, edge_km: the distance to the nearest edge of discs (`radius` in km) around the zones' middles, negative inside; null and groups as in nearest_zone."""
    edge = lambda z: 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(_square(z)) / 2)) - z["radius"]
    met = _met(points.select(*(c for c in by if c in points.columns), point, "lon", "lat"), zones.withColumn("_name", F.lit(0)), by, point, "_name", radius, edge)
    return met.select(*by, point, F.col("_best").alias("edge_km"))


def _rounded(x: Column, digits: int | None) -> Column:
    return x if digits is None else F.bround(x, digits)


def distance_roc(distances: DataFrame, by: list[str], buffers: list[float], label: str = "label", digits: int | None = 3) -> DataFrame:
    """For each buffer: true and false positive rates, specificity, precision, lift and F1 of `nearest_km`."""
    each = distances.withColumn("buffer_km", F.explode(F.array(*(F.lit(float(b)) for b in buffers))))
    inside = F.when(F.col("nearest_km") <= F.col("buffer_km"), 1.0).otherwise(0.0)
    rates = each.groupBy(*by, "buffer_km").agg(F.avg(F.when(F.col(label) == 1, inside)).alias("_t"), F.avg(F.when(F.col(label) == 0, inside)).alias("_f"))
    prec = _rounded(F.try_divide(F.col("_t"), F.col("_t") + F.col("_f")), digits)
    rows = rates.withColumn("precision", prec)
    f1 = F.when(F.col("precision") > 0, _rounded(F.try_divide(2 * F.col("precision") * F.col("_t"), F.col("precision") + F.col("_t")), digits))
    return rows.select(
        *by, "buffer_km", _rounded(F.col("_t"), digits).alias("tpr"), _rounded(F.col("_f"), digits).alias("fpr"), _rounded(1 - F.col("_f"), digits).alias("specificity"),
        "precision", F.when(F.col("_f") > 0, _rounded(F.try_divide(F.col("_t"), F.col("_f")), None if digits is None else 2)).alias("lift"), f1.alias("f1"),
    )


def roc_area(rows: DataFrame, by: list[str]) -> DataFrame:
    """Area under the rates by the trapezoid rule, from (0, 0) to (1, 1)."""
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    ends = groups.withColumn("e", F.explode(F.array(F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(-1.0).alias("o")), F.struct(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"), F.lit(1e9).alias("o"))))).select(*by, "e.*")
    w = Window.partitionBy(*by).orderBy("fpr", "o")
    p = rows.select(*by, "fpr", "tpr", F.col("buffer_km").alias("o")).unionByName(ends)
    part = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return p.withColumn("_a", part).groupBy(*by).agg(F.sum("_a").alias("auc"))


def ordinal_ranks(df: DataFrame, by: list[str], score: str, tie: str, cuts: int = 256) -> DataFrame:
    """`rank` of each row by score and tie, from 1.

    Approximate quantiles cut the scores into ranges; ranks are exact within a range, plus
    the rows of the ranges before, so that no task sorts all rows.
    """
    edges = df.groupBy(*by).agg(F.percentile_approx(score, [i / cuts for i in range(1, cuts)]).alias("_cuts"))
    joined = df.join(edges, by) if by else df.withColumn("_cuts", F.array(*map(F.lit, edges.first()[0] or [])).cast(f"array<{df.schema[score].dataType.simpleString()}>"))
    # the cuts below the score, counted by halving: eight looks at 256 cuts for a row
    steps = F.array(*(F.lit(2**k) for k in range(cuts.bit_length() - 1, -1, -1)))
    below = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("_cuts", n + step - 1) < F.col(score), n + step).otherwise(n))
    ranged = joined.withColumn("_range", below).drop("_cuts")
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(score, tie))
    return ranged.join(offsets, [*by, "_range"]).withColumn("rank", own + F.col("_before")).drop("_range", "_before")


def rank_auc(df: DataFrame, by: list[str], score: str, label: str, tie: str) -> DataFrame:
    """Mann-Whitney area from ordinal ranks; ties are ordered by `tie`."""
    ranked = ordinal_ranks(df.filter(F.col(score).isNotNull()), by, score, tie)
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return ranked.groupBy(*by).agg(n1.alias("n_pos"), n0.alias("n_neg"), F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("rank"))) - n1 * (n1 + 1) / 2.0, (n1 * n0).cast("double")).alias("auc"))


def _areas(tpr: np.ndarray, fpr: np.ndarray) -> np.ndarray:
    n = len(tpr)
    f = np.hstack([np.zeros((n, 1)), fpr, np.ones((n, 1))])
    t = np.hstack([np.zeros((n, 1)), tpr, np.ones((n, 1))])
    o = np.argsort(f, axis=1, kind="stable")
    return np.trapezoid(np.take_along_axis(t, o, 1), np.take_along_axis(f, o, 1), axis=1)


def bootstrap(distances: DataFrame, buffers: list[float], replicates: int = 1000, seed: int = 20260606, batch: int = 100) -> DataFrame:
    """replicate, kind (bootstrap or permutation), auc: the inventory resampled, and labels shuffled.

    Points within the same buffers are alike, so that counts by the number of buffers reached
    stand for all points: replicates draw multinomial and hypergeometric counts in tasks.
    """
    reached = sum((F.when(F.col("nearest_km") <= b, 1).otherwise(0) for b in buffers), F.lit(0))
    rows = distances.groupBy(reached.alias("k")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).collect()  # a row for each buffer
    m = len(buffers)
    pos, neg = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for r in rows:
        pos[r["k"]], neg[r["k"]] = r["pos"], r["neg"]
    order = np.argsort(buffers)
    assert (np.diff(np.array(buffers)[order]) > 0).all()
    rates = lambda c, n: (c[:, ::-1].cumsum(axis=1)[:, :m] / max(n, 1))  # noqa: E731  smallest buffer first: reached by the fewest

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame["id"]:
                g = np.random.default_rng([seed, int(b)])
                n1, n0 = int(pos.sum()), int(neg.sum())
                size = min(batch, replicates - int(b) * batch)
                drawn = g.multinomial(n1, pos / max(n1, 1), size=size)
                fixed = np.broadcast_to(rates(neg[None], n0), (size, m))
                shuffled = g.multivariate_hypergeometric(pos + neg, n1, size=size)
                for kind, auc in (("bootstrap", _areas(rates(drawn, n1), fixed)), ("permutation", _areas(rates(shuffled, n1), rates((pos + neg)[None] - shuffled, n0)))):
                    yield pd.DataFrame({"replicate": int(b) * batch + np.arange(size), "kind": kind, "auc": auc})

    n_batches = -(-replicates // batch)
    return distances.sparkSession.range(n_batches).repartition(n_batches).mapInPandas(run, "replicate long, kind string, auc double")


def confidence_interval(replicates: DataFrame, auc: float) -> DataFrame:
    """2.5th and 97.5th percentile of the bootstrap, and the share of shuffled labels that do as well: (1 + n) / (B + 1)."""
    boot, perm = F.col("kind") == "bootstrap", F.col("kind") == "permutation"
    q = F.percentile(F.when(boot, F.col("auc")), F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.agg(q[0].alias("low"), q[1].alias("high"), ((1 + F.count_if(perm & (F.col("auc") >= auc))) / (F.count_if(perm) + 1)).alias("p"))


def fit_logistic(df: DataFrame, features: list[str], label: str, rounds: int = 30, ridge: float = 1e-6) -> np.ndarray:
    """Weights (intercept first) of a logistic regression by iteratively reweighted least squares.

    Each round is one aggregation: the sums of the weighted products of the features.
    """
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    n = len(x)
    rows = df.select(*(c.alias(f"x{i}") for i, c in enumerate(x)), F.col(label).cast("double").alias("y")).na.drop().persist()
    beta = np.zeros(n)
    for _ in range(rounds):
        z = sum((F.col(f"x{i}") * float(beta[i]) for i in range(n)), F.lit(0.0))
        w = rows.withColumn("_z", z).withColumn("_p", 1 / (1 + F.exp(-F.col("_z")))).withColumn("_w", F.col("_p") * (1 - F.col("_p")) + 1e-6)
        target = F.col("_w") * F.col("_z") + F.col("y") - F.col("_p")
        sums = w.agg(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("_w")).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)), *(F.sum(F.col(f"x{i}") * target).alias(f"b{i}") for i in range(n))).first()
        if sums["b0"] is None:
            break
        a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + ridge * np.eye(n)
        new = np.linalg.solve(a, np.array([sums[f"b{i}"] for i in range(n)]))
        done = np.abs(new - beta).max() < 1e-10
        beta = new
        if done:
            break
    rows.unpersist()
    return beta


def logistic_score(features: list[str], beta: np.ndarray) -> Column:
    """Probability under fitted weights."""
    z = sum((F.col(c).cast("double") * float(b) for c, b in zip(features, beta[1:], strict=True)), F.lit(float(beta[0])))
    return 1 / (1 + F.exp(-z))


def kfold_auc(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5) -> DataFrame:
    """fold, auc: each fold, by a hash of the key, scored by weights fitted on the others."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")
    out = None
    for k in range(folds):
        beta = fit_logistic(df.filter(fold != k), features, label)
        one = rank_auc(df.filter(fold == k).withColumn("score", logistic_score(features, beta)), [], "score", label, key).select(F.lit(k).alias("fold"), "auc")
        out = one if out is None else out.unionByName(one)
    return out


def _uniform(seed: int, name: str) -> Column:
    """A number from 0 to 1 by the hash of a seed, a name and the counter `k`: the same wherever it is drawn."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def null_points(spark, rings: DataFrame, n: int, seed: int = 20260606, cap: int = 50) -> DataFrame:
    """k, lon, lat: the first n of numbered draws that lie inside any of the rings; ValueError if cap n draws do not hold n.

    A draw is a hash of the seed and its number within the rings' box, so that it does not matter where and when it is
    drawn. As many are drawn as the share that is met makes likely, in growing rounds; the first n by number stay.
    """
    edges = stored(polygon_edges(rings, []), "null-edges")
    box = edges.agg(F.min("x1").alias("x"), F.max("x1").alias("x1"), F.min("y1").alias("y"), F.max("y1").alias("y1")).first()
    if box["x"] is None:
        raise ValueError("no rings to draw in")
    at = lambda name, a, b: (F.lit(a) + _uniform(seed, name) * (b - a))
    drawn, kept, found = 0, None, 0
    while found < n and drawn < cap * n:
        more = min(cap * n - drawn, max(2 * n, math.ceil(1.2 * (n - found) * drawn / max(found, 1))) if drawn else 2 * n)
        draws = spark.range(drawn, drawn + more).select(F.col("id").alias("k")).select("k", at("lon", box["x"], box["x1"]).alias("lon"), at("lat", box["y"], box["y1"]).alias("lat"))
        inside = stored(draws.join(points_in_polygons(draws, edges, [], "k"), "k", "left_semi"), "null-points")
        kept, drawn = inside if kept is None else kept.unionByName(inside), drawn + more
        found += inside.count()
    if found < n:
        raise ValueError(f"only {found} of {drawn} draws lie inside the rings, {n} were asked for")
    if found == n or not n:
        return kept.limit(n)
    last = ordinal_ranks(kept, [], "k", "k").filter(F.col("rank") == n).first()["k"]
    return kept.filter(F.col("k") <= last)
