"""Merge trees: which parts of a network have grown together at any level, without labelling it again.

Nodes are born at a level and joined by edges at levels. Every node points to an elder one (born earlier, ties by
name) with which it is in one part from a level on, the lowest at which any elder one is: who
follows pointers up to a level comes to the eldest node of the part at that level. Paths have no more pointers than
the tree took rounds, so that a node's whole path is one short row, and may be asked for any number of levels.

Tables of nodes and pointers grow with the input, but are small as Parquet: their joins are merge joins at every
size, so that none of them is gathered in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.sources.storage import stored


def _roots(pointers: DataFrame, by: list[str], name: str, *kept: str) -> DataFrame:
    """`by`, node, root: where following `up` from each node ends, by pointers that reach three times as far each round; ends have no row.

    `pointers` is read several times; its columns `kept` are kept.
    """
    now = pointers.select(*by, "node", F.col("up").alias("root"), *kept)
    while True:
        new = now
        for step in ("_once", "_twice"):
            ahead = now.select(*by, F.col("node").alias("root"), F.col("root").alias(step))
            new = new.join(ahead.hint("merge"), [*by, "root"], "left").withColumn("root", F.coalesce(step, "root"))
        new = stored(new.select(*by, "node", "root", *kept, F.col("_twice").isNotNull().alias("_moved")), name)
        if new.filter("_moved").isEmpty():
            return new.drop("_moved")
        now = new.drop("_moved")


def merge_forest(edges: DataFrame, by: list[str]) -> DataFrame:
    """`by`, node, up, height, round: the pointers of a merge tree of `edges` (`by`, a, b, height).

    Nodes are named by what orders them, the eldest first; heights may be of any type that can be ordered. A part's
    lowest edge joins it for good if it leads to an elder part: in each `round` (1, 2, ...) all such edges are
    taken at once, the younger parts give their other edges to the elder ones, and the
    lowest edge between two parts stays. Each round is written out. Within a round the lowest edges along a
    path do not rise, so that each part points to the path's end.
    """
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    lowest = lambda df: stored(df.filter("a <> b").groupBy(*by, *pair).agg(F.min("height").alias("height")), "forest-edges")
    edges, tree, turn = lowest(edges), None, 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "height"))
        least = both.groupBy(*by, F.col("a").alias("node")).agg(F.min(F.struct("height", F.col("b").alias("up"))).alias("_e")).select(*by, "node", "_e.up", "_e.height")
        joined = stored(least.filter(F.col("up") < F.col("node")), "forest-joined")
        roots = _roots(joined, by, "forest-roots", "height")
        pointers = roots.select(*by, "node", F.col("root").alias("up"), "height", F.lit(turn).alias("round"))
        tree = pointers if tree is None else tree.unionByName(pointers)
        for end in ("a", "b"):
            edges = edges.join(roots.select(*by, F.col("node").alias(end), "root").hint("merge"), [*by, end], "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = lowest(edges)
    return edges.select(*by, F.col("a").alias("node"), F.col("b").alias("up"), "height", F.lit(turn).alias("round")) if tree is None else tree


def histories(tree: DataFrame, by: list[str]) -> DataFrame:
    """`by`, node, steps: the parts that each node comes into, lowest first: `height` above which, and `part`, its eldest node.

    From the last round back: who was joined in a round comes into that part, and then where the part's eldest
    node comes; what that one comes into up to the same height is passed at once. Each node is met once. The eldest of all have no row.
    """
    last = tree.agg(F.max("round")).first()[0] or 0
    known = stored(tree.filter(F.col("round") == last).select(*by, "node", F.array(F.struct("height", F.col("up").alias("part"))).alias("steps")), "forest-histories")
    for turn in range(last - 1, 0, -1):
        ahead = known.select(*by, F.col("node").alias("up"), F.col("steps").alias("_ahead"))
        own = tree.filter(F.col("round") == turn).join(ahead.hint("merge"), [*by, "up"], "left")
        passed = F.try_element_at(F.filter("_ahead", lambda s: s["height"] <= F.col("height")), F.lit(-1))["part"]
        first = F.array(F.struct("height", F.coalesce(passed, "up").alias("part")))
        steps = F.when(F.col("_ahead").isNull(), first).otherwise(F.concat(first, F.filter("_ahead", lambda s: s["height"] > F.col("height"))))
        known = known.unionByName(stored(own.select(*by, "node", steps.alias("steps")), "forest-histories"))
    return known


def eldest_in(asked: DataFrame, known: DataFrame, by: list[str], node: str, level: str, strict: bool = True) -> DataFrame:
    """`asked` with `eldest`: the eldest node of the part that its node is in at its level (joined below it, or up to it), by `histories`."""
    below = lambda s: s["height"] < F.col(level) if strict else s["height"] <= F.col(level)
    met = asked.join(known.select(*by, F.col("node").alias(node), "steps").hint("merge"), [*by, node], "left")
    return met.withColumn("eldest", F.coalesce(F.try_element_at(F.filter("steps", below), F.lit(-1))["part"], node)).drop("steps")


def eldest_at(asked: DataFrame, tree: DataFrame, by: list[str], node: str, level: str, strict: bool = True) -> DataFrame:
    """`eldest_in` of a tree that is asked once."""
    return eldest_in(asked, histories(tree, by), by, node, level, strict)


def saddle_edges(cells: DataFrame, by: list[str], level: Column) -> tuple[DataFrame, DataFrame]:
    """The cells of a grid (`by`, row, col) that have a level, with their `basin`, and the edges between basins that touch by their sides.

    Each cell points to the lowest of itself and its four neighbours; a basin is named by the level and code of its lowest
    cell. An edge has the height at which the first two cells across the border both exist.
    """
    code = F.col("row").cast("long") * 1_000_000_000 + F.col("col")
    own = stored(cells.withColumn("_level", level).filter("_level is not null").withColumn("node", F.struct(F.col("_level").alias("level"), code.alias("code"))), "basin-cells")
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    sent = own.select(*by, "row", "col", "node", F.explode(steps).alias("_s")).select(*by, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), F.col("node").alias("_other"))
    touching = stored(own.select(*by, "row", "col", "node").join(sent.hint("merge"), [*by, "row", "col"]).select(*by, "node", "_other"), "basin-touching")
    down = touching.groupBy(*by, "node").agg(F.min("_other").alias("up")).filter(F.col("up") < F.col("node"))
    roots = _roots(stored(down, "basin-pointers"), by, "basin-roots")
    named = stored(own.join(roots.hint("merge"), [*by, "node"], "left").withColumn("basin", F.coalesce("root", "node")).drop("root"), "basins")
    at = named.select(*by, "node", "basin")
    met = touching.filter(F.col("_other") < F.col("node")).join(at.withColumnRenamed("basin", "a").hint("merge"), [*by, "node"])
    met = met.join(at.select(*by, F.col("node").alias("_other"), F.col("basin").alias("b")).hint("merge"), [*by, "_other"]).filter("a <> b")
    return named, met.select(*by, "a", "b", F.col("node.level").alias("height"))


def zones_at_levels(cells: DataFrame, by: list[str], level: Column, levels: list[float], least: int = 3) -> DataFrame:
    """The cells of the zones of at least `least` cells at each of `levels` (`at`), with the zone's name `zone` (struct), from one merge tree.

    A cell exists at all levels above its own.
    """
    named, edges = saddle_edges(cells, by, level)
    tree = stored(merge_forest(edges, by), "merge-tree")
    asked = named.withColumn("at", F.explode(F.array(*map(F.lit, levels)))).filter(F.col("_level") < F.col("at"))
    basins = eldest_at(asked.select(*by, "at", "basin").distinct(), tree, by, "basin", "at").withColumnRenamed("eldest", "zone")
    on = stored(asked.join(basins.hint("merge"), [*by, "at", "basin"]).drop("_level", "node", "basin"), "zones-at-levels")
    sizes = on.groupBy(*by, "at", "zone").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return on.join(sizes.select(*by, "at", "zone").hint("merge"), [*by, "at", "zone"], "left_semi")
