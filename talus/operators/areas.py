"""Areas of polygons that overlap: their common boundary, projected, and what it encloses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.exposure import points_uncovered, polygon_edges
from talus.sources.storage import stored


def projected(rings: DataFrame, by: list[str], place) -> DataFrame:
    """Rings with their vertices (lon, lat) put through `place`, a function of two columns that gives two."""

    def moved(v):
        x, y = place(v["lon"], v["lat"])
        return F.struct(x.alias("lon"), y.alias("lat"))

    return rings.select(*by, "ring", F.transform("vertices", moved).alias("vertices"))


def _counter_clockwise(rings: DataFrame, by: list[str]) -> DataFrame:
    nxt = F.concat(F.slice("vertices", 2, F.greatest(F.size("vertices") - 1, F.lit(0))), F.slice("vertices", 1, 1))
    twice = F.aggregate(F.arrays_zip(F.col("vertices").alias("p"), nxt.alias("q")), F.lit(0.0), lambda s, e: s + e["p"]["lon"] * e["q"]["lat"] - e["q"]["lon"] * e["p"]["lat"])
    return rings.withColumn("vertices", F.when(twice < 0, F.reverse("vertices")).otherwise(F.col("vertices")))


#: Parts of a cell on each side, in which edges are cut and covered cells are looked for.
FINE = 8


def _in_cells(edges: DataFrame, cell: float) -> DataFrame:
    """`edges` cut at the borders of cells: `_from` and `_upto` along the edge, and the cell (_cx, _cy) that the stretch lies in."""

    def lines(c: str) -> Column:
        """Where the edge crosses lines of the grid."""
        a, b = F.col(f"{c}1"), F.col(f"{c}2")
        low, high = F.ceil(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)
        return F.when((a != b) & (low <= high), F.transform(F.sequence(low, high), lambda k: (k * cell - a) / (b - a))).otherwise(F.array().cast("array<double>"))

    ends = F.array(F.lit(0.0), F.lit(1.0))
    at = F.array_sort(F.array_distinct(F.concat(ends, F.filter(F.concat(lines("x"), lines("y")), lambda t: (t > 0.0) & (t < 1.0)))))
    cut = edges.withColumn("_at", at).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_at") - 1)))
    cut = cut.withColumns({"_from": F.get("_at", F.col("_k") - 1), "_upto": F.get("_at", F.col("_k"))}).drop("_at", "_k")
    half = (F.col("_from") + F.col("_upto")) / 2
    place = lambda c: F.floor((F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * half) / cell)
    return cut.withColumns({"_cx": place("x"), "_cy": place("y")})


def _covered_cells(edges: DataFrame, stretches: DataFrame, by: list[str], part: str, cell: float) -> DataFrame:
    """`by`, _cx, _cy: the cells that lie wholly inside one part of a group.

    Between two cells of a row that hold edges of a part, no edge of it is: all cells there are inside if the edges cross the middle of the row an odd
    number of times before them.
    """
    rows = F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell)))
    crossing = edges.withColumn("_cy", rows).withColumn("_y", (F.col("_cy") + 0.5) * cell).filter((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
    x = F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1"))
    held = stretches.select(*by, part, "_cx", "_cy", F.lit(0).alias("_n")).unionByName(crossing.select(*by, part, F.floor(x / cell).alias("_cx"), "_cy", F.lit(1).alias("_n")))
    held = held.groupBy(*by, part, "_cy", "_cx").agg(F.sum("_n").alias("_n"))
    line = Window.partitionBy(*by, part, "_cy").orderBy("_cx")
    gaps = held.select(*by, "_cy", "_cx", F.lead("_cx").over(line).alias("_next"), F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("_before"))
    gaps = gaps.filter((F.col("_before") % 2 == 1) & (F.col("_next") > F.col("_cx") + 1))
    return gaps.select(*by, F.explode(F.sequence(F.col("_cx") + 1, F.col("_next") - 1)).alias("_cx"), "_cy").distinct()


def union_boundary(rings: DataFrame, by: list[str], part: str, cell: float) -> DataFrame:
    """`by`, x1, y1, x2, y2: the directed edges (inside on their left) of the boundary of what the parts of each group cover together.

    Edges are cut at the borders of fine cells, and what lies in a cell that one part covers wholly goes at once: where many parts lie over each other,
    only the outer stretches are left. These are cut where they cross those of other parts, which they meet in cells; a piece whose middle lies in
    another part of its group is covered and goes: a piece looks for one such part among those of its cell, not for all, and these are parts that
    have stretches left. Each part is one ring without holes; parts with stretches of boundary in common are not told apart there.
    """
    fine = cell / FINE
    edges = polygon_edges(_counter_clockwise(rings, [*by, part]), [*by, part]).drop("ring")
    edges = stored(edges.filter("x1 <> x2 or y1 <> y2").withColumn("edge", F.monotonically_increasing_id()), "union-edges")
    stretches = _in_cells(edges, fine)
    covered = _covered_cells(edges, stretches, by, part, fine)
    left = stored(stretches.join(covered.hint("merge"), [*by, "_cx", "_cy"], "left_anti"), "union-stretches")
    other = left.select(*by, "_cx", "_cy", F.col(part).alias("_part"), *(F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")))
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    turn = dx * ey - dy * ex
    t = ((F.col("_x1") - F.col("x1")) * ey - (F.col("_y1") - F.col("y1")) * ex) / F.nullif(turn, F.lit(0.0))
    u = ((F.col("_x1") - F.col("x1")) * dy - (F.col("_y1") - F.col("y1")) * dx) / F.nullif(turn, F.lit(0.0))
    met = left.join(other.hint("merge"), [*by, "_cx", "_cy"]).filter(F.col(part) != F.col("_part")).withColumns({"_t": t, "_u": u})
    stretch = ["edge", "_from", "_upto"]
    cuts = met.filter(F.col("_t").between(F.col("_from"), F.col("_upto")) & F.col("_u").between(0.0, 1.0)).select(*stretch, "_t").distinct()
    ends = left.select(*stretch, F.explode(F.array("_from", "_upto")).alias("_t"))
    line = Window.partitionBy(*stretch).orderBy("_t")
    pieces = cuts.unionByName(ends).distinct().withColumn("_to", F.lead("_t").over(line)).filter("_to is not null").drop("_from", "_upto")
    along = lambda c, at: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * at
    cut = edges.join(pieces.hint("merge"), "edge").select(
        *by, part, F.struct("edge", "_t").alias("piece"), *(along(c, F.col(at)).alias(f"{c}{k}") for k, at in ((1, "_t"), (2, "_to")) for c in "xy"),
        along("x", (F.col("_t") + F.col("_to")) / 2).alias("lon"), along("y", (F.col("_t") + F.col("_to")) / 2).alias("lat"),
    )
    cut = stored(cut, "union-pieces")
    # a part that holds a piece's middle, but not its whole cell, has a stretch of its own there
    near = left.select(*by, part).distinct()
    near = stored(edges.join(near.hint("merge"), [*by, part], "left_semi").withColumn("ring", F.lit(0)), "union-near")
    return points_uncovered(cut, near, by, part, fine).select(*by, "x1", "y1", "x2", "y2")


def enclosed_area(boundary: DataFrame, by: list[str]) -> DataFrame:
    """Area and length of a directed boundary, in the square of its unit and in its unit."""
    twice = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return boundary.groupBy(*by).agg((F.sum(twice) / 2).alias("area"), F.sum(length).alias("length"), F.count("*").alias("n_edges"))
