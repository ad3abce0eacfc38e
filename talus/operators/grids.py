"""Operators between polygons and grids: scanline masks, zonal series, distance transforms, common grids, heights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import geo
from talus.operators.exposure import with_fallback
from talus.operators.zones import counts_up_to
from talus.sources.storage import stored


@dataclass(frozen=True)
class Grid:
    """Cells of a grid: corner of the first cell, steps (dy below 0: rows go down), numbers of rows and columns."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    def x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * self.dx

    def y(self, row: Column) -> Column:
        return F.lit(self.y0) + (row + 0.5) * self.dy

    def row_of(self, y: Column) -> Column:
        return F.floor((y - self.y0) / self.dy).cast("int")

    def col_of(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.dx).cast("int")

    def holds(self, row: Column, col: Column) -> Column:
        return row.between(0, self.rows - 1) & col.between(0, self.cols - 1)


# -- polygons on grids ------------------------------------------------------------------------


def scanline_mask(edges: DataFrame, by: list[str], part: str, grid: Grid) -> DataFrame:
    """`by`, row, col of the cells whose middle lies in any part of a group; rings of one part are odd and even (holes are out).

    Each edge goes to the rows whose middle it crosses (its lower end counts, its upper does not), the
    crossings of a row are sorted, and every second stretch between them is inside, from its start up to before its end.
    """
    span = lambda a, b, n: F.sequence(F.greatest(a - 1, F.lit(0)), F.least(b + 1, F.lit(n - 1)))
    r1, r2 = grid.row_of(F.col("y1")), grid.row_of(F.col("y2"))
    some = (F.greatest(r1, r2) >= -1) & (F.least(r1, r2) <= grid.rows)
    crossed = edges.filter(some).withColumn("row", F.explode(span(F.least(r1, r2), F.greatest(r1, r2), grid.rows)))
    y = grid.y(F.col("row"))
    crossed = crossed.filter((F.col("y1") > y) != (F.col("y2") > y))
    at = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    line = Window.partitionBy(*by, part, "row").orderBy("_x")
    crossed = crossed.select(*by, part, "row", at.alias("_x")).withColumns({"_k": F.row_number().over(line), "_end": F.lead("_x").over(line)})
    c1, c2 = grid.col_of(F.col("_x")), grid.col_of(F.col("_end"))
    first, last = F.least(c1, c2), F.greatest(c1, c2)
    inside = crossed.filter((F.col("_k") % 2 == 1) & F.col("_end").isNotNull() & (last >= -1) & (first <= grid.cols))
    cells = inside.withColumn("col", F.explode(span(first, last, grid.cols)))
    x = grid.x(F.col("col"))
    return cells.filter((x >= F.col("_x")) & (x < F.col("_end"))).select(*by, "row", "col").distinct()


def polygon_mask(rings: DataFrame, edges: DataFrame, by: list[str], part: str, grid: Grid) -> DataFrame:
    """As scanline_mask, and for a group too small to hold the middle of a cell the cell of its vertices' mean (if on the grid)."""
    mean = rings.select(*by, F.explode("vertices").alias("v")).groupBy(*by).agg(F.avg("v.lon").alias("x"), F.avg("v.lat").alias("y"))
    centre = mean.select(*by, grid.row_of(F.col("y")).alias("row"), grid.col_of(F.col("x")).alias("col")).filter(grid.holds(F.col("row"), F.col("col")))
    return with_fallback(scanline_mask(edges, by, part, grid), centre, by)


def zonal_series(mask: DataFrame, layers: DataFrame, by: list[str], layer: list[str], value: str, least: float = 0.5) -> DataFrame:
    """For each group of the mask and layer that has a cell in it: its cells, the share with a value, their mean and that less the layer's.

    The mean is null where fewer than `least` of the group's cells have a value.
    """
    sizes = mask.groupBy(*by).agg(F.count("*").alias("n_cells"))
    whole = layers.groupBy(*layer).agg(F.avg(value).alias("_whole"))
    met = mask.join(layers.select(*layer, "row", "col", value), ["row", "col"])
    each = met.groupBy(*by, *layer).agg(F.count(value).alias("n_valid"), F.avg(value).alias("_mean")).join(sizes, by).join(whole, layer)
    share = F.col("n_valid") / F.col("n_cells")
    mean = F.when(share >= least, F.col("_mean"))
    return each.select(*by, *layer, "n_cells", share.alias("valid_share"), mean.alias(value), (mean - F.col("_whole")).alias("relative"))


# -- distances --------------------------------------------------------------------------------


def _lines(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with an equal key column, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(key)[0].as_py() != keys[a]:
                    yield pa.concat_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def lower_envelope(at: np.ndarray, height: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """min over i of height[i] + (asked - at[i])^2, for growing whole `at` and `asked`: by the lowest of the parabolas at each place."""
    keep, starts = [], []
    for i in range(len(at)):
        start = -np.inf
        while keep:
            j = keep[-1]
            start = (height[i] + at[i] ** 2 - height[j] - at[j] ** 2) / (2.0 * (at[i] - at[j]))
            if start > starts[-1]:
                break
            keep.pop()
            starts.pop()
            start = -np.inf
        keep.append(i)
        starts.append(start)
    own = np.array(keep)[np.searchsorted(np.array(starts), asked, side="right") - 1]
    return height[own] + (asked - at[own]) ** 2


def distance_transform(pixels: DataFrame, by: list[str], mask: Column, every: bool = False) -> DataFrame:
    """`square`: for each pixel the squared distance, in cells, to the nearest pixel of its grid that the mask holds for; null without any.

    First along rows, by windows that carry the last flagged column on and the next one back; then
    across them, where every row offers a parabola, the lowest of which wins: one column of a grid at a time. Absent cells
    are crossed; with `every` they have a row of their own.
    """
    ends = pixels.groupBy(*by).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    on = pixels.filter(F.coalesce(mask, F.lit(False))).select(*by, "row", "col").distinct()
    spine = on.select(*by, "row").distinct().join(ends, by).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    flagged = spine.join(on.withColumn("_on", F.col("col")), [*by, "row", "col"], "left")
    line = Window.partitionBy(*by, "row").orderBy("col")
    before = F.last("_on", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_on", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("col") - before, after - F.col("col")).cast("long")
    key = F.to_json(F.struct(*by, "col"))
    across = flagged.select(key.alias("_line"), *by, F.col("col").cast("int").alias("col"), F.col("row").cast("int").alias("row"), gap.alias("_gap"), F.col("_r0").cast("int").alias("_r0"), F.col("_r1").cast("int").alias("_r1"))
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _lines(batches, 0):
            rows, gaps = one.column(n + 2).to_numpy().astype(np.int64), one.column(n + 3).to_numpy().astype(np.float64)
            asked = np.arange(one.column(n + 4)[0].as_py(), one.column(n + 5)[0].as_py() + 1)
            square = lower_envelope(rows, gaps**2, asked)
            named = [c.take(pa.array(np.zeros(len(asked), np.int64))) for c in one.columns[1 : n + 2]]
            yield pa.RecordBatch.from_arrays([*named, pa.array(asked.astype(np.int32)), pa.array(square.astype(np.int64))], [*by, "col", "row", "square"])

    kinds = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in by)
    found = across.repartition("_line").sortWithinPartitions("_line", "row").mapInArrow(run, f"{kinds}, col int, row int, square long")
    return found if every else pixels.join(found, [*by, "row", "col"], "left")


# -- common grids and heights -----------------------------------------------------------------


def common_grid(grids: DataFrame, by: list[str], area: DataFrame, buffer: float, key: str) -> DataFrame:
    """Each grid (left, top, right, bottom, res, epsg) with its whole offsets into the grid that all of its group share.

    The shared rectangle is clipped to the group's `area` (minx, miny, maxx, maxy) and a buffer, and snapped to the cells of the
    group's first grid by `key`. `status` is ok, or why there are no offsets: mixed (several sizes of cells or projections),
    apart (nothing is shared), misaligned (this grid's cells lie between those of the first).
    """
    g = grids.groupBy(*by).agg(
        F.max("left").alias("_l"), F.min("top").alias("_t"), F.min("right").alias("_r"), F.max("bottom").alias("_b"), F.count_distinct("res", "epsg").alias("_kinds"),
        F.min_by(F.struct("left", "top", "res"), key).alias("_first"),
    )
    g = g.join(area, by, "left").withColumns({
        "_l": F.greatest("_l", F.col("minx") - buffer), "_r": F.least("_r", F.col("maxx") + buffer), "_t": F.least("_t", F.col("maxy") + buffer), "_b": F.greatest("_b", F.col("miny") - buffer),
    })
    res = F.col("_first.res")
    snapped = lambda c: F.col(f"_first.{c}") + F.rint((F.col(f"_{c[0]}") - F.col(f"_first.{c}")) / res) * res
    status = F.when(F.col("_kinds") > 1, "mixed").when((F.col("_r") <= F.col("_l")) | (F.col("_t") <= F.col("_b")), "apart")
    shared = g.select(*by, status.alias("_status"), snapped("left").alias("_left"), snapped("top").alias("_top"), F.col("_r"), F.col("_b"), res.alias("_res"))
    size = {"width": F.rint((F.col("_r") - F.col("_left")) / F.col("_res")), "height": F.rint((F.col("_top") - F.col("_b")) / F.col("_res"))}
    off = {"col_off": (F.col("_left") - F.col("left")) / F.col("_res"), "row_off": (F.col("top") - F.col("_top")) / F.col("_res")}
    between = F.greatest(*(F.abs(c - F.rint(c)) for c in off.values())) > 1e-3
    told = F.coalesce("_status", F.when(between, "misaligned"), F.lit("ok"))
    ok = F.col("status") == "ok"
    out = grids.join(shared, by).withColumn("status", told)
    columns = {"grid_left": F.col("_left"), "grid_top": F.col("_top")} | {k: c.cast("int") for k, c in size.items()} | {k: F.rint(c).cast("int") for k, c in off.items()}
    return out.select(*grids.columns, "status", *(F.when(ok, c).alias(k) for k, c in columns.items()))


def without_sentinels(height: Column) -> Column:
    """A height, or null for what stands for none: below -1000 m, and exactly 0."""
    return F.when((height >= -1000.0) & (height != 0.0), height)


def freezing_share(heights: DataFrame, days: DataFrame, by: list[str], height: str, lapse_per_km: float = 6.5) -> DataFrame:
    """`days` with the share of their area that thaws and freezes on the day, from all heights of the area.

    Temperatures hold at the mean height and fall with height; the day freezes above `low_m` and thaws below `high_m`. How much of the
    area lies between is read from its hypsometric curve, by running counts; no day meets the cells.
    """
    h = heights.select(*by, without_sentinels(F.col(height)).cast("double").alias("_h")).filter("_h is not null")
    ends = h.groupBy(*by).agg(F.avg("_h").alias("_mean"), F.min("_h").alias("_low"), F.greatest(F.max("_h") - F.min("_h"), F.lit(1.0)).alias("_span"), F.count("*").alias("n_cells"))
    level = lambda c: F.col("_mean") + F.col(c) * 1000.0 / lapse_per_km
    asked = days.join(ends, by, "left").withColumns({"low_m": level("tmin_c"), "high_m": level("tmax_c")})
    scaled = lambda c: (F.col(c) - F.col("_low")) / F.col("_span")
    items = h.join(ends.select(*by, "_low", "_span"), by).select(*by, scaled("_h").alias("_s"))
    counted = counts_up_to(items, asked.withColumn("_s", scaled("low_m")), by, "_s", "_upto").withColumn("_s", scaled("high_m"))
    counted = counts_up_to(items, counted, by, "_s", "_from", descending=True)
    between = F.greatest(F.col("n_cells") - F.col("_from") - F.col("_upto"), F.lit(0))
    known = F.col("low_m").isNotNull() & F.col("high_m").isNotNull()
    return counted.select(*days.columns, "low_m", "high_m", F.when(known, between / F.col("n_cells")).alias("share"))


# -- projections ------------------------------------------------------------------------------


def sampled_across(cells: DataFrame, fine: DataFrame, by: list[str], value: str, grid: Grid, zone: int, fine_grid: Grid, fine_zone: int) -> DataFrame:
    """`cells` with `value` of the cell of another grid, in another zone of the projection, that is nearest to their middle.

    Middles go back to longitude and latitude and forward into the other zone; the cell's row and
    column follow by arithmetic, so that both grids meet by an equi-join. Null off the other grid and where it has no cell.
    """
    # each step has columns of its own: the series repeat their arguments many times
    there = cells.withColumns({"_x": grid.x(F.col("col")), "_y": grid.y(F.col("row"))})
    lon, lat = geo.utm_to_lonlat(F.col("_x"), F.col("_y"), zone)
    there = there.withColumns({"_lon": lon, "_lat": lat})
    e, n = geo.lonlat_to_utm(F.col("_lon"), F.col("_lat"), fine_zone)
    there = stored(there.withColumns({"_r": fine_grid.row_of(n), "_c": fine_grid.col_of(e)}).drop("_x", "_y", "_lon", "_lat"), "sampled-across")
    other = fine.select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return there.join(other, [*by, "_r", "_c"], "left").drop("_r", "_c")
